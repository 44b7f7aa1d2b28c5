"""Trees of documents and sources, event journals and advice ledgers as DataFrames."""

from __future__ import annotations

import re
import sqlite3

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import paths

JOURNAL = "sequence bigint, kind string, attempt string, at struct<utc:timestamp,monotonic:double,clock_origin:double>, data string"
LEDGER = "work_item_id string, requests_used int, last_state_sha256 string"


def scan_tree(spark: SparkSession, root: str, with_content: bool = True, unseen_bytes: int = 64 << 20) -> DataFrame:
    """(path, content, length, sha256): files below ``root``, paths relative to it; version control's own are left out.

    The listing and reading is Spark's own, but for names that its sources leave out (those that begin with ``.`` or
    ``_``, and what lies in directories of such names). The driver reads these; of over ``unseen_bytes`` it raises.
    Without content only names and lengths are read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.ltrim(F.regexp_replace(F.col("path"), "^.*?" + _quoted(root.rstrip("/").split("://")[-1]), ""), F.lit("/"))
    out = files.select(relative.alias("path"), "length", "content").unionByName(_unseen(spark, root, with_content, unseen_bytes))
    return out.withColumn("sha256", F.sha2("content", 256)) if with_content else out.drop("content")


def _unseen(spark: SparkSession, root: str, with_content: bool, most: int) -> DataFrame:
    jvm, top = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    todo, rows, total = [(top, "", False)], [], 0
    while todo:
        folder, at, inside = todo.pop()
        for x in fs.listStatus(folder):
            name = x.getPath().getName()
            hidden = inside or name[0] in "._"
            if x.isDirectory():
                todo += [(x.getPath(), f"{at}{name}/", hidden)] * (name not in paths.VERSION_CONTROL)
            elif hidden:
                total += x.getLen()
                if with_content and total > most:
                    raise ValueError(f"files whose names Spark leaves out have over {most} bytes")
                rows.append((at + name, x.getLen(), _read(jvm, fs, x.getPath()) if with_content else None))
    return spark.createDataFrame(rows, "path string, length bigint, content binary")


def _read(jvm, fs, path) -> bytes:  # noqa: ANN001
    stream = fs.open(path)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_" else c for c in s)


def source_inventory(tree: DataFrame, profile: str = "all", language: str | None = None) -> DataFrame:
    """Admitted source files with language and role; other shapes, languages and roles are left out."""
    out = tree.withColumn("language", paths.language(F.col("path"))).withColumn("role", paths.source_role(F.col("path")))
    out = out.where(paths.admitted_shape(F.col("path")) & F.col("language").isNotNull() & paths.role_in_profile(F.col("role"), profile))
    return out.where(F.col("language") == language) if language else out


def excluded(tree: DataFrame, admitted: DataFrame) -> DataFrame:
    """Files of the tree that weren't admitted, each with its reason."""
    p = F.col("path")
    reason = F.when(paths.has_skipped_component(p), "hard_directory").when(paths.has_hidden_component(p), "hidden").when(paths.language(p).isNull(), "unsupported").otherwise("policy")
    return tree.join(admitted.select("path"), "path", "left_anti").select("path", reason.alias("reason"))


def ignore_rules(tree: DataFrame, names: tuple[str, ...] = (".gitignore", ".ignore")) -> DataFrame:
    """(dir, place, negated, dirs_only, pattern) of the tree's ignore files: a row for each rule, ``pattern`` a regular expression.

    A file's rules hold below its directory; ``place`` orders them (later names and lines count more).
    """
    name, at = F.element_at(F.split("path", "/"), -1), F.lit(0)
    for i, n in enumerate(names):
        at = F.when(name == n, i).otherwise(at)
    found = tree.where(name.isin(*names)).select(F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), at.alias("at"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("line_no", "line"))
    found = found.withColumn("rule", F.regexp_replace("line", r"(?<!\\)[ \t]+$", "")).where("rule <> '' and not startswith(rule, '#')")
    rule = F.regexp_replace(F.col("rule"), "^!", "")
    return found.select("dir", F.struct("at", "line_no").alias("place"), F.col("rule").startswith("!").alias("negated"), rule.endswith("/").alias("dirs_only"), F.pandas_udf(_patterns, "string")(rule).alias("pattern"))


def _pattern(rule: str) -> str:
    """A rule as a regular expression over paths relative to its directory."""
    body = rule.rstrip("/")
    anchored = "/" in body
    body, out = body.removeprefix("/"), "" if anchored else "(?:.*/)?"
    for m in re.finditer(r"(^|/)\*\*/|/\*\*$|\*+|\?|\[!?\]?[^\]]*\]|\\.|.", body, re.S):
        t = m[0]
        if t.endswith("**/"):
            out += "/(?:.*/)?" if t[0] == "/" else "(?:.*/)?"
        elif t == "/**":
            out += "/.+"
        elif t[0] == "*":
            out += "[^/]*"
        elif t == "?":
            out += "[^/]"
        elif t[0] == "[" and len(t) > 1:
            inner = t[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out += "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
        else:
            c = t[-1]
            out += c if c.isalnum() or c in "/_" or ord(c) > 127 else "\\" + c
    return f"^{out}$"


def _patterns(rules: pd.Series) -> pd.Series:
    return rules.map(_pattern)


def ignored(tree: DataFrame, rules: DataFrame) -> DataFrame:
    """(path) of the tree's files that ``rules`` leave out.

    A file or directory is ignored if the last rule that fits it says so: that of the deepest directory, and there of the
    greatest place. What lies in an ignored directory is ignored, whatever is said of it. Paths meet rules in an equi join
    on the rules' directory: each path with those above it.
    """
    parts = F.split("path", "/")
    upto = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    each = tree.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(upto(n).alias("at"), (n < F.size(parts)).alias("is_dir")))).alias("x")).select("path", "x.*")
    own = F.split("at", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda n: F.when(n > 0, F.array_join(F.slice(own, 1, n), "/")).otherwise(""))
    spots = each.select("at", "is_dir").distinct().select("at", "is_dir", F.explode(above).alias("dir"))
    relative = F.when(F.col("dir") == "", F.col("at")).otherwise(F.substring(F.col("at"), F.length("dir") + 2, F.length("at")))
    fits = spots.join(rules, "dir").where(F.col("is_dir") | ~F.col("dirs_only")).where(F.rlike(relative, F.col("pattern")))
    last = fits.groupBy("at", "is_dir").agg(F.max_by("negated", F.struct(F.length("dir"), "place")).alias("negated")).where(~F.col("negated")).select("at", "is_dir")
    return each.join(last, ["at", "is_dir"], "left_semi").select("path").distinct()


def inventory_counts(tree: DataFrame, admitted: DataFrame) -> DataFrame:
    """One row: how many files the tree has, how many were walked and read as sources, and the bytes of those."""
    total = tree.agg(F.count(F.lit(1)).alias("total_file_count"), F.count_if(~paths.has_skipped_component(F.col("path"))).alias("walk_file_count"))
    read = admitted.agg(F.count(F.lit(1)).alias("source_read_file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("source_read_byte_count"))
    return total.crossJoin(read)  # of one row each


def unsupported_documents(tree: DataFrame, formats: DataFrame) -> DataFrame:
    """(path, format, code) of declared documents in a format other than Markdown: ``formats(path, format)``."""
    return tree.join(formats, "path").where("format <> 'markdown'").select("path", "format", F.lit("unsupported_format").alias("code"))


def documents(tree: DataFrame, document_bytes: int | None = None, total_bytes: int | None = None) -> DataFrame:
    """Markdown files as text. A limit that is exceeded raises: nothing is cut."""
    out = tree.where(paths.extension(F.col("path")).isin("md", "mdx")).select("path", "length", F.decode("content", "UTF-8").alias("source"))
    if document_bytes is not None:
        out = out.withColumn("source", F.when(F.col("length") <= document_bytes, F.col("source")).otherwise(F.raise_error(F.concat(F.lit("document over limit: "), F.col("path"))).cast("string")))
    if total_bytes is not None and (total := out.agg(F.sum("length")).first()[0] or 0) > total_bytes:
        raise ValueError(f"documents have {total} bytes; the limit is {total_bytes}")
    return out


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """An event journal of JSON lines with the declared schema; a corrupt line raises."""
    return spark.read.schema(JOURNAL).option("mode", "FAILFAST").json(path)


def stream_journal(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(JOURNAL).json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The advice ledger of a SQLite file (one small table, read by the driver). An invalid row raises."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute("SELECT work_item_id, requests_used, last_state_sha256 FROM advice ORDER BY 1").fetchall()
    out = spark.createDataFrame(rows, LEDGER)
    ok = F.col("work_item_id").isNotNull() & F.col("requests_used").isin(1, 2) & F.col("last_state_sha256").rlike("^[0-9a-f]{64}$")
    return out.withColumn("requests_used", F.when(F.coalesce(ok, F.lit(False)), F.col("requests_used")).otherwise(F.raise_error(F.lit("invalid_advice_ledger")).cast("int")))
