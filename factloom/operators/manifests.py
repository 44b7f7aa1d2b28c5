"""Fingerprints, manifests and inventories of trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of entry files, and extensions of sources that aren't parsed.
ENTRY_STEMS = ("index", "main", "app", "server", "cli", "worker", "router", "lib", "mod")
UNPARSED = ("go", "rb", "java", "kt", "kts", "swift", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "cs", "php", "scala", "clj", "ex", "exs", "erl", "hs", "ml", "lua", "dart", "groovy", "mm", "pl", "pm", "jl", "zig", "nim", "vb", "fs", "fsx", "py", "pyi")
# End of fixed values.


def world_fingerprint(files: DataFrame) -> DataFrame:
    """(repo, fingerprint): SHA-256 over the sorted ``file NUL hash NUL`` of ``files(repo, file, hash)``.

    One hash has to see a repository's list in order, so a row gathers the digests of one repository's files.
    """
    each = F.concat("file", F.lit("\0"), "hash", F.lit("\0"))
    listed = files.select("repo", "file", each.alias("each")).groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("file", "each"))).alias("all"))
    return listed.select("repo", F.sha2(F.array_join(F.transform("all", lambda x: x["each"]), ""), 256).alias("fingerprint"))


def framed_fingerprint(files: DataFrame) -> DataFrame:
    """(repo, fingerprint): SHA-256 over each file's path, tag and content digest in path order, every field after its length in 8 bytes."""
    framed = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c).cast("bigint")), 16, "0")), F.encode(c, "utf-8"))
    digest = F.sha2("content", 256)
    d = files.select("repo", "path", F.hex(F.concat(framed(F.col("path")), framed(F.col("tag")), framed(F.coalesce(digest, F.lit(""))))).alias("each"))
    g = d.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("path", "each"))).alias("all"))
    return g.select("repo", F.sha2(F.unhex(F.array_join(F.transform("all", lambda x: x["each"]), "")), 256).alias("fingerprint"))


def tree_fnv(files: DataFrame) -> DataFrame:
    """(repo, fingerprint): FNV-1a (64 bits) over ``path NUL bytes NUL`` of ``files(repo, path, content)`` in path order, each path once.

    The hash runs through all bytes in order and doesn't combine, so a repository is one task; repositories run side by side.
    """
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        h = 0xCBF29CE484222325
        for x in g.drop_duplicates("path").sort_values("path").itertuples(index=False):
            for b in x.path.encode() + b"\0" + (bytes(x.content) if x.content is not None else b"unreadable:") + b"\0":
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return pd.DataFrame({"repo": [g["repo"].iloc[0]], "fingerprint": [f"fnv1a64:{h:016x}"]})

    kind = files.schema["repo"].dataType.simpleString()
    return files.select("repo", "path", F.col("content").cast("binary").alias("content")).groupBy("repo").applyInPandas(run, f"repo {kind}, fingerprint string")


def manifest_errors(files: DataFrame, allowed: DataFrame) -> DataFrame:
    """(path, problem) of ``files(path, sha256, is_link)`` against ``allowed(path, sha256)``: extra, missing, changed or a link."""
    a = allowed.select(F.col("path").alias("p"), F.col("sha256").alias("want"))
    d = files.join(a, files.path == a.p, "full_outer")
    problem = F.when(F.col("path").isNull(), "missing").when(F.col("p").isNull(), "extra").when(F.col("is_link"), "link").when(F.col("sha256") != F.col("want"), "changed")
    return d.select(F.coalesce("path", "p").alias("path"), problem.alias("problem")).where("problem is not null")


def observation_changes(captured: DataFrame, again: DataFrame) -> DataFrame:
    """Rows that only one of two observations has (with repeats): a snapshot is unchanged if there are none."""
    return captured.exceptAll(again).withColumn("side", F.lit("captured")).unionByName(again.exceptAll(captured).withColumn("side", F.lit("again")))


def git_inventory(listed: DataFrame, extensions: tuple[str, ...] = UNPARSED) -> DataFrame:
    """(path, outcome): each listed path once: admitted, shape (hidden, skipped or odd), skipped_extension or unsupported."""
    from factloom.functions import paths

    p = F.col("path")
    outcome = F.when(~paths.admitted_shape(p), "shape").when(paths.extension(p).isin(*extensions), "skipped_extension").when(paths.language(p).isNotNull(), "admitted").otherwise("unsupported")
    return listed.select("path").distinct().select("path", outcome.alias("outcome"))


def entry_rank(language: Column, path: Column) -> Column:
    """A file's rank as an entry to its language, null if it is none."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    depth = F.size(F.split(path, "/")) - 1
    in_rust = F.when(path.rlike(r"(^|/)src/(lib|main)\.rs$"), 0).when(path.contains("/src/bin/"), 1).when(path.endswith("/mod.rs"), 2)
    in_typescript = F.when(path.startswith("src/") | path.startswith("app/"), F.least(depth, F.lit(3))).when(depth <= 1, 3)
    return F.when(language == "rust", in_rust).when((language == "typescript") & stem.isin(*ENTRY_STEMS), in_typescript)


def working_set(files: DataFrame, selected: DataFrame, most: int = 64, fallback: int = 32) -> DataFrame:
    """Selected paths, and entry files by rank and path until there are ``most``; where neither is, the first product files.

    ``files(path, language, role)``. Both lists are bounded by their parameters.
    """
    chosen = selected.select("path").distinct()
    room = most - chosen.limit(most).count()
    ranked = files.withColumn("rank", entry_rank(F.col("language"), F.col("path"))).where("rank is not null").join(chosen, "path", "left_anti").orderBy("rank", "path").limit(max(room, 0)).select("path")
    out = chosen.unionByName(ranked)
    return files.where("role = 'product'").orderBy("path").limit(fallback).select("path") if out.isEmpty() else out


def dependencies(manifests: DataFrame, workspace: DataFrame) -> DataFrame:
    """(package, name, version, path): a member's dependencies; what it leaves to the workspace comes from there.

    ``manifests(package, name, version, path, inherited)``, ``workspace(name, version, path)``.
    """
    w = workspace.select("name", F.col("version").alias("w_version"), F.col("path").alias("w_path"))
    d = manifests.join(w, "name", "left")
    return d.select("package", "name", F.when(F.col("inherited"), F.col("w_version")).otherwise(F.col("version")).alias("version"), F.when(F.col("inherited"), F.col("w_path")).otherwise(F.col("path")).alias("path"))


def marked_roles(files: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, role): the role of the first marker (by ordinal) that is the path or one of its directories; else what the path shows.

    Paths meet ``markers(ordinal, path, role)`` in an equi join on their own prefixes.
    """
    from factloom.functions import paths

    parts = F.split("path", "/")
    p = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("m"))
    m = markers.select("ordinal", paths.marker(F.col("path")).alias("m"), "role")
    best = p.join(m, "m").groupBy("path").agg(F.min_by("role", "ordinal").alias("role"))
    return files.select("path").join(best, "path", "left").select("path", F.coalesce("role", paths.source_role(F.col("path"))).alias("role"))


def config_violations(rows: DataFrame, key: str, parents: DataFrame | None = None, reference: str | None = None) -> DataFrame:
    """(key, problem) of a table's ids: null, malformed or repeated, and references to parents that aren't there."""
    from factloom.functions.codes import is_identifier

    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    d = rows.withColumn("n", n)
    problem = F.when(F.col(key).isNull(), "missing").when(~is_identifier(F.col(key)), "malformed").when(F.col("n") > 1, "repeated")
    out = d.select(F.col(key).alias("key"), problem.alias("problem")).where("problem is not null").distinct()
    if parents is not None:
        lost = rows.join(parents, rows[reference].eqNullSafe(parents["id"]), "left_anti").select(F.col(key).alias("key"), F.lit("no_parent").alias("problem"))
        out = out.unionByName(lost.distinct())
    return out
