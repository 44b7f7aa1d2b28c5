"""Lines, offsets, tokens, fences and sections of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx


def lines(docs: DataFrame, key: str = "file", source: str = "source") -> DataFrame:
    """(key, line_no, start, text): lines with byte offsets; a carriage return before the end is cut, the last empty line is none.

    Offsets are running sums over a document's lines: one shuffle by document, of lines.
    """
    raw = F.split(F.coalesce(F.col(source), F.lit("")), "\n")
    sizes = F.transform("raw", lambda x: F.octet_length(x).cast("bigint") + 1)
    d = docs.select(F.col(key), raw.alias("raw")).withColumn("raw", F.when((F.size("raw") > 1) & (F.element_at("raw", -1) == ""), F.slice("raw", 1, F.size("raw") - 1)).otherwise(F.col("raw")))
    exploded = d.select(key, F.posexplode(F.arrays_zip(F.col("raw").alias("text"), sizes.alias("size"))).alias("i", "z"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return exploded.select(key, (F.col("i") + 1).alias("line_no"), F.coalesce(F.sum("z.size").over(w), F.lit(0)).alias("start"), F.regexp_replace("z.text", "\r$", "").alias("text"))


def line_col(positions: DataFrame, line_table: DataFrame, key: str = "file") -> DataFrame:
    """``positions(key, offset)`` with line and 1-based byte column: the last line that starts at or before the offset.

    The union of both tables is ordered by offset within each file, so each line start is carried to the positions
    after it: an as-of join with one shuffle and no range join.
    """
    a = line_table.select(key, F.col("start").alias("offset"), F.struct("line_no", "start").alias("l"), F.lit(0).alias("side"))
    b = positions.select(key, "offset", F.lit(None).cast("struct<line_no:int,start:bigint>").alias("l"), F.lit(1).alias("side"))
    last = F.last("l", ignorenulls=True).over(Window.partitionBy(key).orderBy("offset", "side").rowsBetween(Window.unboundedPreceding, 0))
    out = a.unionByName(b).withColumn("at", last).where("side = 1")
    return out.select(key, "offset", F.col("at.line_no").alias("line"), (F.col("offset") - F.col("at.start") + 1).alias("col"))


def fenced(line_table: DataFrame, key: str = "file") -> DataFrame:
    """Lines with ``fence``: the number of the line that opened the fenced block they are in (both fences included), else null.

    A fence closes only by the same mark, at least as wide. Only the lines that begin with a mark are folded, in order;
    those between take the state after the last of them.
    """
    t = F.trim(F.col("text"))
    marks = line_table.where(t.rlike("^(`{3,}|~{3,})")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("all"))
    out = F.array().cast("array<struct<line_no:int,own:int,after:int>>")
    zero = F.struct(F.lit(None).cast("int").alias("open"), F.lit("").alias("mark"), F.lit(0).alias("width"), out.alias("out"))
    none = F.lit(None).cast("int")

    def step(a: Column, x: Column) -> Column:
        text = F.trim(x["text"])
        opening, no = tx.opening_fence(text), x["line_no"].cast("int")
        closes = tx.is_closing_fence(text, a["mark"], a["width"])
        told = lambda own, after: F.array(F.struct(no.alias("line_no"), own.alias("own"), after.alias("after")))
        state = lambda o, m, w, own: F.struct(o.alias("open"), m.alias("mark"), w.alias("width"), F.concat(a["out"], told(own, o)).alias("out"))
        return (
            F.when(a["open"].isNull() & opening.isNotNull(), state(no, opening["mark"], opening["width"], no)).when(a["open"].isNull(), state(none, F.lit(""), F.lit(0), none))
            .when(closes, state(none, F.lit(""), F.lit(0), a["open"])).otherwise(state(a["open"], a["mark"], a["width"], a["open"]))
        )

    told = marks.select(key, F.explode(F.aggregate("all", zero, step)["out"]).alias("m")).select(F.col(key).alias("_key"), F.col("m.line_no").alias("_line"), F.struct("m.own", "m.after").alias("_m"))
    d = line_table.join(told, F.col(key).eqNullSafe(F.col("_key")) & (F.col("line_no") == F.col("_line")), "left")
    last = F.last("_m", ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("_last", last).select(key, "line_no", "start", "text", F.when(F.col("_m").isNotNull(), F.col("_m.own")).otherwise(F.col("_last.after")).alias("fence"))


def sections(line_table: DataFrame, key: str = "file") -> DataFrame:
    """(key, line_no, level, title, last_line, role): headings with the line before the next heading of the same or a higher level.

    A heading without a role of its own takes that of the nearest heading above that encloses it.
    """
    t = F.trim(F.col("text"))
    heads = line_table.withColumn("level", tx.heading_level(t)).where("level is not null").withColumn("title", tx.heading_text(t))
    total = line_table.groupBy(key).agg(F.max("line_no").alias("total"))
    after = Window.partitionBy(key).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= n, F.col("line_no"))).over(after).alias(f"end{n}") for n in range(1, 7)]
    h = heads.select("*", *ends)
    end = F.coalesce(*[F.when(F.col("level") == n, F.col(f"end{n}")) for n in range(1, 7)])
    return h.join(total, key).select(key, "line_no", "level", "title", F.coalesce(end - 1, "total").alias("last_line"), tx.section_role(F.col("title")).alias("role"))


def tokens(docs: DataFrame, key: str = "file", source: str = "source") -> DataFrame:
    """(key, pos, token, depth): words, numbers and single signs, with the depth of braces before each."""
    found = F.regexp_extract_all(F.col(source), F.lit(r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|\S"), F.lit(0))
    d = docs.select(key, F.posexplode(found).alias("pos", "token"))
    delta = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return d.select(key, "pos", "token", F.coalesce(F.sum(delta).over(w), F.lit(0)).alias("depth"))


def support_queries(docs: DataFrame, most: int = 128, key: str = "file", source: str = "source") -> DataFrame:
    """The first ``most`` distinct identifier tokens in order of document and position."""
    t = docs.select(F.col(key).alias("k"), F.posexplode(tx.identifier_tokens(F.col(source))).alias("pos", "token"))
    first = t.groupBy("token").agg(F.min(F.struct("k", "pos")).alias("first"))
    return first.orderBy("first", "token").limit(most).select("token", F.col("first.k").alias(key), F.col("first.pos").alias("pos"))
