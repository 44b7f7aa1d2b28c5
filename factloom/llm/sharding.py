"""Shards of near equal bytes by a k-d tree over the documents' metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import shared

DIMENSIONS = ("k0", "k1", "k2")
BINS = 1024
PARTS = 64  # a group of equal texts of over 1/64 of a shard is cut into parts
#: Of a key's 62 bits, 24 are the coordinate, 26 the text's hash and 12 the part.
TIE, PART = 38, 12
#: So many nodes of a level (a hundred bytes each) may go to every executor. Of more, none is large, so a shuffle deals rows evenly.
SMALL_LEVEL = 1 << 16


def keys(docs: DataFrame, leaves: int, total: int) -> DataFrame:
    """(doc_id, size, text_crc32, g1, deal, k0, k1, k2) of ``docs(doc_id, size, text_crc32, g1, g2, lang, source, row)``, rows of one part with equal ties.

    Of a group of equal texts all rows get the least coordinates in it. Ties are ordered by the text's hash and then by
    part. A group of more parts than PART bits can tell is dealt over the whole range of ties.
    """
    part = max(1, total // leaves // PARTS)
    groups = docs.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.min("lang").alias("lang"), F.min("source").alias("source"))
    groups = groups.select("g1", "g2", "lang", "source", F.ceil(F.col("bytes") / part).alias("parts"))
    groups = shared(groups)  # so that the join reads both sides from exchanges, and a hot group's rows can be split
    rows = docs.drop("lang", "source").join(groups, ["g1", "g2"])
    dealt = F.xxhash64("doc_id", "row", F.lit(3))
    deal = F.when(F.col("parts") > 1, F.pmod(dealt, F.least("parts", F.lit(1 << TIE)))).otherwise(F.lit(0))
    near = F.shiftleft(F.shiftrightunsigned("g1", 64 - TIE + PART), PART).bitwiseOR(deal)
    tie = F.when(F.col("parts") <= 1 << PART, near).otherwise(dealt.bitwiseAND((1 << TIE) - 1))
    scale = F.least(F.lit((1 << 24) - 1), F.floor(F.log2(F.col("size").cast("double")) * (1 << 19))).cast("bigint")
    coordinates = zip(DIMENSIONS, (F.col("lang"), F.col("source"), scale), strict=True)
    return rows.select("doc_id", "size", "text_crc32", "g1", deal.alias("deal"), *[F.shiftleft(c, TIE).bitwiseOR(tie).alias(k) for k, c in coordinates])


def _of(dimension: str) -> Column:
    out = F.col(DIMENSIONS[-1])
    for i, k in enumerate(DIMENSIONS[:-1]):
        out = F.when(F.col(dimension) == i, F.col(k)).otherwise(out)
    return out


def _nodes(rows: DataFrame, span: dict[str, int]) -> DataFrame:
    """A row for each node of the level: its widest dimension, the interval [low, high] that holds the cut, the bytes below it and those wanted."""
    ends = rows.groupBy("first").agg(F.max("leaves").alias("leaves"), F.sum("size").alias("total"), *[f(k).alias(n + k) for k in DIMENSIONS for n, f in (("a", F.min), ("b", F.max))])
    wide = [(F.shiftright("b" + k, TIE) - F.shiftright("a" + k, TIE)) / span[k] for k in DIMENSIONS]
    best = F.greatest(*wide)
    at = F.lit(len(DIMENSIONS) - 1)
    for i in reversed(range(len(DIMENSIONS) - 1)):
        at = F.when(wide[i] == best, F.lit(i)).otherwise(at)
    half = F.floor(F.col("leaves") / 2)
    pick = lambda n: F.get(F.array(*[F.col(n + k) for k in DIMENSIONS]), F.col("dimension"))
    ends = ends.withColumn("dimension", at)
    return ends.select("first", "leaves", "dimension", pick("a").alias("low"), pick("b").alias("high"), F.lit(0).cast("bigint").alias("before"), (F.col("total") * half / F.col("leaves")).alias("want"), F.lit(None).cast("bigint").alias("cut"))


def _narrowed(rows: DataFrame, nodes: DataFrame, tolerance: float, hint) -> DataFrame:  # noqa: ANN001
    """``nodes`` with each open interval narrowed to the one of its BINS parts in which the wanted bytes are reached, or with a cut."""
    opened = nodes.where("cut is null").withColumn("width", F.greatest(F.lit(1), F.expr("(high - low) div " + str(BINS) + " + 1")))
    binned = rows.select("first", "size", *DIMENSIONS).join(hint(opened), "first").withColumn("v", _of("dimension")).where("v between low and high")
    bins = binned.groupBy("first", F.expr("(v - low) div width").alias("bin")).agg(F.sum("size").alias("bytes"), F.min("v").alias("a"), F.max("v").alias("b"))
    upto = Window.partitionBy("first").orderBy("bin")
    told = bins.withColumn("sum", F.sum("bytes").over(upto)).join(hint(opened), "first")
    reached = (F.col("before") + F.col("sum") >= F.col("want")).cast("int")
    one = told.groupBy("first").agg(F.min_by(F.struct("bin", "bytes", "a", "b", "sum"), F.struct(1 - reached, F.when(reached == 1, F.col("bin")).otherwise(-F.col("bin")))).alias("s"))
    out = nodes.join(hint(one), "first", "left")
    before = F.col("before") + F.col("s.sum") - F.col("s.bytes")
    nearer = F.when(F.col("want") - before < before + F.col("s.bytes") - F.col("want"), F.col("s.a")).otherwise(F.col("s.b") + 1)
    ended = (F.col("s.bytes") <= tolerance) | (F.col("s.a") == F.col("s.b"))
    new = {"low": F.col("s.a"), "high": F.col("s.b"), "before": before, "cut": F.when(ended, nearer)}
    return out.select(*[F.when(F.col("s").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in nodes.columns])


def grow(rows: DataFrame, leaves: int, tolerance: float) -> DataFrame:
    """``rows(k0, k1, k2, size, ...)`` with ``shard``, the number of their leaf.

    The tree grows level by level, its nodes being a table: ``first`` (the least shard below a node) names one. A node
    of m leaves is cut along its widest dimension where m // 2 of its m shares of bytes lie below: a weighted median (for
    odd m, the nearest quantile), found by histograms of 1024 bins. Each pass narrows the cut's interval to one bin (its
    least to its greatest key, so that sparse intervals narrow faster) until that bin has at most ``tolerance`` bytes or
    a single key. Rows and nodes are written after each level and pass; to the driver comes only whether a node is open.
    """
    ends = rows.agg(*[f(F.shiftright(k, TIE)).alias(n + k) for k in DIMENSIONS for n, f in (("a", F.min), ("b", F.max))]).first()
    span = {k: max(1, (ends["b" + k] or 0) - (ends["a" + k] or 0)) for k in DIMENSIONS}
    rows = rows.withColumn("first", F.lit(0)).withColumn("leaves", F.lit(leaves))
    most, count = leaves, 1
    while most > 1:
        hint = F.broadcast if count <= SMALL_LEVEL else lambda t: t
        inner = rows.where("leaves > 1")
        nodes = shared(_nodes(inner, span))
        while nodes.where("cut is null").limit(1).count():
            nodes = shared(_narrowed(inner, nodes, tolerance, hint))
        rows = rows.join(hint(nodes.select("first", "dimension", "cut")), "first", "left")
        left, half = F.coalesce(_of("dimension") < F.col("cut"), F.lit(True)), F.floor(F.col("leaves") / 2).cast("int")
        inside = F.col("leaves") > 1
        first = F.when(inside & ~left, F.col("first") + half).otherwise(F.col("first"))
        below = F.when(~inside, F.col("leaves")).when(left, half).otherwise(F.col("leaves") - half)
        rows = shared(rows.withColumns({"first": first, "leaves": below}).drop("dimension", "cut"))
        most, count = most - most // 2, 2 * count
    return rows.drop("leaves").withColumnRenamed("first", "shard")


def shard(docs: DataFrame, shards: int | None = 24, target_bytes: int | None = None, run: int = 10_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row: ``shards`` leaves, or as many as ``target_bytes`` asks for.

    Dimensions: language and source (as hashes) and the size (as a logarithm), those of equal texts being the least of
    the group. Ties are ordered by the text's hash, so equal texts stay together; only a group of over 1/64 of a shard
    is dealt out in parts of that size, next to each other, so that sizes stay near equal whatever the groups are. Which
    of its rows come in which part follows from doc_id and the row's place in the input, so rows of one id are dealt too.
    A slot is the row's gapless number in its shard: the count of rows in earlier runs (by hash of doc_id, text and part,
    of about ``run`` rows each) and the number within the run. No task sorts a whole shard.

    Null texts have size 8 and the checksum of no bytes. Null doc_ids come first in their run; repeated rows have a slot
    each. Null languages and sources are values like any other. Other columns are ignored. Empty in, empty out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    code = lambda c: F.coalesce(F.xxhash64(F.col(c).cast("string")), F.lit(0)).bitwiseAND((1 << 24) - 1)
    d = docs.select(F.col("doc_id").cast("bigint"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(1), text).alias("g2"), code("lang").alias("lang"), code("source").alias("source"))
    d = shared(d.withColumn("row", F.monotonically_increasing_id()))  # written once, so row numbers don't change
    total = d.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    size = total["size"] or 0
    leaves = shards or max(1, -(-size // target_bytes))
    rows = grow(shared(keys(d, leaves, size)), leaves, size / leaves / 500)
    runs = max(1, -(-total["n"] // (leaves * run)))
    placed = rows.select("doc_id", "size", "text_crc32", "g1", "shard", F.pmod(F.xxhash64("doc_id", "g1", "deal"), F.lit(runs)).alias("run"))
    sizes = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("shard", "run", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "run").orderBy(F.col("doc_id").asc_nulls_first(), "g1", "size"))
    out = placed.withColumn("number", number).join(offsets, ["shard", "run"])
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") + F.col("number") - 1).cast("bigint").alias("slot"))
