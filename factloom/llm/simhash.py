"""SimHash near-duplicates, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import nearcopies
from factloom.llm.common import map_batches, packed, shuffles_dropped
from factloom.llm.components import connected_components

SEED, CHUNK = 42, 1 << 16


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit SimHash (signed) of a text's word shingles; zero for no words."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    if not found:
        return 0
    joined = b" ".join(found)
    n = len(found) - size + 1
    if n < 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
        n = 1
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, mark, fingerprint bigint), a row for each row of ``docs``; mark is a hash of the text.

    A null text has no words: zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t.as_py(), size) for t in b.column(2)], pa.int64())], ["doc_id", "mark", "fingerprint"])

    text = F.col("text").cast("string")
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("mark"), text.alias("text")), run, "doc_id bigint, mark bigint, fingerprint bigint")


def links(prints: DataFrame, bucket: int = 64) -> DataFrame:
    """Pairs (a, b) of distinct values of ``prints(fingerprint)`` that join all that differ in 1 or 2 bits.

    Multi-index hashing over two 32-bit segments: two fingerprints within 2 bits agree in the low segment, or
    differ by at most 1 bit in the high one. So the ball of radius 1 of the high segment (33 keys) and the low
    segment itself (radius 0) are looked up in the segment tables, and the complete distance is verified.
    A table bucket of over ``bucket`` distinct fingerprints (a large group of near copies) is not looked up,
    for it would give the square of its size in pairs. Its members enumerate the radius-1 balls of both segments
    together with the other segment (65 keys of 64 bits) instead: two fingerprints lie within 2 bits exactly when
    they share such a key, and no key has over 65 holders, each linked to the least of them. That is exact: for a
    pair within 2 bits, at least one of the two looks the other up, or both are members of large buckets.
    The result links all such pairs, some by way of a third fingerprint that is within 2 bits of both.
    """
    # Dealt out anew: a fingerprint is 8 bytes here and 33 rows a line below, so sizes would put them in too few tasks.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = prints.select(F.col("fingerprint").alias("f")).where("f is not null").repartition(tasks, "f").distinct()
    high, low = F.shiftrightunsigned("f", 32), F.col("f").bitwiseAND(0xFFFFFFFF)
    segments = F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("key")), F.struct(F.lit(1).alias("seg"), low.alias("key"))))
    tables = f.select("f", segments.alias("s")).select("f", "s.seg", "s.key")
    sizes = tables.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n"))
    sized = packed(tables.join(sizes, ["seg", "key"]))
    light = sized.where(F.col("n") <= bucket).select("seg", "key", F.col("f").alias("g"))
    ball = F.concat(F.array(high), F.array(*[high.bitwiseXOR(F.lit(1 << i).cast("bigint")) for i in range(32)]))
    probes = f.select("f", F.explode(ball).alias("key")).select("f", F.lit(0).alias("seg"), "key").unionByName(f.select("f", F.lit(1).alias("seg"), low.alias("key")))
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= 2
    found = probes.join(light, ["seg", "key"]).where(F.col("f") != F.col("g")).where(near).select(F.greatest("f", "g").alias("a"), F.least("f", "g").alias("b"))
    crowded = sized.where(F.col("n") > bucket).select("f").distinct()
    keys = F.concat(F.array("f"), F.array(*[F.col("f").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint")) for i in range(64)]))
    held = crowded.select("f", F.explode(keys).alias("key")).withColumn("g", F.min("f").over(Window.partitionBy("key")))
    return found.unionByName(held.where(F.col("f") != F.col("g")).where(near).select(F.col("f").alias("a"), F.col("g").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint string, component_id): all documents with their group of near-duplicates.

    Documents whose fingerprints differ in at most 2 bits are linked, and so are groups by way of others;
    ``component_id`` is the group's least doc_id. Copies share one fingerprint and cost one row in the search.

    Null texts and texts without words have fingerprint zero and are linked like any other. Rows with a null
    doc_id stay and never name a group unless no other row is in it (then it is null). Repeated rows stay, each
    with the group's id. Other columns of ``docs`` are ignored, whatever their names. Empty in, empty out.
    """
    named = _named(docs, size)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _named(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, mark, fingerprint, component_id) of each row."""
    with shuffles_dropped(docs.sparkSession):
        prints = packed(fingerprints(docs, size))
        first = packed(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
        roots = connected_components(links(first))
    rooted = first.join(roots, first.fingerprint == roots.node, "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(rooted.join(groups, "root").select("fingerprint", "component_id"), "fingerprint")


def keep_one(docs: DataFrame, size: int = 3, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document for each group of near-duplicates: that of the least doc_id.

    Near-duplicates are those of 2 bits or, given ``similarity``, of that Jaccard similarity of their shingles.

    Rows are told apart by doc_id and text: repeated rows of the kept document all stay, and of a doc_id with several
    texts each goes with its own group. Rows whose doc_id is null stay (they can't be told apart).
    """
    named = _named(docs, size) if similarity is None else nearcopies.groups(docs, size, similarity)
    gone = named.where("doc_id <> component_id").select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark")).distinct()
    same = (F.col("doc_id").cast("bigint") == F.col("of")) & (F.xxhash64(F.col("text").cast("string")) == F.col("of_mark"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)
