"""Near copies by the Jaccard similarity of word shingles: SimHash with multi-index hashing first, an exact join for the links it misses."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_batches, packed, shuffles_dropped
from factloom.llm.components import connected_components

SEED = 42
#: Longs of a set's short parity sketch (a power of 2), and shingles that a sample tells to be frequent.
SKETCH = 8
COMMON = 200_000
#: SimHash fingerprints of a set, of 64 bits; the first is of the shingles' own hashes, the others of hashes made of these.
PRINTS = 12
MIX = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(1, PRINTS)], np.uint64)
#: So many nodes (24 bytes each) may go to every executor; more are joined by a shuffle.
BROADCAST_NODES = 500_000
#: Pairs for each holder of a crowded key that may be compared without another pivot.
FEW = 16


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; of a text of fewer words its one hash, of no words none."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space separates
    n = max(1, len(found) - size + 1) if found else 0
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(found[i : i + size]), SEED) for i in range(n)), np.uint64, n))


def _sketch(h: np.ndarray, longs: int) -> np.ndarray:
    """Bit i tells whether an odd number of a set's hashes are i modulo the number of bits.

    Two sketches of a length differ in at most as many bits as there are hashes in one of the sets alone, and half a
    sketch is its halves' XOR.
    """
    odd = np.bincount((h & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _prints(h: np.ndarray) -> np.ndarray:
    """A set's SimHash fingerprints: a bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64 * PRINTS, np.int64)
    for k in range(0, len(h), 255):  # so many fit a byte's sum
        own = h[k : k + 255, None]
        mixed = own * MIX
        g = np.concatenate((own, mixed ^ (mixed >> np.uint64(32))), axis=1)
        ones += np.unpackbits(g.astype("<u8").view(np.uint8).ravel(), bitorder="little").reshape(len(g), -1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<i8")


def _outline(h: np.ndarray, least: float, common: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a set: its own hash, its fingerprints, a short sketch, one of 2 to 4 bits for each shingle, and the prefix that
    meets that of every set of a similarity of ``least``.

    The order is by hash, ``common`` shingles last; any order that is the same for all sets would be right.
    """
    node = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))
    sketches = _prints(h), _sketch(h, SKETCH), _sketch(h, max(SKETCH, 1 << (len(h) // 32).bit_length()))
    if not len(h):
        return node, *sketches, h.view(np.int64)
    if len(common):
        last = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        h = np.concatenate((h[~last], h[last]))
    return node, *sketches, h[: len(h) - math.ceil(least * len(h) - 1e-9) + 1].view(np.int64)


def _lists(arrays: Sequence[np.ndarray]) -> pa.ListArray:
    """A column of lists, without a Python object for each member."""
    ends = np.concatenate((np.zeros(1, np.int32), np.cumsum([len(x) for x in arrays], dtype=np.int32))) if arrays else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def _common(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that many of the distinct texts in a sample hold, ascending: at most COMMON, of a sixteenth of the texts.

    They only decide the order of a set's shingles. Whatever they are, the groups are the same; the better they are, the
    fewer pairs are compared in vain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [shingles(t.as_py(), size) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).view(np.int64) if h else [], pa.int64())], ["key"])

    text = F.col("text").cast("string")
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0).groupBy(F.xxhash64("text").alias("mark")).agg(F.first("text").alias("text"))
    counts = map_batches(some.select("text"), run, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 4")
    return np.sort(counts.orderBy(F.desc("n"), "key").limit(COMMON).select("key").toArrow()["key"].to_numpy().astype(np.int64).view(np.uint64))


def outlines(docs: DataFrame, size: int, least: float) -> DataFrame:
    """(doc_id, mark, node, n, prints, sketch, wide, prefix) of each row; mark is a hash of the text, node one of its set of shingles."""
    known = docs.sparkSession.sparkContext.broadcast(_common(docs, size))
    fields = "doc_id bigint, mark bigint, node bigint, n int, prints array<bigint>, sketch array<bigint>, wide array<bigint>, prefix array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(2)]
            node, *lists = zip(*(_outline(h, least, known.value) for h in sets), strict=True) if sets else ((), (), (), (), ())
            columns = [b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(map(len, sets), pa.int32()), *map(_lists, lists)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in fields.split(", ")])

    text = F.col("text").cast("string")
    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("mark"), text.alias("text")), run, fields)


def _probed(nodes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of ``nodes(node, n, prints)`` that SimHash holds for similar, at most one for each node.

    Multi-index hashing: each fingerprint has two 32-bit segments, and sets that agree in a segment meet. Of a segment, two
    bits more than the number of nodes has are looked at, so that few meet by chance. The holders of a segment meet the least
    of them, so a crowded one costs a row for each. Then the first fingerprints' distance is verified: at a similarity of
    ``least`` a bit differs with a probability of acos(2 least / (1 + least)) / pi, and four standard deviations more are
    let through. A node keeps the nearest that it met.
    """
    prints = nodes.where("n > 0").select("node", "prints")
    mask = F.lit((1 << min(32, prints.count().bit_length() + 2)) - 1).cast("bigint")
    cut = lambda p, seg: F.shiftleft(seg.cast("bigint"), 32).bitwiseOR(p.bitwiseAND(mask))
    segments = F.flatten(F.transform("prints", lambda p, i: F.array(cut(p, 2 * i), cut(F.shiftrightunsigned(p, 32), 2 * i + 1))))
    keys = prints.select("node", F.explode(segments).alias("key"))
    first = keys.groupBy("key").agg(F.min("node").alias("to"), F.count(F.lit(1)).alias("holders")).where("holders > 1").select("key", "to")
    met = keys.join(first, "key").where("node <> to").select("node", "to").distinct()
    one = prints.select("node", F.get("prints", F.lit(0)).alias("p"))
    odds = math.acos(2 * least / (1 + least)) / math.pi
    apart = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
    near = met.join(one, "node").join(one.select(F.col("node").alias("to"), F.col("p").alias("q")), "to").where(apart <= int(64 * odds + 4 * math.sqrt(64 * odds * (1 - odds))))
    near = near.groupBy("node").agg(F.min_by("to", F.struct(apart, "to")).alias("to"))
    return near.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, h) of the texts named in ``wanted(node, of, of_mark)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(t.as_py(), size) for t in b.column(1)])], ["node", "h"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))).dropDuplicates(["node"])
    return map_batches(rows.select("node", "text"), run, "node bigint, h array<bigint>")


def _near(least: float) -> Column:
    """Whether x and y may have a similarity of ``least``, by their sizes and sketches; no pair that has it is left out."""
    n, m = F.col("x.n"), F.col("y.n")
    apart = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH)), F.lit(0))
    return (F.greatest(n, m) * least <= F.least(n, m) + 1e-9) & (apart <= (n + m) * ((1 - least) / (1 + least)) + 1e-9)


def _side(c: str) -> Column:
    return F.struct("node", "n", *[f"s{i}" for i in range(SKETCH)]).alias(c)


def _linked(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, least: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets have a similarity of ``least``; long sketches first leave out most others."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.struct("n", "wide").alias(c + "_"))
    half = lambda x: F.zip_with(F.slice(x, 1, F.floor(F.size(x) / 2).cast("int")), F.slice(x, F.floor(F.size(x) / 2).cast("int") + 1, F.size(x)), lambda p, q: p.bitwiseXOR(q))
    x, y = F.col("a_.wide"), F.col("b_.wide")  # sizes that may be similar differ by one halving at most
    x, y = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, k: t + k)
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(apart <= (F.col("a_.n") + F.col("b_.n")) * ((1 - least) / (1 + least)) + 1e-9)
    close = packed(close.select("a", "b"))
    wanted = packed(close.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node").select("node", F.col("rep.doc_id").alias("of"), F.col("rep.mark").alias("of_mark")))
    sets = packed(_sets(docs, F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted, size))
    met = close.join(sets.select(F.col("node").alias("a"), F.col("h").alias("g")), "a").join(sets.select(F.col("node").alias("b"), "h"), "b")
    common = F.size(F.array_intersect("g", "h"))
    return packed(met.where(common / (F.size("g") + F.size("h") - common) >= least).select("a", "b"))


def _crowds(crowded: DataFrame, links: DataFrame, sides: DataFrame, linked: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """(node, root) of the components that ``links`` and all links between holders of a ``crowded`` key make; the ``root``
    there tells those of some of ``links``, whose members needn't be compared.

    Each turn compares a pivot of each key with all its holders: the holder of the most crowded keys for its size, which is
    near to the most of them (later, the one of those outside of the key's largest component that was no pivot yet).
    Where the holders outside are few, or a turn hasn't halved the pairs between them and others, these meet all holders
    of other components instead, so no pair that could join two of them is left out.
    """
    roots, tried, seen, before = None, None, None, None
    while True:
        rooted = crowded if roots is None else packed(crowded.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
        largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
        rooted = packed(rooted.join(packed(largest.drop("roots")), "key"))
        outside = F.col("root") != F.col("largest")
        load = rooted.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(outside, F.col("holders")).otherwise(0)).alias("pairs")).first()
        if not load["rows"]:
            return connected_components(links) if roots is None else roots
        last = before is not None and (load["pairs"] <= FEW * load["rows"] or load["pairs"] > before / 2)
        left = rooted if before is None else rooted.where(outside)
        if not last:
            left = left if tried is None else left.join(tried, ["key", "node"], "left_anti")
            left = left.groupBy("key").agg(F.max_by(F.struct("node", "root"), F.struct("crowd", "node")).alias("t")).select("key", "t.*")
        left = packed(left.select("key", "node", "root"))
        met = left.join(sides, "node").select("key", F.col("root").alias("p"), _side("x")).join(rooted.join(sides, "node").select("key", F.col("root").alias("q"), "largest", _side("y")), "key").where("p <> q")
        met = met.where("q = largest or x.node < y.node") if last else met
        pairs = met.where(_near(least)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        pairs = packed(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"))
        links = links.unionByName(linked(pairs))
        roots = connected_components(links)
        if last:
            return roots
        before, pivots = load["pairs"], left.select("key", "node")
        tried = pivots if tried is None else tried.unionByName(pivots)
        seen = pairs if seen is None else seen.unionByName(pairs)


def groups(docs: DataFrame, size: int = 5, least: float = 0.8, bucket: int = 2) -> DataFrame:
    """(doc_id, mark, component_id) of each row: documents linked by a Jaccard similarity of ``least`` of their shingles.

    Texts with equal sets of shingles (or without words) are one node. The shingles of a set are ordered by their hash,
    those that a sample shows in many texts last; two sets of a similarity of ``least`` share one of the first
    n - ceil(least * n) + 1 in any common order, so those are the join's keys. Of the pairs that meet, sizes and parity
    sketches leave out only what can't be similar; the similarity of the others is computed from the whole sets.

    SimHash links most of them (``_probed``, verified by whole sets), but no radius that can be looked up holds all pairs of
    such a similarity. So all others meet in an exact join, where sets that SimHash has brought together aren't compared.

    The pairs of a key that over ``bucket`` nodes hold aren't listed; see ``_crowds``.
    Null doc_ids name no group unless no other row is in it.
    """
    with shuffles_dropped(docs.sparkSession):
        rows = packed(outlines(docs, size, least))
        nodes = packed(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "prints", "sketch", "wide", "prefix")], F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "mark")).alias("rep")))
        linked = lambda pairs: _linked(docs, nodes, pairs, size, least)
        links = linked(_probed(nodes, least))
        hashed = connected_components(links)
        keys = nodes.select("node", F.explode("prefix").alias("key"))
        counts = packed(keys.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"))
        held = packed(keys.join(counts, "key"))
        sides = nodes.select("node", "n", *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(SKETCH)])
        light = held.where(F.col("holders") <= bucket).select("key", "node")
        pairs = light.withColumnRenamed("node", "a").join(light.withColumnRenamed("node", "b"), "key").where("a < b").select("a", "b").distinct()
        for c in ("a", "b"):
            pairs = pairs.join(hashed.select(F.col("node").alias(c), F.col("root").alias(c + "_root")), c, "left")
        pairs = pairs.where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")
        pairs = pairs.join(sides.select(F.col("node").alias("a"), _side("x")), "a").join(sides.select(F.col("node").alias("b"), _side("y")), "b")
        links = links.unionByName(linked(packed(pairs.where(_near(least)).select("a", "b"))))
        crowds = held.where(F.col("holders") > bucket).groupBy("node").agg(F.count(F.lit(1)).alias("crowd"))
        crowds = crowds.join(nodes, "node").select("node", (F.col("crowd") / F.size("prefix")).alias("crowd"))
        crowds = packed(crowds.join(hashed, "node", "left").select("node", "crowd", F.coalesce("root", "node").alias("root")))
        crowded = packed(held.where(F.col("holders") > bucket).join(crowds, "node"))
        roots = _crowds(crowded, links, packed(sides.join(crowds.select("node"), "node")), linked, least)
        rooted = nodes.select("node", "first").join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
        least_id = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        named = packed(rooted.join(least_id, "root").select("node", "component_id"))
    return rows.select("doc_id", "mark", "node").join(named, "node").select("doc_id", "mark", "component_id")
