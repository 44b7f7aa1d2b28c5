"""Connected components: of few edges in one task, of more by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, packed, shared

#: So many edges (16 bytes each) are closed in one task; more go by rounds of joins.
FEW_EDGES = 500_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, ascending, and the least node of each one's component.

    A root hooks on to the least root beside it, and paths are halved until all nodes point to roots.
    """
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    top, x, y = np.arange(len(nodes)), ends[: len(a)], ends[len(a) :]
    while len(x):
        p, q = top[x], top[y]
        np.minimum.at(top, np.maximum(p, q), np.minimum(p, q))
        while (top != (up := top[top])).any():
            top = up
        apart = top[x] != top[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[top]


def _closed(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges, in one task: a written file instead of rounds of shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        ends = (np.concatenate([np.asarray(b.column(i)) for b in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _roots(*ends)], ["node", "root"])

    bound_batches(edges.sparkSession)
    return shared(edges.coalesce(1).mapInArrow(run, "node bigint, root bigint"))


def connected_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, both bigint; the root is the component's least node.

    The distinct edges are counted; up to ``few`` of them are closed in one task, more by rounds.

    Each round is two aggregations (with map-side combine) and two joins that adaptive execution can split;
    no star is ever gathered in one row. Rounds are logarithmic in the longest path. The edges are written
    to the checkpoint folder after each round, so a lost executor costs one round at most.
    Null ends and loops are ignored; an empty input gives an empty result.
    """
    e = packed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    if e.count() <= few:
        return _closed(e)
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == tuple(now) or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = tuple(now)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # Large star: every greater neighbour of u points to the least of u's neighbourhood.
        large = e.join(least, e.b == least.u).select(e.a, F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # Small star: every lesser neighbour of a, and a itself, points to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = shared(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
