"""The code graph: nodes(node_id, kind, name), edges(kind, seq, src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.stages import bases, doubled, written


def adjacency(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    """Neighbours by direction: ``node`` is src (outgoing) or dst (incoming)."""
    other = "dst" if node == "src" else "src"
    out = edges.where(F.col("kind") == kind) if kind else edges
    return out.select(F.col(node).alias("node_id"), "kind", F.col(other).alias("neighbour"), "seq")


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def offsets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, offset, degree): where a node's neighbours start if edges are stored by node.

    The running sum goes by node ranges (sums of ranges first, then inside each), so no task sees all nodes.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    d = nodes.join(degree, nodes.node_id == degree.src, "left").select("node_id", F.coalesce("degree", F.lit(0)).alias("degree")).withColumn("part", F.expr("node_id div 4096"))
    sums = bases(d.groupBy("part").agg(F.sum("degree").alias("total")), "part", "total")
    inside = F.sum("degree").over(Window.partitionBy("part").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, "part").select("node_id", (F.col("base") + F.col("inside")).alias("offset"), "degree")


def mirror_slots(out_edges: DataFrame, in_edges: DataFrame) -> DataFrame:
    """(kind, src, dst, out_slot, in_slot): parallel edges pair by their rank among equal ends."""
    rank = lambda t, s: t.select("kind", "src", "dst", F.col("slot").alias(s), F.row_number().over(Window.partitionBy("kind", "src", "dst").orderBy("slot")).alias("rank"))
    return rank(out_edges, "out_slot").join(rank(in_edges, "in_slot"), ["kind", "src", "dst", "rank"]).drop("rank")


def mirror_violations(out_edges: DataFrame, in_edges: DataFrame) -> DataFrame:
    """Pairs that one of the two copies holds more often, with the surplus."""
    count = lambda t, s: t.select("kind", "src", "dst", F.lit(s).alias("s"))
    both = count(out_edges, 1).unionByName(count(in_edges, -1))
    return both.groupBy("kind", "src", "dst").agg(F.sum("s").alias("surplus")).where("surplus <> 0")


def file_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, file_id): the enclosing file by first parents; null for a circle or an orphan.

    Pointers are doubled: each round maps a node to its parent's pointer, so paths of length 2^k take k rounds.
    """
    parent = edges.where("kind = 'contains'").groupBy("dst").agg(F.min_by("src", "seq").alias("up"))
    is_file = F.col("kind") == "file"
    n = nodes.join(parent, nodes.node_id == parent.dst, "left").select("node_id", F.when(is_file, F.col("node_id")).alias("file_id"), F.when(~is_file, F.col("up")).alias("up"))

    def jump(n: DataFrame) -> DataFrame:
        above = n.select(F.col("node_id").alias("x"), F.col("file_id").alias("x_file"), F.col("up").alias("x_up"))
        return n.join(above, n.up == above.x, "left").select("node_id", F.coalesce("file_id", "x_file").alias("file_id"), F.col("x_up").alias("up"))

    return doubled(written(n), jump, "up").select("node_id", "file_id")


def uses(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("calls", "extends", "implements", "type_ref", "value_ref")) -> DataFrame:
    """Who uses a declaration: (node_id, name, kind, user_id, user_name); loops are dropped."""
    e = edges.where(F.col("kind").isin(*kinds) & (F.col("src") != F.col("dst")))
    a, b = nodes.select(F.col("node_id").alias("dst"), "name"), nodes.select(F.col("node_id").alias("src"), F.col("name").alias("user_name"))
    return e.join(a, "dst").join(b, "src").select(F.col("dst").alias("node_id"), "name", "kind", F.col("src").alias("user_id"), "user_name")


def relationships(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """(node_id, direction, kind, other_name, place, omitted): the first ``most`` distinct neighbour names of a node, and how many more there are."""
    name = nodes.select(F.col("node_id").alias("other"), F.col("name").alias("other_name"))
    both = edges.select(F.col("src").alias("node_id"), F.lit("out").alias("direction"), "kind", F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node_id"), F.lit("in").alias("direction"), "kind", F.col("src").alias("other")))
    d = both.join(name, "other").select("node_id", "direction", "kind", "other_name").distinct()
    w = Window.partitionBy("node_id").orderBy("direction", "kind", "other_name")
    total = F.count(F.lit(1)).over(Window.partitionBy("node_id"))
    placed = d.withColumn("place", F.row_number().over(w)).withColumn("omitted", F.greatest(total - most, F.lit(0)))
    return placed.where(F.col("place") <= most)


def unique_names(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the value if the key was inserted once, else null."""
    return rows.groupBy(key).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias(value))


def intern(rows: DataFrame, column: str, order: str) -> DataFrame:
    """(string, id): dense ids in the order of first appearance (``order`` is a whole number).

    Numbered inside ranges of ``order``, upon the running sum of the ranges' sizes: no task sees all strings.
    """
    first = rows.groupBy(column).agg(F.min(order).cast("bigint").alias("first")).withColumn("part", F.expr("first div 4096"))
    sizes = first.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    base = bases(sizes, "part", "n")
    place = F.row_number().over(Window.partitionBy("part").orderBy("first", column))
    return first.withColumn("place", place).join(base, "part").select(F.col(column).alias("string"), (F.col("base") + F.col("place") - 1).alias("id"))


def name_census(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, n): how many declarations that something contains have each name."""
    inside = edges.where("kind = 'contains'").select(F.col("dst").alias("node_id")).distinct()
    return nodes.join(inside, "node_id", "left_semi").groupBy("name").agg(F.count_distinct("node_id").alias("n"))


def edges_into(edges: DataFrame, targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, kind, n): edges into ``targets(node_id)`` (those that couldn't be resolved, say) by the name of their source."""
    met = edges.join(targets.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return met.join(nodes.select(F.col("node_id").alias("src"), F.col("name").alias("file")), "src").groupBy("file", "kind").agg(F.count(F.lit(1)).alias("n"))
