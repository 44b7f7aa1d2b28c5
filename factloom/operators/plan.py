"""Fetch plans: merged candidates in a total order under a byte budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Signals by priority, and what each adds to a score.
SIGNALS = ("diagnostic", "test", "truth_gap", "dirty_hunk", "caller", "callee", "type_ref", "import", "export", "docs", "declaration", "graph_distance")
WEIGHTS = {"diagnostic": 100, "test": 90, "truth_gap": 80, "dirty_hunk": 75, "caller": 65, "callee": 60, "type_ref": 55, "import": 45, "export": 40, "declaration": 35, "docs": 30, "graph_distance": 25}
# End of fixed values.


def signal_priority(c: Column) -> Column:
    out = F.lit(len(SIGNALS))
    for i, s in enumerate(SIGNALS):
        out = F.when(c == s, i).otherwise(out)
    return out


def signal_weight(c: Column) -> Column:
    out = F.lit(0)
    for k, v in WEIGHTS.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def merge(candidates: DataFrame) -> DataFrame:
    """One row for each task and address: least decision and distance; the greatest score, the weights of all its signals and 5 for each further one."""
    out = candidates.groupBy("task", "file", "start", "stop").agg(F.min("decision").alias("decision"), F.min("distance").alias("distance"), F.max("score").alias("top"), F.array_sort(F.collect_set("signal")).alias("signals"), F.min(signal_priority(F.col("signal"))).alias("priority"))
    return out.withColumn("score", F.col("top") + F.aggregate("signals", F.lit(0), lambda a, x: a + signal_weight(x)) + 5 * F.greatest(F.size("signals") - 1, F.lit(0))).drop("top")


ORDER = ("decision", "priority", "distance", "score desc", "file", "start", "stop")


def ordered(merged: DataFrame) -> DataFrame:
    keys = [F.col(k.split()[0]).desc() if k.endswith("desc") else F.col(k) for k in ORDER]
    return merged.withColumn("place", F.row_number().over(Window.partitionBy("task").orderBy(*keys)))


def within_budget(placed: DataFrame, budget: int) -> DataFrame:
    """(task, file, start, stop, place): the first candidate always, a later one if it still fits, else it is skipped.

    Skipping makes it no prefix sum: a task's candidates are folded in order (they are one task's plan, a small list).
    """
    each = F.array_sort(F.collect_list(F.struct("place", (F.col("stop") - F.col("start")).alias("size"), "file", "start", "stop")))
    d = placed.groupBy("task").agg(each.alias("all"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.filter("all", lambda x: F.lit(False)).alias("kept"))
    fits = lambda a, x: (F.size(a["kept"]) == 0) | (a["used"] + x["size"] <= budget)
    step = lambda a, x: F.when(fits(a, x), F.struct((a["used"] + x["size"]).alias("used"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a)
    return d.select("task", F.explode(F.aggregate("all", zero, step)["kept"]).alias("x")).select("task", "x.file", "x.start", "x.stop", "x.place")


def prefix_within_budget(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each group up to the first that overflows the budget; the first row always stays."""
    w = Window.partitionBy(group).orderBy(order)
    d = rows.withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    return d.where((F.col("used") <= budget) | (F.col("n") == 1)).drop("used", "n")
