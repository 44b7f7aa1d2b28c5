"""Cutting lineage between rounds of an iterative plan."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """``df`` in the session's ``spark.checkpoint.dir``, which all machines share, read from there.

    Where that setting is unset, a temporary folder does for a session on one machine; on a cluster that is an error. A
    lost executor costs the current round. A checkpoint keeps the optimizer's estimate of its size, which joins multiply;
    over many rounds that number alone would fill the driver. So the rows come back as a plan without an estimate.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    rows = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), spark)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores: for steps that take far more time than their rows take room.

    A small file is one split, or has one row group, and so its rows are one task.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed once however often it is used afterwards.

    The optimizer merges projections and pushes filters through them, which repeats their expressions; it does neither
    through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def doubled(pointers: DataFrame, jump: Callable[[DataFrame], DataFrame], column: str) -> DataFrame:
    """``pointers`` after rounds of ``jump`` (written after each) until all pointers in ``column`` that can end are null.

    A jump doubles how far pointers reach, so a path of 2^k steps ends in k rounds, and as long as some path hasn't ended
    each round ends one. When a round ends none, those left are circles.
    """
    left = pointers.where(f"{column} is not null").count()
    while left:
        pointers = written(jump(pointers))
        before, left = left, pointers.where(f"{column} is not null").count()
        if left == before:
            break
    return pointers


def bases(sums: DataFrame, part: str, total: str, width: int = 4096) -> DataFrame:
    """(part, base) of ``sums(part, total)`` with whole numbers as parts: the sum of all parts before each.

    The running sum goes by ranges of ``width`` parts, upon the ranges' own, so one task sees a row for each range only.
    """
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    d = sums.select(part, total, F.floor(F.col(part) / width).alias("range"))
    ranges = d.groupBy("range").agg(F.sum(total).alias("all"))
    ranges = ranges.select("range", F.coalesce(F.sum("all").over(upto(Window.orderBy("range"))), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum(total).over(upto(Window.partitionBy("range").orderBy(part))), F.lit(0))
    return d.withColumn("inside", inside).join(ranges, "range").select(part, (F.col("before") + F.col("inside")).alias("base"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``place``, 1 and up in the order given: sorted by ranges, and numbered inside each upon the ranges' sizes."""
    d = written(rows.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    d = d.select("*", F.shiftright("_id", 33).alias("_run"))
    before = bases(d.groupBy("_run").agg(F.count(F.lit(1)).alias("n")), "_run", "n")
    return d.join(before, "_run").withColumn("place", F.col("base") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_id", "_run", "base")
