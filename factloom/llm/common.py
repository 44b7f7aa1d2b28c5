"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and tab to carriage return.
WS = " \t\n\x0b\x0c\r"
WS_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def bound_batches(spark: SparkSession) -> None:
    """Lets an Arrow batch have 4 MB (and one row more at most), unless the session's own setting differs from Spark's 64 MB.

    Plans run later, so the setting stays. It bounds bytes: rows of any length fit a Python worker beside the JVM.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "4194304b")


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of few bytes and rows, so that what is made of one stays small."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: run(few(batches)), schema)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all machines share.

    Where it is unset, a temporary folder does for a session on one machine; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def shared(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, with its lineage cut.

    A checkpoint keeps the optimizer's estimate of its size, which joins multiply; over some rounds of an iteration that
    number alone would fill the driver. So the rows come back as a plan without an estimate.
    """
    spark = df.sparkSession
    shared_folder(spark)
    rows = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), spark)


#: Bytes of a written table that a task reads, at least.
PART = 2 << 20


def packed(df: DataFrame) -> DataFrame:
    """``shared(df)``, read by no more tasks than its bytes need, but by as many as the session has cores.

    Each task that reads costs files of its own in every shuffle behind it, so many almost empty ones cost more than the rows.
    """
    out = shared(df)
    spark = out.sparkSession
    rdd = out._jdf.queryExecution().analyzed().rdd()
    while rdd.getCheckpointFile().isEmpty() and not rdd.dependencies().isEmpty():
        rdd = rdd.dependencies().head().rdd()
    if rdd.getCheckpointFile().isEmpty():
        return out
    path = spark._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return out.coalesce(max(spark.sparkContext.defaultParallelism, -(-size // PART)))


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Frames made inside drop their shuffle files as soon as they have run, rather than when the driver collects garbage.

    For frames that run once: what is used again is written by ``shared``.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ascii_lower(c: Column) -> Column:
    """Only A-Z in lower case. Pure ASCII takes the fast built-in, the rest a translation."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def words(c: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), WS_CLASS + "+"), "")
