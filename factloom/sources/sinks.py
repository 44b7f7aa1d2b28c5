"""Writing results: reports, JSON lines, new files, and configurations that change only if they are as expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_lines(rows: DataFrame, path: str) -> None:
    """``rows(place, line)`` as text in the order of place, replacing what is there. Parts are ranges, so they follow each other."""
    rows.repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


def write_new(rows: DataFrame, path: str) -> None:
    """As Parquet where nothing is yet; else an error, and what is there stays."""
    rows.write.mode("errorifexists").parquet(path)


def append_jsonl(rows: DataFrame, path: str, row_bytes: int = 64 << 10) -> None:
    """Rows as JSON lines added to a folder; earlier lines stay. A row over ``row_bytes`` raises before anything is written."""
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    long = lines.where(F.octet_length("value") > row_bytes)
    if not long.isEmpty():
        raise ValueError(f"a row is over {row_bytes} bytes")
    lines.write.mode("append").text(path)


def append_events(journal: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """Appends ``new(attempt, kind, data)`` (in the order of ``place``) to a journal if all steps are legal; returns the rows written.

    Sequences go on from the journal's last. One illegal step raises and nothing is written.
    """
    from factloom.operators.journal import STEPS, judged

    last = journal.agg(F.coalesce(F.max("sequence"), F.lit(-1))).scalar()
    n = F.row_number().over(Window.orderBy("place"))  # the steps of one call
    added = new.select((last + n).cast("bigint").alias("sequence"), "kind", "attempt", "data")
    every = journal.select("sequence", "kind", "attempt").unionByName(added.select("sequence", "kind", "attempt"))
    first = last + 1
    if not judged(every.where(F.col("kind").isin(*STEPS))).where((F.col("sequence") >= first) & ~F.col("accepted")).isEmpty():
        raise ValueError("invalid or duplicate step")
    added.write.mode("append").json(path)
    return added


def save_config(spark, path: str, text: str, expected: str | None) -> str:  # noqa: ANN001
    """Writes a small text if the present one has the expected SHA-256 (none: if there is none); returns the new hash.

    Through the session's own file system, to a new file that then takes the old one's place.
    """
    import hashlib

    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    now = None
    if fs.exists(file):
        now = hashlib.sha256(bytes(spark.read.format("binaryFile").load(path).first()["content"])).hexdigest()
    if now != expected:
        raise ValueError("configuration changed")
    part = jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if now is not None:
        fs.delete(file, False)
    fs.rename(part, file)
    return hashlib.sha256(text.encode()).hexdigest()
