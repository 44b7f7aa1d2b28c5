"""Content-addressed source archives, and checks of a columnar graph's tables. Violations are rows; a sound table has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.stages import bases


def build(files: DataFrame) -> DataFrame:
    """(sha256, offset, length, content) of ``files(content)``: each content once, by hash, with its place in the archive.

    Offsets are running sums inside each of 65536 ranges of hashes, upon the ranges' own running sums: no task sees all.
    """
    c = F.col("content").cast("binary")
    blobs = files.select(F.sha2(c, 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("length"), c.alias("content")).dropDuplicates(["sha256"])
    blobs = blobs.withColumn("part", F.conv(F.substring("sha256", 1, 4), 16, 10).cast("int"))
    before = bases(blobs.groupBy("part").agg(F.sum("length").alias("total")), "part", "total", 256)
    inside = F.sum("length").over(Window.partitionBy("part").orderBy("sha256").rowsBetween(Window.unboundedPreceding, -1))
    return blobs.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, "part").select("sha256", (F.col("base") + F.col("inside")).alias("offset"), "length", "content")


def corrupt(blobs: DataFrame) -> DataFrame:
    """Blobs whose content has another hash or length than they say."""
    return blobs.where((F.sha2("content", 256) != F.col("sha256")) | (F.octet_length("content") != F.col("length"))).select("sha256")


def unpaired(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(file_id, problem) of ``files(file_id, sha256, length)`` without their blob: no_hash, missing or length."""
    b = blobs.select(F.col("sha256").alias("h"), F.col("length").alias("n"))
    problem = F.when(F.col("sha256").isNull(), "no_hash").when(F.col("h").isNull(), "missing").when(F.col("n") != F.col("length"), "length")
    return files.join(b, files.sha256 == b.h, "left").select("file_id", problem.alias("problem")).where("problem is not null")


def offset_violations(offsets: DataFrame, targets: int) -> DataFrame:
    """(node_id, problem) of ``offsets(node_id, offset)`` that don't start at 0, fall, or don't end at ``targets``.

    A node is compared with the one before it by an equi join of neighbouring ids, without a window over all.
    """
    before = offsets.select((F.col("node_id") + 1).alias("node_id"), F.col("offset").alias("before"))
    last = offsets.agg(F.max("node_id").alias("last"))
    d = offsets.join(before, "node_id", "left").withColumn("last", last.scalar())
    problem = F.when((F.col("node_id") == 0) & (F.col("offset") != 0), "start").when(F.col("offset") < F.col("before"), "falls").when((F.col("node_id") == F.col("last")) & (F.col("offset") != targets), "end")
    return d.select("node_id", problem.alias("problem")).where("problem is not null")


def span_violations(spans: DataFrame, files: DataFrame) -> DataFrame:
    """(id, problem) of ``spans(id, file_id, start, length, present)``: a half null, an absent one with values, overflow, beyond the file."""
    f = files.select(F.col("file_id").alias("f"), F.col("length").alias("size"))
    s, n = F.col("start"), F.col("length")
    problem = (
        F.when(~F.col("present") & ((F.coalesce(s, F.lit(0)) != 0) | (F.coalesce(n, F.lit(0)) != 0)), "absent_with_value").when(~F.col("present"), None).when(s.isNull() | n.isNull(), "half_null")
        .when((s < 0) | (n < 0) | (s + n > 4294967295), "overflow").when(F.col("size").isNull(), "no_file").when(s + n > F.col("size"), "beyond_file")
    )
    return spans.join(f, spans.file_id == f.f, "left").select("id", problem.alias("problem")).where("problem is not null")


def metadata_violations(metadata: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, problem) where file nodes and ``metadata(node_id)`` don't pair: missing, not_a_file or repeated."""
    n = metadata.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    files = nodes.where("kind = 'file'").select(F.col("node_id").alias("f"))
    d = n.join(files, n.node_id == files.f, "full_outer")
    problem = F.when(F.col("node_id").isNull(), "missing").when(F.col("f").isNull(), "not_a_file").when(F.col("n") > 1, "repeated")
    return d.select(F.coalesce("node_id", "f").alias("node_id"), problem.alias("problem")).where("problem is not null")


def edge_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seq, problem) of ``edges(seq, kind, src, dst, label, position, anchors)``: ends that aren't nodes, attributes that the kind may not have."""
    ids = nodes.select(F.col("node_id").alias("id"))
    bad = edges.select("seq", F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_anti").select("seq", F.lit("no_node").alias("problem"))
    k = F.col("kind")
    problem = F.when(F.col("label").isNotNull() & ~k.isin("imports", "exports"), "label").when(F.col("position").isNotNull() & (k != "type_ref"), "position").when(F.col("anchors").isNotNull() & (k != "calls"), "anchors")
    return bad.distinct().unionByName(edges.select("seq", problem.alias("problem")).where("problem is not null"))
