"""A corpus made ready for training: five stages, each over all that its predecessor kept.

In every stage null texts are empty texts, rows with a null doc_id stay (they can't be named), repeated rows are treated
alike, and columns besides doc_id and text come along as they are, whatever their names. Empty in, empty out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, decontaminate, linededup, simhash, toxicity
from factloom.llm.common import shared_folder, table
from factloom.llm.registry import ranks_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects; one without words has the score of no terms."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a later document repeats; a document of nothing else keeps its row with no text.

    Lines need only texts and ids; the other columns of ``documents`` come along as they are, n_chars anew.
    """
    return linededup.dedup_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: those that share five-word shingles to a similarity of 0.8.

    SimHash with multi-index hashing finds most links, an exact join those that it misses. Groups are closed over links, and
    documents without words are one group. What it doesn't catch: copies below 0.8, such
    as of short texts with a word changed.
    """
    return simhash.keep_one(docs, size=5, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, word for word or with other numbers, names and units."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the offsets of its pre-tokens and digests of ids and decoded bytes."""
    return bpe.tokenize(docs, ranks_path(), ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", one_of_each), ("decontamination", drop_leaks), ("bpe", encode)]

#: The toxicity model, near-duplicates and BPE can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last one stays, as the result is read from it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{top}/{name}"
    return docs
