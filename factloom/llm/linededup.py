"""Lines that several documents share stay in one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower, shared, strip


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``docs``' doc_id and text, with ``kept`` (the remaining text), ``n_lines`` and ``n_dropped``.

    Texts are split at \\n. A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at its ends and
    with A-Z in lower case. A key of at least ``least_chars`` code points that is found in at least ``least_docs``
    documents loses all its lines except those in the document with the largest doc_id that holds it.

    Only line hashes (128 bits) are shuffled: first by hash and document to count distinct documents (then by hash,
    with map-side sums, so that a line of a third of all documents is no hot spot), then to mark its occurrences.
    Texts move once, to meet the list of positions they lose.

    A null or empty text is one empty line. A null doc_id counts as one document that is less than any other.
    Rows with equal doc_id are one document; each of them keeps its own row. Columns besides doc_id and text are
    left out, so their names can't clash. Empty in, empty out.
    """
    return _dedup(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), least_chars, least_docs).drop("rest")


def dedup_documents(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``docs`` with the texts that ``dedup_lines`` keeps, n_chars (where there is such a column) counted anew.

    Columns and their order stay; every row stays, with an empty text if no line of it is left.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")])
    out = _dedup(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), rest.alias("rest")), least_chars, least_docs)
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return out.select(*[(made[c] if c in made else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def _dedup(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """``docs(doc_id, text[, rest])`` with kept, n_lines and n_dropped."""
    if "rest" not in docs.columns:
        docs = docs.withColumn("rest", F.lit(None).cast("int"))
    rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("mark", F.xxhash64("text"))
    key = ascii_lower(strip(F.col("line")))
    lines = rows.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "mark", "pos", key.alias("key")).where(F.length("key") >= least_chars)
    lines = lines.select("doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    shared_keys = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    # Written, so that the join reads both sides from exchanges and adaptive execution can split a hot line's rows.
    shared_keys = shared(shared_keys.where(F.col("n") >= least_docs).select("h1", "h2", "last"))
    drops = lines.join(shared_keys, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    drops = drops.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("drops")).select(F.col("doc_id").alias("of"), F.col("mark").alias("of_mark"), "drops")
    out = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
    split = F.split("text", "\n")
    out = out.select("doc_id", "text", "rest", split.alias("lines"), "drops")
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    kept = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get("lines", i)), "\n"))
    return out.select("doc_id", "text", "rest", kept.alias("kept"), F.size("lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("drops"), F.lit(0)).cast("bigint").alias("n_dropped"))
