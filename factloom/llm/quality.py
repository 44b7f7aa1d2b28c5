"""Quality rules whose cutoffs are chosen under a bound on false rejections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import shared, strip, words

#: Candidate cutoffs of each measure; a text above the cutoff is rejected.
CUTOFFS = {
    "symbols": (0.01, 0.02, 0.03, 0.05, 0.1, 0.2, 0.3),
    "repeats": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
    "copied_lines": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5),
    "word_length": (8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0),
}


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, mark, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), within each row alone.

    ``mark`` is a hash of the text. Windows of 3 words are compared by 64-bit hash; positions are found by sorting, so a text of n words costs n log n.
    """
    d = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("doc_id", "lang", "text", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w"))
    third = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    lines = F.filter(F.split("text", "\n"), lambda x: strip(x) != "")
    d = d.select("doc_id", "lang", "text", "mark", "w", F.when(F.size("w") >= 3, third).otherwise(F.array().cast("array<bigint>")).alias("h"), lines.alias("lines"))
    d = d.select(
        "doc_id", "lang", "mark", F.size("w").cast("bigint").alias("n_words"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"), F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("s"),
    )
    same = lambda x, i, j: F.coalesce(F.get("s", i + j)["x"] == x["x"], F.lit(False))
    twice = F.transform(F.filter("s", lambda x, i: same(x, i, 1) | F.when(i > 0, same(x, i, -1)).otherwise(F.lit(False))), lambda x: x["i"])
    d = d.withColumn("at", F.array_sort(twice)).drop("s")
    covered = F.aggregate(F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("at")


def log_factorial(n: Column) -> Column:
    """Exact to 20, then Stirling's series (its error is under 1e-12 there)."""
    x = F.greatest(n, F.lit(1)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(F.greatest(n, F.lit(0)), F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials with chance p, for k below n p (else 1).

    Terms are summed downwards from k. The term j below is at most exp(-j (j - 1) / (2 n p)) of the first, so those after
    10 sqrt(n p) + 2 are under 1e-21 of it: no double can tell whether they were added.
    """
    top = F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    ratio = lambda i: i * (1 - p) / ((n - i + 1) * p)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    lowest = F.greatest(k - (F.ceil(10 * F.sqrt(n * p)) + 2), F.lit(1))
    steps = F.when((k > 0) & (k < n * p), F.sequence(k, lowest, F.lit(-1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    summed = F.aggregate(steps, start, lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["total"] + a["term"] * ratio(i)).alias("total")))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * summed["total"]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbols": per("n_symbols", "word_chars"), "repeats": per("n_repeat_words", "n_words"), "copied_lines": per("n_dup_lines", "n_lines"), "word_length": per("word_chars", "n_words")}


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """(stratum, measure, cutoff, n, rejected, p_value): the chosen cutoffs, at most one for each stratum and measure.

    The holdout is every labelled document of good quality that passes the base rules. Equal texts of a stratum count once,
    as they are no independent trials. A cutoff is admissible if so few
    of a stratum's good documents exceed it that, were its true rate of false rejections ``risk`` divided by the number
    of measures or more, the exact binomial chance of so few is at most ``error`` divided by the number of all tests
    (Bonferroni, over strata, measures and cutoffs). Then, with probability 1 - ``error``, every stratum loses less than
    ``risk`` of its good documents. Of the admissible cutoffs the lowest is taken; where none is, the rule is off.
    """
    good = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("q")).where("id is not null and q is not null").groupBy("id").agg(F.min("q").alias("q")).where("q = 1")
    held = rows.where(~base_failed()).join(good, F.col("doc_id") == F.col("id")).select(F.coalesce("lang", F.lit("")).alias("stratum"), "mark", *[c.alias(k) for k, c in measures().items()])
    held = held.groupBy("stratum", "mark").agg(*[F.first(k).alias(k) for k in CUTOFFS])
    tests = [F.struct(F.lit(k).alias("measure"), F.lit(c).alias("cutoff"), (F.col(k) > c).cast("bigint").alias("over")) for k, cs in CUTOFFS.items() for c in cs]
    counts = held.select("stratum", F.explode(F.array(*tests)).alias("t")).groupBy("stratum", "t.measure", "t.cutoff").agg(F.count(F.lit(1)).alias("n"), F.sum("t.over").alias("rejected"))
    counts = shared(counts)
    tried = max(1, counts.count())
    judged = counts.withColumn("p_value", binomial_cdf(F.col("rejected"), F.col("n"), risk / len(CUTOFFS))).where(F.col("p_value") <= error / tried)
    first = judged.groupBy("stratum", "measure").agg(F.min_by(F.struct("cutoff", "n", "rejected", "p_value"), "cutoff").alias("t"))
    return first.select("stratum", "measure", "t.*")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """``features`` of each document with base_failed and kept.

    A document is kept if it passes the base rules and exceeds none of its stratum's (language's) cutoffs. Features are
    computed once and written; the cutoffs (one row for each stratum, four columns) are joined to them.

    A null text has no words and fails the base rules. A null language is a stratum of its own (with the empty one);
    a stratum without enough labels has no cutoffs, so only the base rules hold there. Null or contradicting labels:
    the worse counts. Repeated rows and null doc_ids give a row each. Other columns are ignored. Empty in, empty out.
    """
    rows = shared(features(docs))
    found = cutoffs(rows, labels, risk, error).groupBy("stratum").pivot("measure", list(CUTOFFS)).agg(F.min("cutoff"))
    found = found.select(F.col("stratum"), *[F.col(k).alias(f"most_{k}") for k in CUTOFFS])
    joined = rows.withColumn("stratum", F.coalesce("lang", F.lit(""))).join(found, "stratum", "left")
    over = F.lit(False)
    for k, c in measures().items():
        over = over | F.coalesce(c > F.col(f"most_{k}"), F.lit(False))
    return joined.select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept"))
