import math
import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

from factloom.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    at = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat = len(at)
    failed = len(w) < 50 or 100 * repeat > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed


def check(df, labels):
    got = sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df, labels).collect())
    assert got == sorted((r.doc_id or 0, *brute(r.text)) for r in df.collect())


def test_documents_as_brute_force(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))


def test_small_texts(spark):
    texts = ["a b c a b c", "a a a a", "a b c x a b c b c x", "a b", "x\nx\n \nx\ny", "##<>é b", "a b c\x0bd a\x85b c"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    check(df, spark.createDataFrame([], "doc_id bigint, quality int"))


def cdf(k, n):
    """P(X <= k) of n trials of chance 1 / 80: in fractions, or with all terms where those take too long."""
    if n < 10_000:
        return float(sum(math.comb(n, i) * Fraction(1, 80) ** i * Fraction(79, 80) ** (n - i) for i in range(k + 1)))
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.0125) + (n - i) * math.log1p(-0.0125)) for i in range(k + 1))


def test_binomial(spark):
    cases = [(k, n) for n in (1, 5, 50, 612, 5_000) for k in (0, 1, 2, n // 100, n // 3) if k <= n] + [(k, 1_200_000) for k in (14_000, 14_900, 14_999)]
    df = spark.createDataFrame(cases, "k bigint, n bigint").select("k", "n", quality.binomial_cdf(F.col("k"), F.col("n"), 0.0125).alias("p"))
    for r in df.collect():
        exact = 1 if r.k >= 0.0125 * r.n else cdf(r.k, r.n)
        assert math.isclose(r.p, exact, rel_tol=1e-7), r


def test_risk_is_held(spark):
    """Good texts keep their share in each language; a measure that no good text exceeds gets its lowest cutoff."""
    rows = [(i, " ".join(f"w{k}x{i}" + "#" * 3 * (i % 10 == 0) for k in range(60)), "en" if i % 2 else "de") for i in range(4000)]
    labels = [(i, int(i % 10 != 0)) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    kept = {r.doc_id for r in quality.judge(docs, marks).where("kept").collect()}
    assert all(i in kept for i, q in labels if q) and not any(i in kept for i, q in labels if not q)
    assert quality.judge(docs, marks.where("doc_id < 200")).where("kept").count() == 4000  # too few labels: no cutoff


def verdicts(docs, good):
    """doc_id -> kept, with all cutoffs by sums in fractions. docs (doc_id, text, lang); good: ids of good quality."""
    own, held = {}, {}
    for i, text, lang in docs:
        n, chars, symbols, dup, repeat, failed = brute(text)
        lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        m = {"symbols": symbols / max(1, chars), "repeats": repeat / max(1, n), "copied_lines": dup / max(1, lines), "word_length": chars / max(1, n)}
        own[i] = lang or "", m, failed
        if i in good and not failed:
            held.setdefault(lang or "", {})[text] = m
    limit, tests = {}, len(held) * sum(map(len, quality.CUTOFFS.values()))
    for stratum, texts in held.items():
        for k, cs in quality.CUTOFFS.items():
            for c in sorted(cs, reverse=True):
                over = sum(m[k] > c for m in texts.values())
                if over < 0.0125 * len(texts) and cdf(over, len(texts)) <= 0.05 / tests:
                    limit[stratum, k] = c
    return {i: not failed and not any(m[k] > limit.get((s, k), math.inf) for k in m) for i, (s, m, failed) in own.items()}


def test_kept_as_brute_force(spark):
    """On real labels, and on made-up texts of which many are copies: those count once."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = [(r.doc_id, r.text or "", r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    want = verdicts(rows, {r.doc_id for r in labels.collect() if r.quality == 1})
    assert {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()} == want and 0 < sum(want.values()) < len(want)
    rows = [(i, " ".join(f"w{k}x{i % 900 if i % 2 else 0}" + "#" * (i % 7 == 0) for k in range(60)), "en") for i in range(4000)]
    want = verdicts(rows, set(range(4000)))
    got = quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(4000)], "doc_id bigint, quality int"))
    assert {r.doc_id: r.kept for r in got.collect()} == want


def test_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, None)], "doc_id bigint, quality int")
    check(odd, labels)
    assert quality.judge(none, labels).count() == 0
