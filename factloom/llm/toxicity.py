"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bound_batches, map_batches, shared

BUCKETS = 1 << 20
WORD = re.compile(r"[^\W\d_]+")
#: Beginnings of words that are terms (inflected forms share those), and the model's limits: terms in use, texts that
#: must hold one, and standard errors by which its presence must differ between the labels.
BEGINNINGS = (3, 4, 5, 6)
FEATURES, LEAST_TEXTS, LEAST_ERRORS = 4096, 3, 2.5
CACHED = 50_000


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def buckets(word: str) -> list[int]:
    """Hash buckets of a word and of its beginnings."""
    digest = xxhash.xxh32_intdigest
    return [digest(word) & (BUCKETS - 1), *[digest("^" + word[:n]) & (BUCKETS - 1) for n in BEGINNINGS if n < len(word)]]


def terms(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's words, ascending."""
    return np.unique(np.fromiter((b for w in words(text) for b in buckets(w)), np.int32))


@dataclass
class Model:
    """bias + sum of w over a text's terms + the products of their factors, as a probability."""

    used: np.ndarray  # buckets in use, ascending
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """Of each text. A word's terms are looked up once in a process, while the model is the same."""
        at = {b: i for i, b in enumerate(self.used.tolist())}
        if _KNOWN["model"] != (key := self.used.tobytes()):
            _KNOWN.update(model=key, words={})
        known: dict[str, tuple[int, ...]] = _KNOWN["words"]
        own, lengths = [], []
        for t in texts:
            found: set[int] = set()
            for w in words(t):
                if (terms_ := known.get(w)) is None:
                    if len(known) >= CACHED:
                        known.clear()
                    known[w] = terms_ = tuple([at[b] for b in buckets(w) if b in at])
                found.update(terms_)
            own += sorted(found)
            lengths.append(len(found))
        of, own = np.repeat(np.arange(len(lengths)), lengths), np.array(own, np.int64)
        s = np.zeros((len(lengths), self.v.shape[1]))
        np.add.at(s, of, self.v[own])
        squares = np.bincount(of, weights=(self.v[own] ** 2).sum(1), minlength=len(lengths))
        z = self.bias + np.bincount(of, weights=self.w[own], minlength=len(lengths)) + 0.5 * ((s * s).sum(1) - squares)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


#: What a process knows of words, for the model that it scored with last.
_KNOWN: dict = {"model": None, "words": {}}


def choose(bucket: np.ndarray, df: np.ndarray, df_pos: np.ndarray, pos: float, n: int) -> np.ndarray:
    """The buckets in use, ascending, of all that ``df`` texts hold and ``df_pos`` of the ``pos`` toxic ones among ``n``.

    Those whose presence differs most between the labels: FEATURES at most, in LEAST_TEXTS texts at least, and by
    LEAST_ERRORS standard errors: all others are noise for a long text.
    """
    rate, share = pos / n, (df + 1) / (n + 2)
    z = np.abs(df_pos - df * rate) / np.sqrt(np.maximum(n * share * (1 - share) * rate * (1 - rate), 0.5))
    z[df < LEAST_TEXTS] = 0
    best = np.lexsort((bucket, -z))[:FEATURES]
    return np.sort(bucket[best[z[best] >= LEAST_ERRORS]]).astype(np.int32)


def fit(used: np.ndarray, own: list[np.ndarray], toxic: np.ndarray, rank: int = 8, epochs: int = 15, seed: int = 7) -> Model:
    """A factorization machine for texts given by the places of their terms in ``used``: Adagrad on the logistic loss, with L2."""
    y = toxic.astype(np.float64)
    pos, n = y.sum(), max(len(y), 1)
    rate = min(max(pos / n, 1e-3), 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(used)), rng.normal(0, 0.05, (len(used), rank))
    if not len(used) or pos in (0, n):
        return Model(used, bias, w, v * 0)
    gw, gv, gb = np.full(len(used), 1e-6), np.full((len(used), rank), 1e-6), 1e-6
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(own)), max(1, len(own) // 64)):
            lengths = np.fromiter((len(own[i]) for i in part), np.int64, len(part))
            at, of = np.concatenate([own[i] for i in part]), np.repeat(np.arange(len(part)), lengths)
            s = np.zeros((len(part), rank))
            np.add.at(s, of, v[at])
            squares = np.bincount(of, weights=(v[at] ** 2).sum(1), minlength=len(part))
            z = bias + np.bincount(of, weights=w[at], minlength=len(part)) + 0.5 * ((s * s).sum(1) - squares)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            db, dw, dv = e.sum(), np.bincount(at, weights=e[of], minlength=len(used)), np.zeros_like(v)
            np.add.at(dv, at, e[of, None] * (s[of] - v[at]))
            touched = np.unique(at)
            dw[touched] += 1e-5 * w[touched]
            dv[touched] += 1e-4 * v[touched]
            gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
            bias -= 0.2 * db / np.sqrt(gb)
            w -= 0.2 * dw / np.sqrt(gw)
            v -= 0.05 * dv / np.sqrt(gv)
    return Model(used, float(bias), w, v)


def fit_terms(rows: list[np.ndarray], toxic: np.ndarray, **more: int) -> Model:
    """``choose`` and ``fit`` for texts given by their terms, in one process."""
    pos, n = float(toxic.sum()), len(rows)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    df = np.bincount(flat, minlength=1)
    df_pos = np.bincount(flat, weights=np.repeat(toxic.astype(float), [len(r) for r in rows]), minlength=1)
    bucket = np.flatnonzero(df)
    used = choose(bucket, df[bucket].astype(float), df_pos[bucket], pos, n) if n else np.zeros(0, np.int32)
    return fit(used, [np.searchsorted(used, r[np.isin(r, used, assume_unique=True)]) for r in rows], toxic, **more)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = 16_384) -> Model:
    """The model of at most ``sample`` labelled documents (those of the least hash of their id), none held out.

    Their list has a fixed bound, so it is broadcast; of an id with several texts the greatest counts. The terms are
    written to the shared folder. To the driver come two sums for each bucket that LEAST_TEXTS texts hold (BUCKETS at
    most) and the texts' terms in use (FEATURES numbers of 2 bytes each at most), whatever the texts' lengths.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([terms(t.as_py()) for t in b.column(2)], pa.list_(pa.int32()))], ["doc_id", "y", "terms"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    rows = shared(map_batches(rows, run, "doc_id bigint, y int, terms array<int>").withColumn("y", (F.col("y") > 0).cast("int")))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos")).first()
    n, pos = total["n"], float(total["pos"] or 0)
    if pos in (0, n):
        return fit(np.zeros(0, np.int32), [], np.full(max(n, 1), pos > 0)) if n else fit(np.zeros(0, np.int32), [], np.zeros(0))
    sums = rows.select("y", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("df_pos")).where(F.col("df") >= LEAST_TEXTS).toArrow().sort_by("bucket")
    used = choose(sums["bucket"].to_numpy(), sums["df"].to_numpy().astype(float), sums["df_pos"].to_numpy().astype(float), pos, n)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.array(t.as_py(), np.int32) for t in b.column(2)]
            own = [np.searchsorted(used, t[np.isin(t, used, assume_unique=True)]).astype("<i2").tobytes() for t in own]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.binary())], ["doc_id", "y", "own"])

    got = map_batches(rows, places, "doc_id bigint, y int, own binary").toArrow().sort_by("doc_id")
    return fit(used, [np.frombuffer(x, "<i2").astype(np.int64) for x in got["own"].to_pylist()], got["y"].to_numpy() > 0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row. See ``toxicity`` for odd input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.scores(t.as_py() for t in b.column(2)), pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id bigint, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = 16_384) -> DataFrame:
    """Scores every document with a model trained on labelled ones; ids, languages and sources are no inputs.

    A null, empty or wordless text gets the score of no terms at all. A null doc_id is not held out and is not
    learned from. Repeated rows are scored alike; repeated labels count as toxic if one of them says so; null labels
    are left out. Without labels, or with labels of one kind, every score is the (bounded) share of toxic labels.
    Other columns are ignored. Empty in, empty out.
    """
    return score(docs, train(docs, labels, sample))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = 16_384) -> DataFrame:
    """``docs`` without the rows that the model calls toxic. Texts are scored where they are: no shuffle."""
    model = train(docs, labels, sample)
    bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def toxic(texts):  # noqa: ANN001, ANN202
        return pd.Series(np.concatenate([model.scores(texts.iloc[k : k + 256]) for k in range(0, len(texts), 256)]) if len(texts) else np.zeros(0))

    return docs.where(toxic(F.col("text").cast("string")) < 0.5)
