"""Benchmark items in documents, also with other numbers, names and units."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_batches, shared

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|\w+|[.!?\n]")
UNITS = frozenset("""mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons
l ml liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur gbp dollar dollars euro
euros cent cents percent kmh mph watt watts volt volts degree degrees meter meters metre metres kilometer kilometers""".split())
PLAIN, NUMBER, CAPITAL, UNIT, STOP = range(5)
SLOTS = {NUMBER: 0x6E756D, CAPITAL: 0x6E616D65, UNIT: 0x756E6974}
FACTOR = 0x9E3779B97F4A7C15
CACHED = 100_000
#: A list of so many window hashes (8 MB) may go to every executor; a larger benchmark is joined without it.
BROADCAST_WINDOWS = 1_000_000


class Kinds(dict):
    """token -> 61 bits of the lower-cased token's hash, and its kind in 3 bits."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        kind = STOP if token in ".!?\n" else NUMBER if token[0].isdigit() else CAPITAL if low != token and token[0].isupper() else UNIT if low in UNITS else PLAIN
        if len(self) >= CACHED:
            self.clear()
        self[token] = out = (xxhash.xxh64_intdigest(low.encode(), 9) >> 3 << 3) | kind
        return out


KINDS = Kinds()


def windows(text: str | None, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: token hashes, which of them are slots, and each window's hash as a template and as it stands.

    Numbers, capitalised words inside a sentence (names) and units after a number are slots. A template with fewer
    than 3 (of 5) words that are no slots says nothing; its hash is 0.
    """
    found = TOKEN.findall(text or "")
    coded = np.fromiter(map(KINDS.__getitem__, found), np.uint64, len(found))
    kind = (coded & np.uint64(7)).astype(np.uint8)
    real = np.flatnonzero(kind != STOP)
    before = np.concatenate((np.array([STOP], np.uint8), kind[:-1]))[real]
    h, kind = coded[real] >> np.uint64(3), kind[real]
    slot = (kind == NUMBER) | ((kind == CAPITAL) & (before != STOP)) | ((kind == UNIT) & (before == NUMBER))
    template = h.copy()
    for k, v in SLOTS.items():
        template[slot & (kind == k)] = v
    n = max(0, len(h) - size + 1)
    informative = np.convolve(~slot, np.ones(size, np.int64), "valid")[:n] >= (3 * size + 4) // 5 if n else np.zeros(0, bool)
    return h, slot, np.where(informative, mix(template, size), np.uint64(0)), mix(h, size)


def mix(values: np.ndarray, size: int, start: int = 0) -> np.ndarray:
    """A hash (not 0) of each run of ``size`` values."""
    n = max(0, len(values) - size + 1)
    mixed = np.full(n, start, np.uint64)
    for j in range(size):
        mixed = (mixed ^ values[j : j + n]) * np.uint64(FACTOR)
        mixed ^= mixed >> np.uint64(29)
    return mixed | np.uint64(1)


def _explode(table: DataFrame, key: str, size: int, wanted: np.ndarray | None, items: bool, short: tuple[int, ...] = ()) -> DataFrame:
    """(key, pos, hash, h, slot, n, windows, told) of the windows, of those in ``wanted`` only if that is given.

    Each window has a row for its template, if that says something, and, where that differs, one for the words as they
    stand; n counts the templates, ``windows`` all, and ``told`` is whether the template says something. An item of
    under ``size`` tokens is one window; documents have the first window of each kind of the ``short`` sizes as well.
    """
    spark = table.sparkSession
    known = None if wanted is None else spark.sparkContext.broadcast(wanted)
    fields = "id bigint, pos int, hash bigint, h array<bigint>, slot array<boolean>, n bigint, windows bigint, told boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = None if known is None else known.value
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h, slot, template, plain = windows(t.as_py(), size)
                n = int((template != 0).sum())
                rows = [(size, template, template != 0), (size, plain, plain != template)]
                for k in (len(h),) if items and 0 < len(h) < size else () if items else short:
                    hashes = mix(h, k, k)
                    keep = np.zeros(len(hashes), bool)
                    keep[np.unique(hashes, return_index=True)[1]] = True
                    rows.append((k, hashes, keep))
                for k, hashes, keep in rows:
                    if look is not None:
                        keep[keep] = look[np.minimum(np.searchsorted(look, hashes[keep]), len(look) - 1)] == hashes[keep] if len(look) else False
                    for p in np.flatnonzero(keep).tolist():
                        row = (i, p, int(hashes[p].view(np.int64)), h[p : p + k].astype(np.int64), slot[p : p + k].tolist(), n, max(1, len(plain)), k == size and bool(template[p] != 0))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types, strict=True)], [f.split()[0] for f in fields.split(", ")])

    return map_batches(table.select(F.col(key).cast("bigint"), F.col("text").cast("string")).where(f"{key} is not null"), run, fields)


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8, agree: float = 0.5) -> DataFrame:
    """(doc_id, item_id, coverage, reparameterised): documents that hold a benchmark item, word for word or as a template.

    Texts become tokens; numbers, names and units become typed placeholders. Windows of ``size`` tokens are hashed and
    joined with the items' windows (as templates and as they stand, so letter case alone hides nothing). Matches on one
    diagonal (document position less item position) must fill the slots consistently: of the item's slots, ``agree`` at
    least must hold the document's value that is the commonest for their item's value (equal values of an item needn't
    be one parameter, so not all must). Where fewer do, windows matched as templates with a value that has several in the
    document don't count. Windows matched as they stand always count. An item is held if ``least`` of its distinct windows whose template says something are
    matched so, or if ``least`` of all its windows stand on one diagonal word for word: all of them where no template says
    anything (numbers and names alone say nothing in part), and the whole sequence of an item of under ``size`` tokens.

    The benchmark's window hashes are counted; up to BROADCAST_WINDOWS they go to the executors, so that only windows
    that match leave the scan. A larger benchmark takes the same join over all windows. A window that very many
    documents hold is a hot key of the documents' side of the join, which adaptive execution splits.

    Texts and items without tokens hold and are nothing, and rows with a null id are left out.
    Rows with equal ids count as one document or item. Other columns are ignored. Empty in, empty out.
    """
    extra = ("h", "slot", "n", "windows", "told")
    items = shared(_explode(benchmark, "item_id", size, None, True).groupBy("id", "pos", "hash").agg(*[F.first(c).alias(c) for c in extra]))
    short = tuple(sorted(r[0] for r in items.where(F.size("h") < size).select(F.size("h")).distinct().collect()))  # under ``size`` values
    wanted = None
    if items.count() <= BROADCAST_WINDOWS:
        wanted = np.unique(items.select("hash").toArrow()["hash"].to_numpy().astype(np.int64).view(np.uint64))
    found = _explode(docs, "doc_id", size, wanted, False, short).select("id", "pos", "hash", "h")
    right = items.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "hash", *[F.col(c).alias(f"item_{c}") for c in extra])
    met = found.join(right, "hash")
    # Slots of the item by place, with what stands there.
    pairs = F.transform(F.arrays_zip("item_h", "h", "item_slot"), lambda x, i: F.struct((F.col("item_pos") + i).alias("p"), x["item_h"].alias("a"), x["h"].alias("b"), x["item_slot"].alias("slot")))
    pairs = F.transform(F.filter(pairs, lambda x: x["slot"]), lambda x: F.struct(x["p"].alias("p"), x["a"].alias("a"), x["b"].alias("b")))
    exact = F.col("item_h") == F.col("h")
    met = met.where(exact | F.col("item_told")).select(F.col("id").alias("doc_id"), "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "item_n", "item_windows", F.struct(F.col("item_pos").alias("at"), exact.alias("exact"), F.col("item_told").alias("told"), pairs.alias("pairs")).alias("hit"))
    runs = met.groupBy("doc_id", "item_id", "diagonal").agg(F.collect_set("hit").alias("hits"), F.max("item_n").alias("item_n"), F.max("item_windows").alias("item_windows"))
    slots = F.array_distinct(F.flatten(F.transform(F.filter("hits", lambda x: x["told"]), lambda x: x["pairs"])))
    runs = runs.withColumn("held", F.transform(slots, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))
    values, fillings = F.array_distinct(F.transform("held", lambda x: x["a"])), F.array_distinct("held")
    several = F.size(fillings) > F.size(values)
    # How often each value of the item is filled as it mostly is.
    counted = F.transform(fillings, lambda x: F.struct(x["a"].alias("a"), F.size(F.filter("held", lambda y: y == x)).alias("n")))
    most = F.aggregate(F.transform(values, lambda a: F.array_max(F.transform(F.filter("counted", lambda x: x["a"] == a), lambda x: x["n"]))), F.lit(0), lambda t, n: t + n)
    runs = runs.withColumn("counted", F.when(several, counted))
    split = several & (most < agree * F.size("held"))
    clash = F.filter(values, lambda a: F.size(F.filter("counted", lambda x: x["a"] == a)) > 1)
    runs = runs.withColumn("clash", F.when(split, clash).otherwise(F.array().cast("array<bigint>")))
    runs = runs.withColumn("hits", F.filter("hits", lambda x: x["exact"] | ~F.arrays_overlap(F.transform(x["pairs"], lambda y: y["a"]), F.col("clash"))))
    verbatim = F.size(F.array_distinct(F.transform(F.filter("hits", lambda x: x["exact"]), lambda x: x["at"]))) / F.col("item_windows")
    runs = runs.withColumn("verbatim", verbatim)
    each = runs.select("doc_id", "item_id", "item_n", "verbatim", F.explode("hits").alias("hit"))
    other = F.exists("hit.pairs", lambda x: x["a"] != x["b"])
    held = each.groupBy("doc_id", "item_id").agg(F.count_distinct(F.when(F.col("hit.told"), F.col("hit.at"))).alias("matched"), F.max("item_n").alias("item_n"), F.max("verbatim").alias("verbatim"), F.bool_or(other).alias("reparameterised"))
    by_template = F.col("matched") / F.greatest("item_n", F.lit(1))
    coverage = F.greatest(by_template, "verbatim")
    enough = F.when(F.col("item_n") > 0, coverage >= least).otherwise(F.col("verbatim") >= 1)
    return held.where(enough).select("doc_id", "item_id", F.least(coverage, F.lit(1.0)).alias("coverage"), "reparameterised")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. Rows with a null doc_id can't be named and stay."""
    return docs.join(leaks(docs, benchmark, size, least).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
