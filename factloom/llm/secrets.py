"""Secrets in texts, and which of them are not widely copied."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_batches, shared

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # greedy, so the same as AKIA[A-Z0-9]+ of 20 and more
HEX = re.compile(r"[0-9a-f]{24,}")
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HINTS = ("passw", "secret", "token", "api")
EXAMPLE = re.compile(r"example|sample|test|dummy|your|changeme|placeholder|xxxx|1234|abcd", re.I | re.A)
#: A candidate of so many owners, or in so many repositories (each within its owner), is widely copied.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 4
KINDS = ("assign", "access", "hex", "live")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, candidate) of the base patterns, each kind leftmost and without overlaps."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def looks_live(token: str) -> bool:
    """Mixed characters of high entropy that don't read like an example."""
    kinds = sum(any(f(c) for c in token) for f in (str.isupper, str.islower, str.isdigit))
    if kinds < 3 or EXAMPLE.search(token):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= 3.5


def opaque_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Other tokens that look like credentials, where no base span lies.

    ``ends`` has the furthest end of the base spans up to each, so one bisection tells whether any of them reaches a token.
    """
    starts, ends = [a for a, *_ in taken], list(accumulate((b for _, _, b, _ in taken), max))
    out = []
    for m in OPAQUE.finditer(text):
        k = bisect_left(starts, m.end())
        if (k == 0 or ends[k - 1] <= m.start()) and looks_live(m[0]):
            out.append((m.start(), m.end(), m[0]))
    return out


def scan_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base (text of base spans), spans (of all), live, copied.

    Base spans come from three patterns and always stay. Besides, any opaque token that looks like a credential is a
    candidate. Candidate hashes are counted over the whole corpus by distinct repositories and owners (``source`` and
    ``lang`` within it unless given): one of WIDE_OWNERS owners or WIDE_REPOSITORIES repositories is a copied example, any
    other is live-looking. Live-looking opaque candidates are added as spans of kind ``live``; ``live`` and ``copied`` count
    the document's candidates, base ones included, of either sort.

    Only hashes are aggregated, first distinct by owner and repository, so an example that a third of all documents
    show is one row for each owner. A null owner or repository is one of its own. Null texts are empty: no spans.
    Repeated rows and null doc_ids give a row each. Spans are in code points, the end is exclusive. Other columns are
    ignored, whatever their names. Empty in, empty out.
    """
    own = F.coalesce((owner if owner is not None else F.col("source")).cast("string"), F.lit("\0"))
    repo = F.coalesce((repository if repository is not None else F.col("lang")).cast("string"), F.lit("\0"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("hash", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                found = base_spans(text)
                all_spans = [(KINDS[k], a, z, c) for a, k, z, c in found] + [("live", a, z, c) for a, z, c in opaque_spans(text, found)]
                rows.append([{"kind": k, "start": a, "stop": z, "hash": xxhash.xxh64_intdigest(c.encode(), 5) - (1 << 63)} for k, a, z, c in all_spans])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(rows, pa.list_(span))], ["doc_id", "own", "repo", "found"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), own.alias("own"), repo.alias("repo"))
    rows = map_batches(rows, run, "doc_id bigint, own string, repo string, found array<struct<kind:string,start:int,stop:int,hash:bigint>>")
    rows = shared(rows.withColumn("row", F.monotonically_increasing_id()))  # written once, so row numbers don't change
    each = rows.where(F.size("found") > 0).select("row", "own", "repo", F.explode("found").alias("s"))
    each = each.select("row", "own", "repo", "s.*")
    held = each.groupBy("hash", "own", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "own").agg(F.count(F.lit(1)).alias("repositories"))
    held = held.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    held = shared(held)  # so that the join reads both sides from exchanges, and a hot candidate's rows can be split
    judged = each.join(held, "hash").select("row", "kind", "start", "stop", ((F.col("owners") < WIDE_OWNERS) & (F.col("repositories") < WIDE_REPOSITORIES)).alias("single"))
    added = F.when((F.col("kind") == "live") & F.col("single"), F.struct("start", "kind", "stop"))
    seen = judged.groupBy("row").agg(F.collect_list(added).alias("added"), F.count_if("single").alias("live"), F.count_if(~F.col("single")).alias("copied"))
    base = F.filter("found", lambda s: s["kind"] != "live")
    joined = rows.join(seen, "row", "left").withColumn("base", base)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop"))
    write = lambda a: F.array_join(F.transform(F.array_sort(F.transform(a, order)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return joined.select("doc_id", *map(number, KINDS[:3]), write(plain).alias("base"), write(F.concat(plain, F.coalesce("added", F.array().cast("array<struct<start:int,kind:string,stop:int>>")))).alias("spans"), F.coalesce("live", F.lit(0)).alias("live"), F.coalesce("copied", F.lit(0)).alias("copied"))
