"""Byte-level BPE without a regex: boundaries by scans over transition functions, merges by cache."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import map_batches

#: Code point classes. STMD are the one-letter endings after an apostrophe; R, V, E and two Ls form the others.
LETTER, STMD, R, V, ELL, E, NUMBER, OTHER, APOSTROPHE, SPACE, BLANK, RESET = range(12)
#: States: what the character before belongs to. QUOTE is an apostrophe that starts a token; QR, QV and QL
#: follow it with a letter that may become an ending; ENDED is after a complete ending.
START, IN_LETTERS, IN_NUMBER, IN_OTHER, QUOTE, QR, QV, QL, ENDED, AFTER_SPACE, AFTER_BLANK = range(11)
STOP = 0x110000  # stands between the texts of a batch
BLOCK = 128
CACHED, BATCH_CHARS = 160_000, 1_000_000


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(STOP + 1, OTHER, np.uint8)
    for c in range(STOP):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = LETTER if kind == "L" else NUMBER
    for c in (9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = BLANK
    for chars, k in (("stmd", STMD), ("r", R), ("v", V), ("l", ELL), ("e", E), ("'", APOSTROPHE), (" ", SPACE)):
        for c in chars:
            out[ord(c)] = k
    out[STOP] = RESET
    return out


def step(state: int, kind: int) -> int:
    if kind <= E:
        if state == QUOTE:
            return {STMD: ENDED, R: QR, V: QV, ELL: QL}.get(kind, IN_LETTERS)
        return ENDED if (state, kind) in ((QR, E), (QV, E), (QL, ELL)) else IN_LETTERS
    if kind == APOSTROPHE:
        return IN_OTHER if state in (IN_OTHER, QUOTE, AFTER_SPACE) else QUOTE
    return {NUMBER: IN_NUMBER, OTHER: IN_OTHER, SPACE: AFTER_SPACE, BLANK: AFTER_BLANK, RESET: START}[kind]


@cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The transition functions that strings of classes can have: the class's own, products, and values by state."""
    own = [tuple(step(s, k) for s in range(11)) for k in range(12)]
    ids = {tuple(range(11)): 0}
    todo = [tuple(range(11))]
    for f in todo:
        for g in own:
            if (h := tuple(g[x] for x in f)) not in ids:
                ids[h] = len(ids)
                todo.append(h)
    values = np.array(todo, np.uint8)
    index = np.array([ids[f] for f in own], np.int16)
    product = np.array([[ids[tuple(values[b][values[a]].tolist())] for b in range(len(todo))] for a in range(len(todo))], np.int16)
    return index, product.ravel(), values


def scan(f: np.ndarray) -> np.ndarray:
    """Products of all prefixes. As the product is associative, blocks are scanned side by side, then their totals."""
    _, product, values = monoid()
    n, size = len(f), len(values)
    if n == 0:
        return f
    blocks = -(-n // BLOCK)
    cols = np.zeros((blocks, BLOCK), np.int16)
    cols.ravel()[:n] = f
    cols = np.ascontiguousarray(cols.T)
    for j in range(1, BLOCK):
        cols[j] = product[cols[j - 1].astype(np.int32) * size + cols[j]]
    if blocks > 1:
        before = np.concatenate((np.zeros(1, np.int16), scan(cols[-1].copy())[:-1]))
        cols = product[before.astype(np.int32)[None, :] * size + cols]
    return np.ascontiguousarray(cols.T).ravel()[:n]


def starts(codes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in code points that STOPs divide; the STOPs count as starts too."""
    index, _, values = monoid()
    kind = classes()[codes]
    after = values[:, START][scan(index[kind])]
    before = np.concatenate((np.array([START], np.uint8), after[:-1]))
    following = np.concatenate((kind[1:], np.array([RESET], np.uint8)))
    letter, blank = kind <= E, (kind == SPACE) | (kind == BLANK)
    spaced = (before == AFTER_SPACE) | (before == AFTER_BLANK)
    ends_run = (following != SPACE) & (following != BLANK) & (following != RESET)
    out = kind == RESET
    out |= blank & (~spaced | ends_run)
    out |= (kind == NUMBER) & (before != IN_NUMBER) & (before != AFTER_SPACE)
    out |= ((kind == OTHER) | (kind == APOSTROPHE)) & (before != IN_OTHER) & (before != QUOTE) & (before != AFTER_SPACE)
    out |= letter & np.isin(before, (START, IN_NUMBER, IN_OTHER, AFTER_BLANK, ENDED))
    out |= letter & (before == QUOTE) & (after == IN_LETTERS)
    # An apostrophe with r, v or l that doesn't become an ending: the letter starts a token after all.
    out |= ((after == QR) | (after == QV)) & (following != E)
    out |= (after == QL) & (following != ELL)
    return np.flatnonzero(out)


class Codec:
    """Encodes and decodes by a rank file. Merged pieces are cached in two generations of ``CACHED`` at most."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.decimal = {v: str(v) for v in self.tokens}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ranks after merging, again and again, the pair of least rank, the leftmost first."""
        ranks = self.ranks
        if (r := ranks.get(piece)) is not None:
            return (r,)
        if len(piece) > 60:
            return self.merge_long(piece)
        get = ranks.get
        cuts = list(range(len(piece) + 1))
        pairs = [get(piece[i : i + 2], STOP) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < STOP:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(piece[cuts[i] : cuts[i + 2]], STOP)
            if i:
                pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], STOP)
        return tuple([ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])])  # noqa: B905

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap, in n log n."""
        ranks = self.ranks
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        right, left = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, width = heapq.heappop(heap)
            a, j = parts[i], right[i]
            if a is None or j >= len(parts) or len(a) + len(parts[j]) != width:  # type: ignore[arg-type]
                continue  # one of the two has been merged meanwhile
            if ranks[both := a + parts[j]] != rank:  # type: ignore[operator]
                continue
            parts[i], parts[j] = both, None
            right[i] = k = right[j]
            if k < len(parts):
                left[k] = i
            for x, y in ((left[i], i), (i, k)):
                if x >= 0 and y < len(parts) and (r := ranks.get(both := parts[x] + parts[y])) is not None:  # type: ignore[operator]
                    heapq.heappush(heap, (r, x, len(both)))
        return tuple(ranks[p] for p in parts if p is not None)

    def miss(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece) or self.merge(piece.encode())
        if len(piece) <= 64:
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def look_up(self, pieces: list[str]) -> list[tuple[int, ...]]:
        miss, out = self.miss, []
        for at in range(0, len(pieces), 4096):
            get = self.young.get
            out += [get(p) or miss(p) for p in pieces[at : at + 4096]]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def pieces(texts: list[str]) -> Iterator[list[str]]:
    """The pre-tokens of each text, all of whose code points are scanned in one pass."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.full(int(lengths.sum()) + len(texts), STOP, np.uint32)
    ends = np.cumsum(lengths + 1)
    for t, n, e in zip(texts, lengths.tolist(), ends.tolist(), strict=True):
        codes[e - 1 - n : e - 1] = np.frombuffer(t.encode("utf-32-le"), "<u4")
    at = starts(codes)
    cuts = np.searchsorted(at, ends - 1)  # of each text's STOP
    low = 0
    for t, n, e, high in zip(texts, lengths.tolist(), ends.tolist(), cuts.tolist(), strict=True):
        own = (at[low : high + 1] - (e - 1 - n)).tolist()
        yield [t[a:b] for a, b in zip(own, own[1:])]  # noqa: B905
        low = high + 1


@cache
def codec(ranks: bytes) -> Codec:
    return Codec(ranks)


def encode(texts: list[str], c: Codec) -> Iterator[tuple[list[int], list[int]]]:
    """For each text: its ids, and how many of them each pre-token has (kept for decoding)."""
    for own in pieces(texts):
        hits = c.look_up(own)
        yield list(chain.from_iterable(hits)), list(map(len, hits))


def tokenize(docs: DataFrame, ranks_path: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``ids`` also the ids and ``piece_ends``.

    Each text is encoded whole and its ids are decoded again; ``decoded_sha256`` is that of the decoded bytes.
    ``piece_ends[i]`` is the number of ids up to the end of pre-token i, so any pre-token can be decoded alone.
    ``ranks_path`` is read by the driver; the file (a vocabulary, of fixed size) goes to the executors with the task.

    A null text is empty: no ids, the digest of no bytes. Repeated rows and null doc_ids give a row each. No size
    limit for a text: memory is a small multiple of the largest one. Other columns are ignored. Empty in, empty out.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    fields = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, piece_ends array<int>" * ids

    def some(rows: pa.RecordBatch, c: Codec) -> pa.RecordBatch:
        texts = [t or "" for t in rows.column(1).to_pylist()]
        out: list[list] = [[], [], []]
        kept: list[list] = [[], []]
        for own, sizes in encode(texts, c):
            out[0].append(len(own))
            out[1].append(hashlib.sha256(",".join(map(c.decimal.__getitem__, own)).encode()).hexdigest())
            out[2].append(hashlib.sha256(c.decode(own)).hexdigest())
            if ids:
                kept[0].append(np.array(own, np.int32))
                kept[1].append(np.cumsum(sizes, dtype=np.int32))
        columns = [rows.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
        columns += [pa.array(k, pa.list_(pa.int32())) for k in kept if ids]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in fields.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value)
        for b in batches:
            sizes = np.cumsum(np.asarray([len(t) if t else 0 for t in b.column(1).to_pylist()], np.int64)) // BATCH_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts, cuts[1:]):  # noqa: B905
                yield some(b.slice(x, y - x), c)

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, fields)
