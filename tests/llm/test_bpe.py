import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bpe
from factloom.llm.registry import ranks_path


@pytest.fixture(scope="module")
def both():
    with open(ranks_path(), "rb") as f:
        c = bpe.Codec(f.read())
    return c, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text(alphabet=" \n\t\u00a0'sStrevelmd aZ9.!\u0301é中😀"))))
def test_like_the_library(both, texts):
    c, library = both
    for t, (ids, sizes) in zip(texts, bpe.encode(texts, c), strict=True):
        assert ids == library.encode_ordinary(t)
        assert sum(sizes) == len(ids) and c.decode(ids) == t.encode()


def test_long_pieces(both):
    c, library = both
    for t in ("x" * 50_000, "abcde" * 9_000, "é!" * 5_000, " " * 10_000 + "a", "thethe" * 11, "ab" * 31):
        assert next(bpe.encode([t], c))[0] == library.encode_ordinary(t)


def test_cache_generations(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    c, library = bpe.Codec(open(ranks_path(), "rb").read()), both[1]
    t = "one two three four five one two three six seven one"
    assert next(bpe.encode([t], c))[0] == library.encode_ordinary(t) and len(c.young) <= 3


def test_documents_as_the_library(spark, sf, both):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in bpe.tokenize(docs, ranks_path(), ids=True).collect()}
    for d in docs.collect():
        ids = both[1].encode_ordinary(d.text)
        r = rows[d.doc_id]
        assert r.ids == ids and r.n_tokens == len(ids) and (r.piece_ends[-1] if ids else 0) == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_odd_input(odd, none):
    rows = bpe.tokenize(odd, ranks_path()).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 9
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (1, 2)] == [(0, empty, empty)] * 2
    assert bpe.tokenize(none, ranks_path()).count() == 0
