"""The pipeline against a plain version of its stages."""

import glob
import hashlib

import corpus_pipeline
from factloom.llm import toxicity
from factloom.llm.common import shared_folder
from test_decontaminate import words
from test_linededup import brute as dedup
from test_nearcopies import brute as near_groups


def test_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = [(r.doc_id, r.text) for r in docs.collect() if model.score(r.text) < 0.5]
    kept = [(r[0], r[3]) for r in dedup(kept)]
    groups, _ = near_groups(kept)
    kept = [(i, t) for i, t in kept if groups[i] == i]
    items = [" " + " ".join(words(r.text)).lower() + " " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in kept if not any(x in " " + " ".join(words(t)).lower() + " " for x in items)]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in kept)
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept}


def test_stages_return_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def chain(spark, docs, sf):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == COLUMNS
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, sf)


COLUMNS = "doc_id text lang source n_chars kept fingerprint row drops".split()


def test_odd_documents_end_to_end(spark, odd, none, sf):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through all stages."""
    docs, ids = chain(spark, odd, sf)
    rows = sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    assert [i for i, _ in rows] == [0, 0, 1, 4, 4, 5, 6] and len(dict(rows)[5]) > 100_000
    got = {(r.doc_id or 0, r.decoded_sha256) for r in ids.collect()}
    assert got == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
    docs, ids = chain(spark, none, sf)
    assert docs.count() == ids.count() == 0


def test_only_the_result_is_left(spark, sf):
    folder = shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/pipeline-*/*"))
    corpus_pipeline.run(spark, sf)
    assert [p.rsplit("/", 1)[-1] for p in set(glob.glob(f"{folder}/pipeline-*/*")) - before] == ["bpe"]
