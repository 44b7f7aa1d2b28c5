import zlib

import numpy as np

from factloom.llm import toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.toxic) for x in labels.collect() if rows[x.doc_id].held_out]
    hit, said, true = sum(p and t for p, t in held), sum(p for p, _ in held), sum(t for _, t in held)
    print("held out", len(held), hit, said, true)
    assert hit / said > 0.95 and hit / true > 0.8


def test_interaction():
    """Neither the insult nor the group alone is toxic; both together are. A sum of weights can't tell that."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(3000):
        words = [f"w{'abcdefghij'[k]}" for k in rng.integers(0, 10, 4)]
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words += ["insult"] * a + ["group"] * b
        rows.append(toxicity.terms(" ".join(words)))
        y.append(a and b)
    model = toxicity.fit_terms(rows, np.array(y), epochs=25)
    scores = [model.score(t) for t in ("insult group wa", "insult wa wb", "group wa wb", "wa wb", "")]
    assert scores[0] > 0.5 and max(scores[1:]) < 0.5


def test_odd_input(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 1, 0), (None, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.where("false")).count() == 9
    assert toxicity.drop_toxic(odd, labels.where("false")).columns == odd.columns
