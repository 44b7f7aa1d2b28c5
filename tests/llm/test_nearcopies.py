"""Near copies by Jaccard similarity, against brute force."""

import random

from factloom.llm import nearcopies, simhash


def sets(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, least=0.8):
    """(doc_id, text) -> doc_id -> least doc_id of its group, and the number of pairs of different sets."""
    own = [sets(t) for _, t in rows]
    at, top, pairs = {}, list(range(len(rows))), 0

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, s in enumerate(own):
        for j in {j for g in s for j in at.get(g, ())} | ({j for j in range(i) if not own[j]} if not s else set()):
            if not s or len(s & own[j]) / len(s | own[j]) >= least:
                pairs += s != own[j]
                top[root(i)] = root(j)
        for g in s:
            at.setdefault(g, []).append(i)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[root(i)] = min(first.get(root(i), d), d)
    return {d: first[root(i)] for i, (d, _) in enumerate(rows)}, pairs


def test_documents_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, pairs = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert pairs
    assert {r.doc_id: r.component_id for r in nearcopies.groups(docs).collect()} == want
    assert sorted(r.doc_id for r in simhash.keep_one(docs, 5, 0.8).collect()) == sorted(set(want.values()))


def test_copies_with_changed_words(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for n, changes, copies in ((300, 4, 3), (60, 1, 3), (12, 0, 2), (300, 4, 150)):  # the last group is larger than a bucket
        for _ in range(4 if copies < 100 else 1):
            base = rng.choices(words, k=n)
            for _ in range(copies):
                t = list(base)
                for _ in range(changes):
                    t[rng.randrange(n)] = rng.choice(words)
                rows.append((len(rows), " ".join(t)))
    rows += [(len(rows) + i, " ".join([*rng.choices(words, k=100), *words[:20]])) for i in range(100)]  # a common passage
    want, pairs = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for bucket in (64, 1000):
        assert {r.doc_id: r.component_id for r in nearcopies.groups(docs, bucket=bucket).collect()} == want
    assert simhash.keep_one(docs, 5, 0.8).count() == len(set(want.values())) < simhash.keep_one(docs).count()


def test_odd_input(odd, none):
    assert nearcopies.groups(none).count() == 0 and nearcopies.groups(odd).count() == 9
    assert simhash.keep_one(odd, 5, 0.8).columns == odd.columns
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(odd, 5, 0.8).collect()) == [0, 0, 1, 4, 4, 5, 6]


def test_simhash_finds_most_links(spark):
    """Multi-index hashing finds most of what is similar (and only the exact join the rest); no radius would find all."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for n, changes in ((300, 4), (200, 1), (60, 1)):
        for _ in range(60):
            t = rng.choices(words, k=n)
            rows.append((len(rows), " ".join(t)))
            for _ in range(changes):
                t[rng.randrange(n)] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    want, pairs = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    node = {r.node: r.doc_id for r in nearcopies.outlines(docs, 5, 0.8).collect()}
    found = [(node[r.a], node[r.b]) for r in nearcopies._probed(nearcopies.outlines(docs, 5, 0.8), 0.8).collect()]
    assert sum(want[a] == want[b] for a, b in found) >= 0.7 * pairs > 0
    assert {r.doc_id: r.component_id for r in nearcopies.groups(docs).collect()} == want


def test_first_fingerprint_is_simhash():
    for text in ("a b c d e f g h", "One two  three", " ".join(f"w{i}" for i in range(700))):
        h = [int(x) for x in nearcopies.shingles(text, 5)]
        assert int(nearcopies._prints(nearcopies.shingles(text, 5))[0]) % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert int(nearcopies._prints(nearcopies.shingles(text, 5))[0]) == simhash.fingerprint(text, 5)
