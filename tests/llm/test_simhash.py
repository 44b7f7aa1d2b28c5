import random

import xxhash

from factloom.llm import simhash


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    """prints: (doc_id, value) -> doc_id -> least doc_id."""
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least[top(i)] = min(least.get(top(i), d), d)
    return {d: least[top(i)] for i, (d, _) in enumerate(prints)}


def test_documents_as_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [(r.doc_id, brute_print(r.text)) for r in docs.collect()]
    groups = brute_groups(prints)
    assert got == {d: (f"{p:016x}", groups[d]) for d, p in prints}
    assert len(set(groups.values())) < len(groups)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('the of and')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"the of and", 42)


def test_links_in_crowded_buckets(spark):
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(3):  # clouds of near copies, far over the bucket bound, chained
        centre = rng.getrandbits(64)
        for _ in range(150):
            v = centre
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 5))):
                v ^= 1 << b
            values.add(v)
            if rng.random() < 0.3:
                centre ^= 1 << rng.randrange(64)
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    signed = [(v - (1 << 64) if v >> 63 else v,) for _, v in rows]
    want = brute_groups(rows)
    for bucket in (4, 64, 10_000):
        edges = simhash.links(spark.createDataFrame(signed, "fingerprint bigint"), bucket)
        number = {s[0]: i for i, s in enumerate(signed)}
        pairs = [(number[r.a], number[r.b]) for r in edges.collect()]
        assert all((rows[a][1] ^ rows[b][1]).bit_count() <= 2 for a, b in pairs)
        roots = {r.node: r.root for r in simhash.connected_components(edges).collect()}
        got = {}
        for (i, _), s in zip(rows, signed, strict=True):
            got.setdefault(roots.get(s[0], s[0]), []).append(i)
        assert sorted(map(sorted, got.values())) == sorted(sorted(i for i in want if want[i] == w) for w in set(want.values()))


def test_odd_input(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 9
    zero = [r for r in rows if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {1}
    assert [r.component_id for r in rows if r.doc_id == 4] == [4, 4]
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(odd).collect()) == [0, 0, 1, 4, 4, 5, 6]


def test_keep_one_tells_rows_of_one_id_apart(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "wholly other words here"), (3, "WHOLLY other  words here"), (3, "third text")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, kept)) == [(1, "a b c d e"), (2, "wholly other words here"), (3, "third text")]


def test_few_tables_are_written(spark, monkeypatch):
    """A chain of near copies takes no rounds: five tables (fingerprints, distinct ones, segments, links, components)."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(words))]
    for i in range(1, 60):  # a word changes at a time, so the ends of the chain are far apart
        words[rng.randrange(400)] = f"x{i}"
        rows.append((i, " ".join(words)))
    wrote = []
    checkpoint = type(spark.range(1)).checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda df, *a, **b: wrote.append(1) or checkpoint(df, *a, **b))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_groups([(d, brute_print(t)) for d, t in rows]) and len(set(got.values())) < len(got)
    assert len(wrote) <= 5
