import random
import zlib
from collections import defaultdict

from factloom.llm import sharding


def check(df, shards=24, **more):
    rows = sharding.shard(df, shards, **more).collect()
    want = sorted((r.doc_id or 0, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return by


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    by = check(docs)
    sizes = [sum(r.size for r in by[k]) for k in range(24)]
    assert sorted(by) == list(range(24)) and max(sizes) / min(sizes) < 1.05, sizes
    texts = defaultdict(set)
    for k, own in by.items():
        for r in own:
            texts[r.size, r.text_crc32].add(k)
    assert sum(len(x) > 1 for x in texts.values()) <= 30  # groups of equal texts stay together but for cut ones


def test_hot_group(spark):
    """Equal texts with most of the bytes are dealt over several shards, near equal."""
    rows = [(i, "same " * 100, "en", "a") for i in range(3000)] + [(3000 + i, f"own {i} " * 60, "de", "b") for i in range(1000)]
    by = check(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 8, run=50)
    sizes = [sum(r.size for r in by[k]) for k in range(8)]
    assert max(sizes) / min(sizes) < 1.1, sizes


def test_target_bytes(spark):
    rows = [(i, "x" * (i % 50), None, None) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert len(check(df, None, target_bytes=5000)) == -(-(sum(i % 50 for i in range(1000)) + 8000) // 5000)


def test_odd_input(odd, none):
    check(odd)
    check(none)


def brute(rows, leaves):
    """rows (k0, k1, k2, size, id) -> id -> shard, by whole sorts."""
    tops = [max(1, max(r[k] >> sharding.TIE for r in rows) - min(r[k] >> sharding.TIE for r in rows)) for k in range(3)]

    def cut(own, first, leaves):
        if leaves == 1 or not own:
            return {r[4]: first for r in own}
        wide = [(max(r[k] >> sharding.TIE for r in own) - min(r[k] >> sharding.TIE for r in own)) / tops[k] for k in range(3)]
        k = wide.index(max(wide))
        want, before, sizes = sum(r[3] for r in own) * (leaves // 2) / leaves, 0, defaultdict(int)
        for r in own:
            sizes[r[k]] += r[3]
        for key in sorted(sizes):
            if before + sizes[key] >= want:
                break
            before += sizes[key]
        below = key if want - before < before + sizes[key] - want else key + 1
        half = leaves // 2
        return cut([r for r in own if r[k] < below], first, half) | cut([r for r in own if r[k] >= below], first + half, leaves - half)

    return cut(rows, 0, leaves)


def test_tree_as_brute_force(spark):
    """Cuts of no tolerance are the exact weighted medians along the widest dimension; also where nodes aren't broadcast."""
    rng = random.Random(4)
    rows = [(rng.choice((1, 2, 900)) << 38 | rng.randrange(1 << 20), rng.randrange(50) << 38 | rng.randrange(3), int(rng.expovariate(0.001)) << 38, rng.randrange(1, 400), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k0 bigint, k1 bigint, k2 bigint, size bigint, id bigint")
    for leaves in (1, 2, 7, 24):
        want = brute(rows, leaves)
        assert {r.id: r.shard for r in sharding.grow(df, leaves, 0).collect()} == want and len(set(want.values())) == leaves


def test_nodes_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SMALL_LEVEL", 1)
    test_hot_group(spark)


def test_rows_of_one_id(spark):
    """Rows of one (or no) id and text are dealt over several shards too."""
    for i in (7, None):
        by = check(spark.createDataFrame([(i, "same " * 100, "en", "a")] * 2000 + [(k, f"own {k} " * 60, "de", "b") for k in range(300)], "doc_id bigint, text string, lang string, source string"), 8, run=50)
        sizes = [sum(r.size for r in by[k]) for k in range(8)]
        assert max(sizes) / min(sizes) < 1.15, sizes


def test_more_parts_than_bits(spark, monkeypatch):
    """A group of more parts than the key has bits for is dealt all the same."""
    monkeypatch.setattr(sharding, "PART", 3)
    test_hot_group(spark)
