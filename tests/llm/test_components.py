"""Connected components of few edges in one task, and written tables that few tasks read."""

import random

import pytest

from factloom.llm import common, components, nearcopies


def brute(pairs):
    top = {n: n for p in pairs for n in p}

    def root(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in pairs:
        top[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((n, root(n)) for n in top)


def shapes():
    rng = random.Random(2)
    path = [rng.getrandbits(64) - (1 << 63) for _ in range(400)]
    yield "path", list(zip(path, path[1:], strict=False))
    yield "star", [(5000, k) for k in range(300)]
    yield "forest", [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(300)]
    yield "loops", [(7, 7), (-(1 << 63), (1 << 63) - 1), (3, 4), (4, 3)]


@pytest.mark.parametrize(("name", "pairs"), list(shapes()))
def test_one_task_and_rounds_agree(spark, monkeypatch, name, pairs):
    wrote = []
    monkeypatch.setattr(components, "shared", lambda df: wrote.append(1) or common.shared(df))
    want = brute([p for p in pairs if p[0] != p[1]])
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert sorted(map(tuple, components.connected_components(edges).collect())) == want
    assert len(wrote) <= 1  # no rounds
    assert sorted(map(tuple, components.connected_components(edges, 0).collect())) == want
    if name == "path":
        assert len(wrote) > 3


def test_no_edges(spark):
    none = spark.createDataFrame([(None, 1), (2, None), (3, 3)], "a bigint, b bigint")
    assert components.connected_components(none).collect() == components.connected_components(none, 0).collect() == []


def test_written_tables_are_read_by_few_tasks(spark, monkeypatch):
    rows = spark.range(0, 10_000, 1, 64)
    cores = spark.sparkContext.defaultParallelism
    assert common.shared(rows).rdd.getNumPartitions() == 64
    out = common.packed(rows)
    assert out.rdd.getNumPartitions() == cores and sorted(r.id for r in out.collect()) == list(range(10_000))
    monkeypatch.setattr(common, "PART", 4096)  # a table of many bytes keeps many tasks
    assert common.packed(rows).rdd.getNumPartitions() > cores


def test_shuffle_files_go_as_soon_as_they_are_read(spark, sf):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x for x in (manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size())) if x.startswith("shuffle_")}
    before = held()
    found = nearcopies.groups(spark.read.parquet(f"{sf}/documents.parquet").limit(300))
    assert len(held() - before) <= 8  # those of the last query may still be going
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, found.collect()))  # what is returned can run again
