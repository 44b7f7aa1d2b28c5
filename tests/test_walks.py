"""Walks of any depth, and operators that mustn't gather a table, against brute force."""

import random

import pandas as pd
from pyspark.sql import functions as F

from factloom.functions import codes
from factloom.operators import archive, diff, effects, evidence, graph, walks
from factloom.plans import stages

DEEP = 200


def chain(spark, circle=(1001, 1002, 1003)):
    """A file 0 with a chain of DEEP nodes below it, a node without a file, and a circle with a tail."""
    nodes = [(0, "file", "f")] + [(i, "function", f"n{i}") for i in range(1, DEEP + 1)] + [(900, "function", "lost")] + [(i, "function", f"c{i}") for i in (*circle, 1004)]
    edges = [("contains", i, i, i + 1) for i in range(DEEP)] + [("contains", 0, a, b) for a, b in zip(circle, (*circle[1:], circle[0]), strict=True)] + [("contains", 0, circle[0], 1004)]
    return spark.createDataFrame(nodes, "node_id bigint, kind string, name string"), spark.createDataFrame(edges, "kind string, seq bigint, src bigint, dst bigint")


def test_files_and_owners_of_deep_nodes(spark):
    nodes, edges = chain(spark)
    files = {r.node_id: r.file_id for r in graph.file_of(nodes, edges).collect()}
    assert all(files[i] == 0 for i in range(DEEP + 1)) and all(files[i] is None for i in (900, 1001, 1002, 1003, 1004))
    owners = {r.node_id: r.owner for r in walks.owner_paths(nodes, edges).collect()}
    assert owners[DEEP] == ".".join(f"n{i}" for i in range(1, DEEP + 1)) and owners[1] == "n1"
    assert [owners[i] for i in (0, 900, 1001, 1004)] == [None] * 4


def test_sections_and_scopes_of_deep_nodes(spark):
    nodes = [(0, None, "doc_section"), (1, 0, "page"), *[(i, i - 1, "requirement") for i in range(2, DEEP)], (500, 501, "page"), (501, 500, "page"), (600, None, "page")]
    got = {r.node_id: r.section_id for r in evidence.section_of(spark.createDataFrame(nodes, "node_id bigint, parent bigint, kind string")).collect()}
    assert all(got[i] == 0 for i in range(1, DEEP)) and [got[i] for i in (0, 500, 501, 600)] == [None] * 4
    modules = [(0, None, "a.b.c"), *[(i, i - 1, "a") for i in range(1, DEEP)], (500, 501, "a"), (501, 502, "a.b"), (502, 500, "a.b.c.d")]
    got = {r.module: r.visible for r in walks.effective_scopes(spark.createDataFrame(modules, "module bigint, parent bigint, scope string")).collect()}
    assert {got[i] for i in range(DEEP)} == {"a.b.c"} and {got[i] for i in (500, 501, 502)} == {"a.b.c.d"}


def test_nearest_declaration_far_up(spark):
    deep = 70
    scopes = spark.createDataFrame([(0, None), *[(i, i - 1) for i in range(1, deep)], (500, 501), (501, 502), (502, 500), (600, 600)], "scope bigint, parent bigint")
    decls = spark.createDataFrame([(0, "x", 7), (0, "x", 8), (deep - 2, "y", 9), (502, "x", 5)], "scope bigint, name string, node bigint")
    refs = spark.createDataFrame([(1, deep - 1, "x"), (2, deep - 1, "y"), (3, deep - 1, "z"), (4, 500, "x"), (5, 500, "z"), (6, 600, "z")], "ref_id bigint, scope bigint, name string")
    assert {r.ref_id: (r.node, r.steps) for r in walks.nearest_in_scope(refs, decls, scopes).collect()} == {1: (8, deep - 1), 2: (9, 1), 4: (5, 2)}


def brute_order(pairs, parents):
    known = {c for c, _ in parents}
    up = {}
    for c, p in parents:
        up.setdefault(c, set()).update({p} - {None})

    def above(c):
        seen, todo = set(), [c]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    out = {}
    for i, a, b in pairs:
        if a is None or b is None or a not in known or b not in known:
            out[i] = "unknown"
        elif a == b:
            out[i] = "same_change"
        else:
            out[i] = "section_before_reference" if a in above(b) else "reference_before_section" if b in above(a) else "diverged"
    return out


def test_change_order_in_long_and_merged_histories(spark):
    rng = random.Random(8)
    parents = [(f"m{i}", f"m{i - 1}" if i else None) for i in range(300)] + [("s0", "m100"), *[(f"s{i}", f"s{i - 1}") for i in range(1, 150)], ("m299", "s149")]
    parents += [(f"r{i}", f"r{k}" if i else None) for i in range(60) for k in {rng.randrange(max(1, i)) for _ in range(rng.choice((1, 1, 1, 2, 3)))}] + [("gone", "nowhere")]
    names = [c for c, _ in parents]
    pairs = [(0, "m0", "m299"), (1, "m298", "m0"), (2, "s149", "m200"), (3, "s10", "m299"), (4, "m5", "m5"), (5, "m5", None), (6, "m5", "nobody"), (7, "gone", "m1"), (8, "m50", "s149")]
    pairs += [(10 + i, rng.choice(names), rng.choice(names)) for i in range(60)]
    got = walks.change_order(spark.createDataFrame(pairs, "pair_id bigint, section string, reference string"), spark.createDataFrame(parents, "commit string, parent string"))
    assert {r.pair_id: r.change_order for r in got.collect()} == brute_order(pairs, parents)


def test_relationships_tell_what_they_leave_out(spark):
    nodes = spark.createDataFrame([(i, "function", f"n{i}") for i in range(70)], "node_id bigint, kind string, name string")
    edges = spark.createDataFrame([("calls", i, 0, i) for i in range(1, 70)], "kind string, seq bigint, src bigint, dst bigint")
    got = graph.relationships(nodes, edges).collect()
    assert {(r.node_id, r.omitted) for r in got} == {(0, 19), *[(i, 0) for i in range(1, 70)]} and sum(r.node_id == 0 for r in got) == 50


def test_running_sums_by_ranges(spark):
    rng = random.Random(1)
    sums = [(i, rng.randrange(9)) for i in rng.sample(range(2000), 300)]
    got = {r.part: r.base for r in stages.bases(spark.createDataFrame(sums, "part bigint, total bigint"), "part", "total", 16).collect()}
    assert got == {p: sum(n for q, n in sums if q < p) for p, _ in sums}
    rows = [(rng.randrange(5), rng.choice("abc")) for _ in range(500)]
    got = stages.numbered(spark.createDataFrame(rows, "a int, b string"), "a", "b").orderBy("place").collect()
    assert [(r.a, r.b, r.place) for r in got] == [(*x, i + 1) for i, x in enumerate(sorted(rows))]


def test_archive_offsets(spark):
    blobs = archive.build(spark.createDataFrame([("x" * (i % 37),) for i in range(300)], "content string")).orderBy("sha256").collect()
    at = 0
    for b in blobs:
        assert b.offset == at
        at += b.length
    assert len(blobs) == 37


def brute_plan(tasks, fits, limits, total):
    room, out = dict(limits), {}
    for task, _, ready in sorted(tasks, key=lambda t: (t[1], t[0])):
        own = sorted((p, m, pool) for t, p, m, pool in fits if t == task)
        out[task] = (None, None, "task_not_dispatch_ready" if not ready else "capacity" if own else "no_supported_model")
        for _, m, pool in own if ready else ():
            if total and room.get(pool, 0) > 0:
                room[pool] -= 1
                total -= 1
                out[task] = (m, pool, None)
                break
    return out


def test_plans_as_brute_force(spark):
    rng = random.Random(3)
    for total in (0, 5, 40):
        tasks = [(i, rng.randrange(50), rng.random() < 0.9) for i in range(200)]
        fits = [(i, k, f"m{p}", f"p{p}") for i in range(200) if rng.random() < 0.9 for k, p in enumerate(rng.sample(range(4), rng.choice((1, 2, 3))))]
        limits = [(f"p{p}", n) for p, n in enumerate((3, 0, 7, 20))]
        got = effects.compose(spark.createDataFrame(tasks, "task bigint, place int, ready boolean"), spark.createDataFrame(fits, "task bigint, preference int, model string, pool string"), spark.createDataFrame(limits, "pool string, room int"), total)
        assert {r.task: (r.model, r.pool, r.reason) for r in got.collect()} == brute_plan(tasks, fits, limits, total)


def test_addresses(spark):
    intents = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "z"), (1, "a")], "intent_id bigint, file string")
    world = spark.createDataFrame([("a", "A")], "file string, address string")
    touches = spark.createDataFrame([(1, "b", "B"), (1, "x", "X"), (1, "a", "own"), (2, "y", "Y")], "intent_id bigint, file string, address string")
    got = {(r.intent_id, r.file, r.address) for r in effects.addresses_for(intents, world, touches).collect()}
    assert got == {(1, "a", "A"), (1, "b", "B"), (1, "c", "B"), (1, "c", "X"), (1, "c", "own"), (2, "z", "Y")}


def test_report_lines_are_in_order(spark):
    card = spark.createDataFrame([(2, None)], "claims int, drifts int")
    drifts = spark.createDataFrame([("f", "1", "2")], "file string, expected string, actual string")
    bad = spark.createDataFrame([(f"f{i % 50}", "c") for i in range(300)], "file string, code string")
    got = [r.line for r in evidence.render(card, drifts, bad).orderBy("place").collect()]
    assert got == ["# Documentation truth", "- claims: 2", "- drifts: unknown", "## Drifts", "- `f`: expected `1`, found `2`", "## Diagnostics", *sorted(f"- `f{i % 50}`: c" for i in range(300))]


def test_cluster_members_are_rows(spark):
    cards = spark.createDataFrame([("k", "c", None, "t", "d", "s", 2, f"p{i % 7}", i % 3, "low" if i else "high") for i in range(30)], ", ".join(f"{c} string" for c in diff.CLUSTER) + ", occurrence_count int, path string, evidence_id bigint, severity string")
    (row,) = diff.cluster_cards(cards).collect()
    assert (row.occurrence_count, row.n_paths, row.n_evidence, row.severity, row.path) == (60, 7, 3, "high", "p0")
    assert diff.cluster_members(cards).groupBy("member").count().orderBy("member").collect() == [("evidence", 3), ("path", 7)]


def test_fnv_of_a_batch():
    def fnv(data):
        h = 14695981039346656037
        for b in data:
            h = ((h ^ b) * 1099511628211) % 2**64
        return f"{h:016x}"

    rng = random.Random(2)
    rows = [bytes(rng.randrange(256) for _ in range(rng.choice((0, 1, 5, 300)))) for _ in range(50)] + [None, "é", ""]
    assert codes._fnv1a(pd.Series(rows, dtype=object)).tolist() == [None if x is None else fnv(x.encode() if isinstance(x, str) else x) for x in rows]
    assert codes._fnv1a(pd.Series([], dtype=object)).tolist() == [] and codes._fnv1a(pd.Series([None])).tolist() == [None]


def test_pointers_end(spark):
    """The number of rounds follows the longest path's logarithm, and circles don't go on."""
    rounds = []
    jump = lambda t: rounds.append(1) or t.alias("a").join(t.alias("b"), F.col("a.up") == F.col("b.n"), "left").select("a.n", "b.up")
    chain = spark.createDataFrame([(i, i + 1 if i < 99 else None) for i in range(100)] + [(200, 201), (201, 200)], "n bigint, up bigint")
    got = stages.doubled(chain, jump, "up").where("up is not null").select("n").collect()
    assert sorted(r.n for r in got) == [200, 201] and len(rounds) <= 8
