import json
import random

from factloom.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind string, call_id string, tool string, arguments string"
TOOLS = {"find": {"q": ("string", True), "n": ("integer", False)}, "now": {}}


def link(spark, rows):
    return chat.link(spark.createDataFrame(rows, SCHEMA), TOOLS).orderBy("conv_id", "level", "anchor_turn", "phase", "turn").collect()


def test_links_and_order(spark):
    rows = [
        (1, 0, "user", "hi", "message", None, None, None),
        (1, 4, "tool", "late", "result", "a", None, None),
        (1, 1, "assistant", None, "call", "a", "find", '{"q": "x", "n": 2}'),
        (1, 2, "assistant", None, "call", "b", "now", "{}"),
        (1, 3, "tool", "lost", "result", "zz", None, None),
        (2, 1, "tool", "other conversation", "result", "a", None, None),
    ]
    out = link(spark, rows)
    assert [(r.conv_id, r.turn, r.status) for r in out] == [(1, 0, "message"), (1, 1, "answered"), (1, 4, "linked"), (1, 2, "unanswered"), (1, 3, "orphan"), (2, 1, "orphan")]
    assert out[1].json == '{"arguments":{"n":2,"q":"x"},"content":null,"id":"a","role":"assistant","tool":"find"}'


def test_validation(spark):
    cases = {'{"q":"x"}': "", '{"q":1}': "type:q", '{"n":1.5,"q":"x"}': "type:n", "{}": "missing:q", '{"q":"x","z":1}': "unknown:z", "[1]": "missing:q,not_an_object", "{": "missing:q,not_an_object", None: "missing:q,not_an_object"}
    rows = [(1, i, "assistant", None, "call", str(i), "find", a) for i, a in enumerate(cases)] + [(1, 99, "assistant", None, "call", "x", "other", "{}")]
    assert [r.errors for r in link(spark, rows)] == [*cases.values(), "unknown_tool"]


def test_canonical(spark):
    texts = ['q"\\/\b\f\n\r\t\x01\x1f\x7f é \u2028 😀', "", "plain", '{"b": 1}']
    out = link(spark, [(1, i, "user", t, "message", None, None, None) for i, t in enumerate(texts)])
    for r, t in zip(out, texts, strict=True):
        assert r.json == json.dumps({"content": t, "role": "user"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    nested = spark.createDataFrame([('{"b": {"z": 1, "a": [1, 2.50, "x"]}, "a": null, "é": true}',)], "j string").select(chat.canonical(chat.F.col("j"))).first()[0]
    assert nested == '{"a":null,"b":{"a":[1,2.5,"x"],"z":1},"é":true}'


def test_dependencies(spark):
    rows = [(1, 0, "a", ["b"]), (1, 1, "b", ["c", "gone", "b"]), (1, 2, "c", []), (1, 3, "x", ["y"]), (1, 4, "y", ["x"]), (1, 5, "z", ["x"]), (2, 0, "a", ["b"])]
    base = spark.createDataFrame([(c, t, "assistant", None, "call", i, "now", "{}", a) for c, t, i, a in rows], SCHEMA + ", after array<string>")
    out = {(r.conv_id, r.call_id): (r.level, r.status) for r in chat.link(base, TOOLS).collect()}
    assert out[1, "c"][0] == 0 and out[1, "b"][0] == 1 and out[1, "a"][0] == 2 and out[2, "a"][0] == 0
    assert {out[1, k][1] for k in "xyz"} == {"cyclic"}


def levels(spark, calls):
    base = spark.createDataFrame(calls, "conv_id bigint, call_id string, after array<string>")
    return {(r.conv_id, r.call_id): r.level for r in chat.levels(base).collect()}


def brute_levels(calls):
    after = {}
    for c, i, deps in calls:
        after.setdefault((c, i), set()).update((c, x) for x in deps or [])
    after = {k: {x for x in v if x in after and x != k} for k, v in after.items()}
    out = {}
    while ready := [k for k in after if k not in out and all(x in out for x in after[k])]:
        out |= {k: 1 + max((out[x] for x in after[k]), default=-1) for k in ready}
    return {k: out.get(k) for k in after}


def test_levels_as_brute_force(spark):
    """Chains, bushes, ladders, circles, repeated and missing ids."""
    rng = random.Random(2)
    calls = [(0, str(i), [str(i - 1)]) for i in range(300)] + [(1, str(i), [str(i - 1), str(i - 2)]) for i in range(12)]
    for c in range(2, 12):
        n = rng.randrange(2, 40)
        calls += [(c, str(rng.randrange(n)), [str(rng.randrange(n)) for _ in range(rng.choice((0, 1, 1, 1, 2)))]) for _ in range(n)]
        ids = rng.sample(range(n), n)
        calls += [(100 + c, str(ids[i]), [str(ids[k]) for k in rng.sample(range(i), min(i, rng.choice((0, 1, 1, 2, 3))))]) for i in range(n)]
    assert levels(spark, calls) == brute_levels(calls)


def test_rounds_of_a_chain(spark, monkeypatch):
    """A chain halves each round: 300 calls don't take 300 rounds."""
    wrote, shared = [], chat.shared
    monkeypatch.setattr(chat, "shared", lambda df: wrote.append(1) or shared(df))
    assert max(levels(spark, [(0, str(i), [str(i - 1)]) for i in range(300)]).values()) == 299 and len(wrote) < 50


def test_query_has_levels_and_errors(spark, sf):
    from factloom.llm import registry

    rows = registry.op8_chat(spark, sf).collect()
    assert {r.level for r in rows} > {0, 1} and {"", "type:chars", "unknown:draft"} <= {r.errors for r in rows}


def test_hot_identifier(spark):
    """Repeated ids cost no pairs."""
    rows = [(1, i, "assistant", None, "call", "same", "now", "{}") for i in range(2000)] + [(1, 5000 + i, "tool", "r", "result", "same", None, None) for i in range(2000)]
    out = link(spark, rows)
    assert len(out) == 4000 and {r.status for r in out} == {"answered", "linked"}


def test_odd_input(spark):
    rows = [(None, None, None, None, None, None, None, None), (None, 1, "user", "x", "call", None, "find", "{}"), (1, 1, "tool", None, "result", None, None, None)]
    assert sorted(r.status for r in link(spark, rows)) == ["message", "orphan", "unanswered"]
    assert link(spark, []) == []
    odd = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "x" * 50_000), (1, 2, "user", "y" * 500_000), (1, 2, "user", "y" * 500_000), (None, None, None, None)], "conv_id bigint, turn bigint, role string, text string")
    assert chat.link(chat.as_calls(odd)).count() == 5
