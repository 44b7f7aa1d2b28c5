import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import effects
from factloom.sources import declared, files, sinks

TOML = '[[document]]\npath = "./docs/api.yaml"\nformat = "open_api"\n[[document]]\npath = "gone.md"\n'


def test_discovery_gives_each_candidate_a_reason(spark):
    tree = spark.createDataFrame([(p,) for p in ("README.md", "docs/api.yaml", "docs/x.md", "node_modules/a.md", ".git/b.md", ".h/c.md", "src/a.ts")], "path string")
    got = {r.path: (r.format, r.included, r.reason) for r in declared.discover(tree, declared.declarations(spark, TOML), spark.createDataFrame([("docs/x.md",)], "path string")).collect()}
    assert got == {
        "README.md": ("markdown", True, None), "docs/api.yaml": ("open_api", True, None), "gone.md": ("markdown", False, "missing"), "docs/x.md": ("markdown", False, "ignore_policy"),
        "node_modules/a.md": ("markdown", False, "hard_directory"), ".git/b.md": ("markdown", False, "hard_directory"), ".h/c.md": ("markdown", False, "hidden"),
    }
    assert declared.declarations(spark, None).count() == 0
    for bad in ('[[document]]\npath = "/a.md"', '[[document]]\npath = "a.md"\nformat = "x"', '[[document]]\npath = "a"\n[[document]]\npath = "a"\nformat = "mdx"'):
        with pytest.raises(ValueError):
            declared.declarations(spark, bad)


def test_ignore_policies_decide_from_the_top(spark):
    out = declared.ignored([("", "*.log\nbuild/\n!keep.log\n/top.md\n# c\n"), ("sub", "!x.log\nbuild2/**\n")])
    paths = ("a.log", "keep.log", "sub/x.log", "sub/y.log", "build/keep.log", "q/build/z.md", "top.md", "q/top.md", "sub/build2/a", "build2/a", "build")
    got = {r.p: r.o for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", out(F.col("p")).alias("o")).collect()}
    assert {p for p, o in got.items() if o} == {"a.log", "sub/y.log", "build/keep.log", "q/build/z.md", "top.md", "sub/build2/a"}


def test_manifests(spark):
    toml = '[package]\nname = "m"\n[dependencies]\na = "1"\nb = {workspace = true}\n[dev-dependencies]\nc = {path = "../c", package = "real"}\n'
    got = {tuple(r) for r in declared.package_manifests(spark.createDataFrame([("x", toml), ("y", "= bad"), ("z", None)], "path string, source string")).collect()}
    assert got == {("m", "a", "1", None, False), ("m", "b", None, None, True), ("m", "real", None, "../c", False)}


def test_archives_round_trip_and_tell_damage(spark):
    blobs = [random.Random(k).randbytes(k * 7) for k in range(9)] + [b"twice", b"twice"]
    good = declared.write_archive(blobs)
    bad = {"magic": b"X" + good[1:], "short": good[:10], "cut": good[:-1], "more": good + b"!", "flip": good[:-1] + bytes([good[-1] ^ 1]), "index": good[:40], "order": good[:16] + good[64:112] + good[16:64] + good[112:]}
    rows = declared.read_archives(spark.createDataFrame([("good", good), *bad.items()], "path string, content binary")).collect()
    assert {(r.sha256, bytes(r.content)) for r in rows if r.path == "good"} == {(hashlib.sha256(b).hexdigest(), b) for b in blobs}
    assert {r.path: r.problem for r in rows if r.path != "good"} == {"magic": "bad_magic", "short": "header_too_short", "cut": "not_packed", "more": "trailing_bytes", "flip": "hash_mismatch", "index": "index_malformed", "order": "index_not_sorted"}


def test_json_configurations():
    assert declared.load_json(b'{"a": 1}') == ({"a": 1}, hashlib.sha256(b'{"a": 1}').hexdigest())
    for bad in (b"[]", b'{"a": 1, "a": 2}', b"{" + b" " * 2_000_000):
        with pytest.raises(ValueError):
            declared.load_json(bad)


def test_sinks(spark, tmp_path):
    lines = spark.range(50).select(F.col("id").alias("place"), F.concat(F.lit("l"), "id").alias("line"))
    for _ in range(2):
        sinks.write_lines(lines, f"{tmp_path}/text")
    assert "".join(p.read_text() for p in sorted((tmp_path / "text").glob("part-*"))).split() == [f"l{k}" for k in range(50)]
    sinks.write_new(lines, f"{tmp_path}/new")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_new(lines, f"{tmp_path}/new")
    sinks.append_jsonl(lines.limit(2), f"{tmp_path}/json")
    sinks.append_jsonl(lines.limit(3), f"{tmp_path}/json")
    with pytest.raises(ValueError):
        sinks.append_jsonl(lines.select(F.repeat("line", 99).alias("line")), f"{tmp_path}/json", 100)
    assert spark.read.json(f"{tmp_path}/json").count() == 5


def test_events_are_appended_only_in_order(spark, tmp_path):
    schema = "attempt string, kind string, data string, place int"
    empty = spark.createDataFrame([], files.JOURNAL)
    sinks.append_events(empty, spark.createDataFrame([("a", "prepare", None, 1), ("a", "dispatch", "{}", 2)], schema), f"{tmp_path}/j")
    journal = files.read_journal(spark, f"{tmp_path}/j")
    sinks.append_events(journal, spark.createDataFrame([("a", "finish", None, 1), ("b", "prepare", None, 2)], schema), f"{tmp_path}/j")
    got = sorted((r.sequence, r.attempt, r.kind) for r in files.read_journal(spark, f"{tmp_path}/j").collect())
    assert got == [(0, "a", "prepare"), (1, "a", "dispatch"), (2, "a", "finish"), (3, "b", "prepare")]
    with pytest.raises(ValueError):
        sinks.append_events(files.read_journal(spark, f"{tmp_path}/j"), spark.createDataFrame([("b", "finish", None, 1)], schema), f"{tmp_path}/j")
    assert files.read_journal(spark, f"{tmp_path}/j").count() == 4


def test_configurations_change_only_as_expected(spark, tmp_path):
    path = f"{tmp_path}/c.json"
    first = sinks.save_config(spark, path, "{}", None)
    second = sinks.save_config(spark, path, '{"a": 1}', first)
    assert (tmp_path / "c.json").read_text() == '{"a": 1}' and second != first
    for wrong in (None, first):
        with pytest.raises(ValueError):
            sinks.save_config(spark, path, "x", wrong)


def test_compose_takes_models_in_order_while_there_is_room(spark):
    tasks = spark.createDataFrame([("t1", 1, True), ("t2", 2, False), ("t3", 3, True), ("t4", 4, True), ("t5", 5, True)], "task string, place int, ready boolean")
    fits = spark.createDataFrame([("t1", 0, "m1", "p"), ("t1", 1, "m2", "q"), ("t2", 0, "m1", "p"), ("t3", 0, "m1", "p"), ("t3", 1, "m2", "q"), ("t4", 0, "m1", "p")], "task string, preference int, model string, pool string")
    limits = spark.createDataFrame([("p", 1), ("q", 5)], "pool string, room int")
    got = {r.task: (r.model, r.reason) for r in effects.compose(tasks, fits, limits, 9).collect()}
    assert got == {"t1": ("m1", None), "t2": (None, "task_not_dispatch_ready"), "t3": ("m2", None), "t4": (None, "capacity"), "t5": (None, "no_supported_model")}
    assert {r.task: r.model for r in effects.compose(tasks, fits, limits, 1).collect()}["t3"] is None
