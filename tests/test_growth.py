"""What a query does grows with its input: no step makes many more rows than come in or go out."""

import time

from pyspark.sql import functions as F

from factloom.functions import scope
from factloom.operators import imports, markdown, symbols, walks
from factloom.queries import QUERIES
from factloom.queries.inputs import load, view_sql
from factloom.sources import code


def most_rows(df) -> int:
    """The most rows that one step of ``df`` put out, while all of its rows were read."""
    df._jdf.queryExecution().executedPlan().executeCollect()

    def walk(p) -> int:
        kind = p.getClass().getSimpleName()
        n = p.metrics().get("numOutputRows").get().value() if p.metrics().contains("numOutputRows") else 0
        if kind == "AdaptiveSparkPlanExec":
            inner = [p.executedPlan()]
        elif kind.endswith("QueryStageExec"):
            inner = [p.plan()]
        else:
            inner = [p.children().apply(i) for i in range(p.children().size())]
        return max([n, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_task_view_counts_nodes_before_queries_meet_them(spark):
    nodes = spark.createDataFrame([("n", "f", i % 2, i) for i in range(400)] + [("one", None, None, 7), (None, "f", 0, 8)], "name string, file string, line_no long, node_id long")
    asked = [(i, "n", None, None) for i in range(300)] + [(300, "one", None, None), (301, "one", "f", None), (302, "n", "f", 1), (303, "n", "f", 5), (304, None, None, None), (305, "n", "f", None), (306, "n", None, 0)]
    out = symbols.task_view(nodes, spark.createDataFrame(asked, "query long, name string, file string, line_no long"))
    assert most_rows(out) < 5_000
    got = {r.query: (r.outcome, r.node_id, r.candidates) for r in out.collect()}
    assert got[0] == ("ambiguous", None, 400) and got[300] == ("found", 7, 1)
    assert [got[i][0] for i in (301, 303, 304)] == ["not_found"] * 3 and [got[i][2] for i in (302, 305, 306)] == [200, 400, 200]


def test_imports_meet_the_names_that_they_bind(spark):
    nodes = spark.createDataFrame([(i, f"d{i}") for i in range(300)], "node_id long, name string")
    edges = [("imports", 9, 1, f"{{ d{i} as x, other }}", i) for i in range(300)] + [("imports", 8, 1, "*", i) for i in range(300)] + [("imports", 1, 1, "*", 0), ("imports", 9, 1, "d5", -1), ("imports", 7, 1, None, 0)]
    out = imports.import_rows(nodes, spark.createDataFrame(edges, "kind string, src long, dst long, label string, seq long"), nodes.selectExpr("node_id", "1L AS file_id"))
    assert most_rows(out) < 5_000
    got = {(r.node_id, r.file_id): r.label for r in out.collect()}
    assert len(got) == 600 and got[4, 9] == "{ d4 as x, other }" and got[5, 9] == "d5" and got[4, 8] == "*"


def test_a_report_of_over_12_mib_is_whole(spark, tmp_path):
    spark.range(500_000).selectExpr("id AS o_orderkey", "id AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "n")], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    out = QUERIES["render_report"](spark, str(tmp_path))
    assert out.selectExpr("count(*)", "max(place)", "sum(octet_length(line)) > 12 << 20").first() == (500_006, 500_006, True)


def test_a_chain_of_over_16_links_has_no_gap(spark):
    """As its SQL has it: a gap is a base that isn't there. That the chain goes on is told apart."""
    rows = [(f"k{i}", f"k{i - 1}" if i else None, "v" if i == 0 else None) for i in range(20)] + [("lost", "none", None), ("round", "round", None)]
    got = {r.config: (r.value, r.gap, r.too_deep) for r in walks.config_chain(spark.createDataFrame(rows, "config string, base string, value string")).collect()}
    assert got["k15"] == ("v", None, False) and got["k16"] == ("v", None, False) and got["k17"] == (None, None, True)
    assert got["lost"] == (None, "none", False) and got["round"] == (None, None, True)


def test_files_are_scanned_once_and_by_all_cores(spark, sf):
    files = spark.createDataFrame([(f"{i}.ts", "function f() { return 1; }", "typescript") for i in range(50)], "path string, source string, language string").coalesce(1)
    assert code.events(files).rdd.getNumPartitions() > 4
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan(code.literal_returns(code.events(files)))
    for name in ("re_exports", "registry_exports", "provider_tables", "rust_impls", "linked_uses"):
        assert "MapInArrow" not in plan(QUERIES[name](spark, sf))


def test_the_journal_is_numbered_by_ranges(spark, sf):
    j = load(spark, sf, "journal")
    assert "windowspecdefinition(ts" not in j._jdf.queryExecution().optimizedPlan().toString()
    told = spark.sql(view_sql("journal", "spark").replace("FROM events", f"FROM parquet.`{sf}/events.parquet`"))
    assert j.schema.simpleString() == told.schema.simpleString() and j.exceptAll(told).isEmpty() and told.exceptAll(j).isEmpty()


def test_possible_loads_are_not_shuffled(spark):
    files = [(f"f{i}", "./a/x${n}.ts") for i in range(200)] + [("two", "./a/x${n}.ts"), ("two", "./a/${n}.ts"), ("./a/x1.ts", "./a/x${n}.ts"), (None, "./a/x${n}.ts"), ("none", "./a/${a}/${b}")]
    targets = [(f"./a/x{i}.ts", v) for i in range(100) for v in (f"./a/x{i}.ts", f"./a/x{i}.js")] + [("./a/y.ts", "./a/y.ts"), ("./b/x1.ts", "./b/x1.ts")]
    out = symbols.possible_loads(spark.createDataFrame(files, "file string, specifier string"), spark.createDataFrame(targets, "target string, variant string"))
    want = [(f"f{i}", f"./a/x{j}.ts") for i in range(200) for j in range(100)] + [("two", f"./a/x{j}.ts") for j in range(100)] + [("two", "./a/y.ts")] + [("./a/x1.ts", f"./a/x{j}.ts") for j in range(100) if j != 1]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert plan[0].startswith("Union")


def test_claims_are_parsed_once(spark):
    d = spark.createDataFrame([("src/./a//b", "src/a/../a"), ("../x", "../../x"), (None, "")], "a string, b string")
    a, b = scope.parse(F.col("a")), scope.parse(F.col("b"))
    out = {"covers": scope.covers(a, b), "overlaps": scope.overlaps(a, b), "text": scope.text(a), "normalized": scope.normalized(F.array("a", "b"))}
    for k, v in out.items():
        plan = d.select(v.alias(k))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lambdafunction(") < 20, k
    got = d.select(*[v.alias(k) for k, v in out.items()]).collect()
    assert [(r.covers, r.overlaps, r.text) for r in got] == [(False, True, "src/a/b"), (False, True, "../x"), (None, None, None)]
    assert got[0].normalized == ["src/a/b", "src/a"] and got[1].normalized == ["../x", "../../x"]


def test_a_line_of_many_tags_is_scanned_once():
    line = "z" + "<p>x</p>y" * 8_000
    began = time.process_time()
    assert [s[3] for s in markdown.states(line + "\n`<p>` \\<p>\n")] == ["html", "text"]
    assert time.process_time() - began < 3


def test_a_walk_writes_one_table_a_round(spark, monkeypatch):
    """And ends where a circle's places are met again."""
    n, kept = [0], walks.written
    monkeypatch.setattr(walks, "written", lambda df: n.__setitem__(0, n[0] + 1) or kept(df))
    commits = [(i, p) for i in range(41) for p in (i - 1, i - 2) if p >= 0] + [(100 + i, 100 + (i + d) % 5) for i in range(5) for d in (1, 2)] + [(200, None)]
    out = walks.change_order(spark.createDataFrame([(1, 40, 1), (2, 3, 17), (3, 100, 40), (4, 102, 101), (5, 200, 40), (6, 7, 999)], "pair_id long, section long, reference long"), spark.createDataFrame(commits, "commit long, parent long"))
    assert n[0] < 45
    got = dict(map(tuple, out.collect()))
    assert got == {1: "reference_before_section", 2: "section_before_reference", 3: "diverged", 4: "section_before_reference", 5: "diverged", 6: "unknown"}
