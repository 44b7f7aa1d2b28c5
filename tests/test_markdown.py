import pytest

from factloom.operators import markdown as md

DOC = """# Service Requirements
MUST keep `src/a.ts#f.g` and <b>bold</b>
MUST keep `src/a.ts#f.g`

## Details
- SHOULD run `npm run x` on `lib/b.rs`
plain words here
```ts
# not a heading
```
<div>
MUST not count
## Nor this

# API contracts
`get(x)` gives x
no code here
<!-- hidden
# hidden -->
# Architecture
Uses `src/c.py` for it.
The parser feeds the resolver in order.
Short one.
# Runbook
1. Do it `<notatag>` \\<b> <a@b.c> <http://x.y>
Contract: `src/a.ts#f` returns `1`.
# ADR 1
Decision: take it\r
~~~
```
~~~
* [X] done
"""


@pytest.fixture(scope="module")
def lines(spark):
    return md.line_states(spark.createDataFrame([("d", DOC), ("e", ""), ("n", None)], "file string, source string")).cache()


def test_states_follow_fences_and_html(lines):
    got = {r.line_no: r.state for r in lines.collect()}
    source = DOC.split("\n")
    assert [source[n - 1].strip() for n, s in sorted(got.items()) if s == "html"] == ["MUST keep `src/a.ts#f.g` and <b>bold</b>", "<div>", "MUST not count", "## Nor this", "<!-- hidden", "# hidden -->"]
    assert [source[n - 1] for n, s in sorted(got.items()) if s == "fence"] == ["```ts", "# not a heading", "```", "~~~", "```", "~~~"]


def test_starts_are_byte_offsets(lines):
    raw = DOC.encode()
    for r in lines.collect():
        assert raw[r.start : r.start + len(r.text.encode())].decode() == r.text


def test_facts(lines):
    got = {(r.kind, r.text, r.line_no, r.col, r.target, r.symbol) for r in md.facts(lines).collect()}
    assert ("symbol_ref", "src/a.ts#f.g", 3, 12, "src/a.ts", "f.g") in got and ("file_ref", "src/a.ts#f.g", 3, 12, "src/a.ts", None) in got
    assert ("command", "npm run x", 6, 15, None, None) in got and ("file_ref", "lib/b.rs", 6, 30, "lib/b.rs", None) in got
    assert {t for k, t, *_ in got if k == "heading"} == {"Service Requirements", "Details", "API contracts", "Architecture", "Runbook", "ADR 1"}
    assert [(r.text, r.checked) for r in md.facts(lines).where("kind = 'task'").collect()] == [("done", True)]
    assert [(r.target, r.symbol, r.expected, r.col) for r in md.facts(lines).where("kind = 'return_contract'").collect()] == [("src/a.ts", "f", "1", 1)]


def test_claims_follow_the_roles_of_sections(lines):
    got = [(r.line_no, r.kind) for r in md.claims(lines).orderBy("line_no").collect()]
    kinds = {}
    for n, k in got:
        kinds.setdefault(k, []).append(n)
    assert kinds == {"requirement": [3, 6], "unclassified": [7, 17, 23, 32], "api_contract": [16], "architecture_claim": [21], "ambiguous_claim": [22], "runbook_step": [25], "return_contract": [26], "adr_decision": [28]}


def test_snippets_have_language_and_title(lines):
    assert [(r.language, r.title) for r in md.snippets(lines).orderBy("line_no").collect()] == [("ts", "# not a heading"), ("", "```")]


def test_anchors_and_links(spark):
    heads = spark.createDataFrame([("a.md", 1, "Some Title!"), ("a.md", 5, "Some title"), ("b.md", 1, "X")], "file string, line_no int, title string")
    found = md.anchors(heads)
    assert {(r.file, r.anchor) for r in found.collect()} == {("a.md", "some-title"), ("a.md", "some-title-1"), ("b.md", "x")}
    links = spark.createDataFrame([("a.md", "b.md#x"), ("a.md", "b.md#y"), ("a.md", "#some-title-1"), ("a.md", "c.md"), ("a.md", "https://x")], "file string, target string")
    assert {(r.target, r.problem) for r in md.broken_links(links, heads.select("file").distinct(), found).collect()} == {("b.md#y", "no_anchor"), ("c.md", "no_file")}
