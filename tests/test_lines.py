from pyspark.sql import functions as F

from factloom.functions import codes
from factloom.operators import lines


def brute_fences(source):
    """The opening line's number for each line in a fenced block (both fences included), else None."""
    rows = source.split("\n")
    if len(rows) > 1 and rows[-1] == "":
        rows.pop()
    out, opened, mark = [], None, ""
    for n, row in enumerate(rows, 1):
        t = row.strip()
        run = t[: len(t) - len(t.lstrip(t[0]))] if t and t[0] in "`~" else ""
        if opened is None:
            if len(run) >= 3 and not (run[0] == "`" and "`" in t[len(run) :]):
                opened, mark = n, run
            out.append(opened)
        else:
            out.append(opened)
            if run and run == t and run[0] == mark[0] and len(run) >= len(mark):
                opened = None
    return out


def test_fences_as_brute_force(spark):
    sources = ["a\n```\nx\n```\ny", "~~~~\n~~~\n```\n~~~~~\nz\n", "```a`b\nx", "````\n```\n````\n", "", "x\n~~~ r\n", "```\n``` x\n```\nq\n```"]
    d = lines.fenced(lines.lines(spark.createDataFrame(list(enumerate(sources)), "file int, source string")))
    got = {}
    for r in d.orderBy("file", "line_no").collect():
        got.setdefault(r.file, []).append(r.fence)
    assert got == {k: brute_fences(s) for k, s in enumerate(sources)}


def test_fnv1a_known_values(spark):
    d = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "s string").select("s", codes.fnv1a(F.col("s")).alias("h"))
    assert {r.s: r.h for r in d.collect()} == {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8", None: None}
