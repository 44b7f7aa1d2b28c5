import hashlib
from collections import defaultdict

from factloom.llm import linededup

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, chars=20, docs=3):
    key = lambda x: x.strip(WS).translate(LOWER)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(-1 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= chars and len(held[key(x)]) >= docs and max(held[key(x)]) != (-1 if d is None else d))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def check(df, *args):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in linededup.dedup_lines(df, *args).collect()]
    want = brute([(r.doc_id, r.text) for r in df.collect()], *args)
    order = lambda x: (x[0] is None, x[0] or 0, x[3])
    assert sorted(got, key=order) == sorted(want, key=order)
    return want


def test_documents_as_brute_force(spark, sf):
    want = check(spark.read.parquet(f"{sf}/documents.parquet"))
    assert any(w[2] for w in want)


def test_small_cases(spark):
    line = "A line that several documents SHARE, Ünicode"
    rows = [(i, f"own {i}\n{line if i % 2 else '  ' + line.translate(LOWER) + chr(13)}\n{line}") for i in range(5)]
    rows += [(None, line), (None, line + "\nother"), (9, line[:19] + "\n" + line[:22]), (9, line), (10, line[:22]), (11, line[:22] + "\x0b")]
    want = check(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {w[0] for w in want if w[2]} == {0, 1, 2, 3, 4, None, 9, 10}


def test_odd_input(odd, none):
    check(odd)
    check(odd, 1, 1)
    assert linededup.dedup_lines(none).count() == 0
    out = linededup.dedup_documents(odd)
    assert out.columns == odd.columns and out.count() == 9
    assert {r.n_chars == len(r.text) for r in out.collect()} == {True}
    assert hashlib.sha256(b"").hexdigest()  # digest of a document without lines
