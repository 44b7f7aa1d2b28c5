import hashlib
import re

from factloom.llm import secrets

RULES = {
    "assign": (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = [(m.start(), n, k, m.end()) for n, (k, (p, f)) in enumerate(RULES.items()) for m in re.finditer(p, text or "") if f(m)]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


def check(df):
    rows = {}
    for r in secrets.scan_secrets(df).collect():
        rows.setdefault((r.doc_id, r.base), []).append(r)
        for k in RULES:
            assert r[f"n_{k}"] == len([x for x in r.base.split(",") if x.startswith(k + ":")])
        assert [x for x in r.spans.split(",") if x and not x.startswith("live:")] == [x for x in r.base.split(",") if x]
    want = [(r.doc_id, ",".join(brute(r.text))) for r in df.collect()]
    assert sorted(want, key=str) == sorted((k for k, v in rows.items() for _ in v), key=str)


def test_documents_as_brute_force(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_base_rules(spark):
    texts = ["secret: token: abcdefgh", "token=token=abcdef", "PassWord = 'abc'", "API_KEY:\"abcdef\" ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "A" * 15, "xAKIA" + "B" * 16 + "AKIA", "a" * 23 + "g" + "0" * 24, "é😀 passwd=a.b+c/d " + "f" * 30]
    check(spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, lang string"))


def test_ownership(spark):
    own, wide = "Zk3vT9qLw8XrB5nYc2Jd7HfM", "Qm4pS8tVx2LzR6wKj9Nb3GhY"
    rows = [(i, f"see {own} there", "one", "en") for i in range(4)] + [(10 + i, f"copy {wide}", f"s{i % 3}", "en") for i in range(6)] + [(20, "Example1234example1234Aa", "one", "en")]
    out = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")).collect()}
    assert all(out[i].spans == "live:4:28" and out[i].live == 1 for i in range(4))
    assert all(out[10 + i].spans == "" and out[10 + i].copied == 1 for i in range(6))
    assert out[20].spans == "" and hashlib.sha256(out[20].base.encode()).hexdigest().startswith("e3b0c442")


def test_odd_input(odd, none):
    check(odd)
    assert secrets.scan_secrets(none).count() == 0


def test_widely_copied_by_owners_and_repositories(spark):
    pair, sample = "Zk3vT9qLw8XrB5nYc2Jd7HfM", "Qm4pS8tVx2LzR6wKj9Nb3GhY"
    rows = [(i, f"see {pair} there", f"s{i}", "en") for i in range(2)] + [(10 + i, f"copy {sample}", "one", f"l{i}") for i in range(5)]
    out = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")).collect()}
    assert all(out[i].spans == "live:4:28" and out[i].live == 1 for i in range(2))
    assert all(out[10 + i].spans == "" and out[10 + i].copied == 1 for i in range(5))
