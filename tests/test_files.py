"""Trees on disk: listing, admission, ignore rules, documents, ledgers."""

import hashlib
import os
import re
import shutil
import sqlite3
import subprocess

import pytest

from factloom.sources import files

TREE = {
    "README.md": "# read me", "docs/é.mdx": "é", "docs/big.md": "x" * 500, "src/a.ts": "a", "src/b.rs": "b", "src/tests/c.py": "c", "src/node_modules/d.ts": "d", ".hidden/e.ts": "e", "src/f.txt": "f",
    "bench/g.ts": "g", "src/gen/h.ts": "h", "a b/(x)[y]/i.js": "i", "src/deep/er/j.tsx": "j", "out/k.ts": "k", "out/keep.ts": "l", "logs/m.log": "m", "src/logs/n.ts": "n", "src/o1.ts": "o", "src/ox.ts": "p", "src/deep/q.tmp.ts": "q",
}
RULES = {
    ".gitignore": "# comment\n\nout/*\n!out/keep.ts\n*.log\n/logs\n\\!odd\n[!a-n]1.ts\nsrc/**/*.tmp.ts\ntrailing   \n",
    "src/.gitignore": "logs/\no?.ts\n!o1.ts\n[!a-n]x.ts\n/deep/er\n!j.tsx\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree (1)+")
    for name, text in (TREE | RULES).items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return top


def test_listing(spark, root):
    got = {r.path: (r.length, r.sha256, bytes(r.content)) for r in files.scan_tree(spark, str(root)).collect()}
    want = {n: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest(), t.encode()) for n, t in (TREE | RULES).items()}
    assert {k: v for k, v in got.items() if k in want} == want
    assert set(want) == set(got)
    names = files.scan_tree(spark, str(root), with_content=False)
    assert names.columns == ["path", "length"] and names.count() == len(want)


def test_admission(spark, root):
    tree = files.scan_tree(spark, str(root), with_content=False)
    admitted = files.source_inventory(tree)
    got = {r.path: (r.language, r.role) for r in admitted.collect()}
    assert got["src/tests/c.py"] == ("python", "contract_test") and got["bench/g.ts"] == ("typescript", "benchmark") and got["src/gen/h.ts"] == ("typescript", "generated")
    assert set(got) == {n for n in TREE if re.search(r"\.(ts|tsx|js|rs|py)$", n)} - {"src/node_modules/d.ts", ".hidden/e.ts"}
    assert {r.path for r in files.source_inventory(tree, "product", "rust").collect()} == {"src/b.rs"}
    out = {r.path: r.reason for r in files.excluded(tree, files.source_inventory(tree, "product")).collect()}
    assert out["src/node_modules/d.ts"] == "hard_directory" and out[".hidden/e.ts"] == "hidden" and out["src/f.txt"] == "unsupported" and out["bench/g.ts"] == "policy"


def test_ignore_rules_are_those_of_git(spark, root, tmp_path):
    if not shutil.which("git"):
        pytest.skip("no git")
    work = tmp_path / "w"
    shutil.copytree(root, work)
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_NOSYSTEM": "1"}
    subprocess.run(["git", "init", "-q", str(work)], check=True, env=env)
    listed = subprocess.run(["git", "ls-files", "-z", "--others", "--exclude-standard"], cwd=work, env=env, capture_output=True, check=True).stdout.decode().split("\0")
    tree = files.scan_tree(spark, str(root))
    gone = {r.path for r in files.ignored(tree, files.ignore_rules(tree)).collect()}
    assert {r.path for r in tree.collect()} - gone == {x for x in listed if x} and gone


def test_documents(spark, root):
    tree = files.scan_tree(spark, str(root))
    assert {r.path: r.source for r in files.documents(tree).collect()} == {n: t for n, t in TREE.items() if n.endswith((".md", ".mdx"))}
    with pytest.raises(Exception, match="document over limit: docs/big.md"):
        files.documents(tree, document_bytes=100).collect()
    with pytest.raises(ValueError, match="the limit is 50"):
        files.documents(tree, total_bytes=50)


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "l.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE advice (work_item_id TEXT, requests_used INT, last_state_sha256 TEXT)")
        db.executemany("INSERT INTO advice VALUES (?, ?, ?)", [("b", 2, "0" * 64), ("a", 1, "f" * 64)])
    assert [tuple(r) for r in files.read_ledger(spark, path).collect()] == [("a", 1, "f" * 64), ("b", 2, "0" * 64)]
    with sqlite3.connect(path) as db:
        db.execute("INSERT INTO advice VALUES ('c', 3, 'x')")
    with pytest.raises(Exception, match="invalid_advice_ledger"):
        files.read_ledger(spark, path).collect()


def test_patterns():
    fits = lambda rule, path: re.match(files._pattern(rule), path) is not None
    assert fits("*.py", "a/b.py") and not fits("/*.py", "a/b.py") and fits("a/**/z", "a/z") and fits("a/**/z", "a/b/c/z") and not fits("a/*/z", "a/z")
    assert fits("**/x", "x") and fits("**/x", "a/b/x") and fits("a/**", "a/b/c") and not fits("a/**", "a") and fits("[a-c]?", "b1") and not fits("[!a-c]?", "b1") and fits(r"\*", "*") and not fits(r"\*", "x")
    assert fits("a+(b).{c}$", "a+(b).{c}$")


def test_counts_and_other_formats(spark, root):
    tree = files.scan_tree(spark, str(root))
    admitted = files.source_inventory(tree)
    got = files.inventory_counts(tree, admitted).first()
    assert got.total_file_count == len(TREE | RULES) and got.walk_file_count == got.total_file_count - 1 and got.source_read_file_count == admitted.count() and got.source_read_byte_count == admitted.count()
    formats = spark.createDataFrame([("src/f.txt", "text"), ("README.md", "markdown"), ("gone", "text")], "path string, format string")
    assert [tuple(r) for r in files.unsupported_documents(tree, formats).collect()] == [("src/f.txt", "text", "unsupported_format")]
