import hashlib

from pyspark.sql import functions as F

from factloom.operators import claims, evidence, imports, manifests


def test_framed_fingerprint_is_that_of_the_bytes(spark):
    rows = [("r", "b", "bytes", "two"), ("r", "a", "bytes", "één"), ("r", "c", "unreadable", None)]
    got = manifests.framed_fingerprint(spark.createDataFrame(rows, "repo string, path string, tag string, content string")).collect()
    h = hashlib.sha256()
    for _, path, tag, content in sorted(rows):
        for x in (path, tag, hashlib.sha256(content.encode()).hexdigest() if content is not None else ""):
            h.update(len(x.encode()).to_bytes(8, "big") + x.encode())
    assert [tuple(r) for r in got] == [("r", h.hexdigest())]


def test_tree_fnv_is_that_of_the_bytes(spark):
    rows = [("r", "b", b"\x00\xff"), ("r", "a", b"x"), ("r", "a", b"x"), ("s", "u", None)]
    got = {r.repo: r.fingerprint for r in manifests.tree_fnv(spark.createDataFrame(rows, "repo string, path string, content binary")).collect()}

    def fnv(data):
        h = 14695981039346656037
        for b in data:
            h = ((h ^ b) * 1099511628211) % 2**64
        return f"fnv1a64:{h:016x}"

    assert got == {"r": fnv(b"a\0x\0b\0\x00\xff\0"), "s": fnv(b"u\0unreadable:\0")}


def test_output_over_its_limit_raises(spark):
    lines = spark.createDataFrame([("abc",), ("de",)], "line string")
    assert evidence.within_bytes(lines, 7).count() == 2 and len(evidence.within_bytes(lines, 7).collect()) == 2
    try:
        evidence.within_bytes(lines, 6).collect()
    except Exception as e:  # noqa: BLE001
        assert "output over 6 bytes" in str(e)
    else:
        raise AssertionError("no error")


def test_specifier_variants_and_labels(spark):
    d = spark.createDataFrame([("./src/a/x.ts", "./src/b/index.ts"), ("./src/a/x.ts", "./src/a/y.d.ts"), ("./m.ts", "./src/z.js")], "i string, t string")
    got = [r.v for r in d.select(imports.specifier_variants(F.col("i"), F.col("t")).alias("v")).collect()]
    assert got == [["../b/index.ts", "../b/index", "../b"], ["./y.d.ts", "./y"], ["./src/z.js", "./src/z"]]
    label = F.lit("default as d, { a as b, type C }")
    row = d.select(imports.label_mentions(label, F.lit("a")).alias("a"), imports.label_mentions(label, F.lit("b")).alias("b"), imports.label_mentions(label, F.lit("C")).alias("c"), imports.exported_for(label, F.lit("d")).alias("d"), imports.template_fits(F.lit("./p/"), F.lit(".ts"), F.lit("./p/.ts")).alias("t")).first()
    assert (row.a, row.b, row.c, row.d, row.t) == (True, False, True, ["default"], False)


def test_rows_over_their_limit_raise(spark):
    rows = spark.range(5)
    assert evidence.within_rows(rows, 5).count() == 5 and [r.id for r in evidence.within_rows(rows, 5).orderBy("id").collect()] == [0, 1, 2, 3, 4]
    try:
        evidence.within_rows(rows, 4).collect()
    except Exception as e:  # noqa: BLE001
        assert "over 4 rows" in str(e)
    else:
        raise AssertionError("no error")


def test_claims_not_revoked(spark):
    got = claims.not_revoked(spark.createDataFrame([("a",), ("b",), (None,)], "bundle_id string"), spark.createDataFrame([("b",), ("b",), (None,)], "bundle_id string")).collect()
    assert sorted(r.bundle_id or "" for r in got) == ["", "a"]
