"""Evidence, reports, fingerprints and inventories: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import jsonc
from factloom.operators import evidence, manifests, markdown
from factloom.queries.inputs import FNV
from factloom.queries.relational import query
from factloom.queries.scalars import ROLE
from factloom.sources import code, files

c = F.col
_KINDS = ("requirement", "doc_page", "api_contract", "code_reference", "doc_section")
_NODES = "n AS (SELECT 'e' || o_orderkey AS evidence_id, 'f' || (o_custkey % 9) AS file, ['requirement', 'doc_page', 'api_contract', 'code_reference', 'doc_section'][o_orderkey % 5 + 1] AS kind, CASE WHEN o_orderkey % 7 <> 0 THEN 'p' || (o_custkey % 4) END AS parent, CASE WHEN o_orderkey % 3 = 0 THEN 't' || o_custkey END AS target, CASE WHEN o_orderkey % 4 = 0 THEN 's' END AS symbol, o_orderpriority AS title FROM orders)"


def _nodes(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    name = lambda p, x: F.concat(F.lit(p), x)
    return o.select(
        name("e", k).alias("evidence_id"), name("f", c("o_custkey") % 9).alias("file"), F.get(F.array(*map(F.lit, _KINDS)), (k % 5).cast("int")).alias("kind"), F.when(k % 7 != 0, name("p", c("o_custkey") % 4)).alias("parent"),
        F.when(k % 3 == 0, name("t", c("o_custkey"))).alias("target"), F.when(k % 4 == 0, "s").alias("symbol"), c("o_orderpriority").alias("title"),
    )


_CLAIM = "kind IN ('requirement', 'api_contract')"


@query("orders", sql=f"""WITH {_NODES} SELECT evidence_id, CASE WHEN {_CLAIM} THEN 'doc_claims' ELSE 'doc_facts' END AS "table", coalesce(parent, CASE WHEN NOT {_CLAIM} THEN 'doc:' || file END) AS subject, CASE kind WHEN 'doc_page' THEN 'defines_page' WHEN 'doc_section' THEN 'defines_section' WHEN 'code_reference' THEN 'references_code' END AS predicate,
  CASE WHEN kind = 'code_reference' AND (target IS NOT NULL OR symbol IS NOT NULL) THEN concat_ws('#', target, symbol) ELSE title END AS object, CASE WHEN {_CLAIM} THEN 'unverified' END AS status FROM n""")
def claims_and_facts(o: DataFrame) -> DataFrame:
    return evidence.claims_and_facts(_nodes(o))


@query("orders", "customer", sql=f"""WITH {_NODES}, v AS (SELECT 'e' || o_orderkey AS evidence_id, CASE o_orderkey % 2 WHEN 0 THEN 'stale' ELSE 'verified' END AS got FROM orders WHERE o_orderkey % 3 = 1)
SELECT n.evidence_id, CASE WHEN {_CLAIM} THEN 'doc_claim' ELSE 'doc_fact' END AS kind, CASE WHEN {_CLAIM} THEN coalesce(got, 'unverified') ELSE 'decoded' END AS proof_status, CASE WHEN NOT {_CLAIM} THEN 'high' WHEN got = 'stale' THEN 'low' WHEN got = 'verified' THEN 'high' ELSE 'medium' END AS confidence FROM n LEFT JOIN v ON v.evidence_id = n.evidence_id
UNION ALL SELECT 'd' || c_custkey, 'doc_diagnostic', 'diagnostic', 'high' FROM customer""")
def evidence_shapes(o: DataFrame, cu: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    v = o.where(k % 3 == 1).select(F.concat(F.lit("e"), k).alias("evidence_id"), F.when(k % 2 == 0, "stale").otherwise("verified").alias("status"))
    return evidence.shapes(_nodes(o), cu.select(F.concat(F.lit("d"), "c_custkey").alias("evidence_id")), v)


@query("orders", "customer", sql="SELECT DISTINCT unnest(['e' || (o_orderkey % 500), 'x' || (o_custkey % 40), 'y']) AS evidence_id FROM orders UNION SELECT 'x' || c_custkey FROM customer WHERE c_custkey % 3 = 0")
def all_evidence_ids(o: DataFrame, cu: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    a = o.select(F.concat(F.lit("e"), k % 500).alias("evidence_id"), F.array(F.concat(F.lit("x"), c("o_custkey") % 40), F.lit("y")).alias("evidence_ids"))
    return evidence.all_ids(a, cu.select(F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("x"), "c_custkey")).alias("evidence_id")))


@query("customer", sql="SELECT c_custkey AS repo, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 7 = 0 THEN 'unknown' ELSE 'fresh' END AS freshness FROM customer")
def graph_freshness(cu: DataFrame) -> DataFrame:
    r = c("c_custkey")
    return evidence.graph_freshness(cu.select(r.alias("repo"), F.lit("a").alias("decode"), F.when(r % 3 == 0, "").otherwise("b").alias("graph"), F.when(r % 7 != 0, "t").alias("truth"), F.lit("x").alias("capability"), F.lit("y").alias("verification")))


@query("customer", "orders", sql="SELECT c_custkey AS claim_id, CASE WHEN count(o_orderkey) = 0 THEN 'verified' ELSE 'contradicted' END AS status, count(o_orderkey) AS silent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 11 = 0 GROUP BY c_custkey")
def truth_verdicts(cu: DataFrame, o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    return evidence.truth_verdicts(cu.select(c("c_custkey").alias("claim_id")), o.select(c("o_custkey").alias("claim_id"), F.when(k % 11 == 0, "silent_divergence").otherwise("explained").alias("classification")))


@query("customer", "orders", sql="""WITH g AS (SELECT o_custkey, bool_or(o_orderkey % 29 = 0) AS bad, bool_or(o_orderkey % 2 = 0) AS yes, list(DISTINCT 'x' || (o_orderkey % 3)) AS more FROM orders WHERE o_orderkey % 5 = 0 GROUP BY o_custkey)
SELECT c_custkey AS claim_id, CASE WHEN bad THEN 'contradicted' WHEN yes AND c_custkey % 3 = 0 THEN 'verified' ELSE ['unverified', 'stale', 'unknown'][c_custkey % 3 + 1] END AS status, array_to_string(list_sort(list_distinct(['c'] || coalesce(more, []))), ',') AS evidence_ids FROM customer LEFT JOIN g ON o_custkey = c_custkey""")
def apply_contract_checks(cu: DataFrame, o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    v = cu.select(c("c_custkey").alias("claim_id"), F.get(F.array(F.lit("unverified"), F.lit("stale"), F.lit("unknown")), (c("c_custkey") % 3).cast("int")).alias("status"), F.array(F.lit("c")).alias("evidence_ids"))
    checks = o.where(k % 5 == 0).select(c("o_custkey").alias("claim_id"), F.when(k % 29 == 0, "contradicted").when(k % 2 == 0, "verified").otherwise("unknown").alias("status"), F.array(F.concat(F.lit("x"), k % 3)).alias("evidence_ids"))
    # An even multiple of 29 is a contradiction, and contradictions win anyway.
    return evidence.apply_checks(v, checks).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


_FACTS = "f AS (SELECT 't' || (l_partkey % 30) AS target, 'f' || (l_orderkey % 40) AS file, l_linenumber AS start, CASE WHEN l_suppkey % 3 = 0 THEN 'x' END AS expected, CASE WHEN l_suppkey % 3 < 2 THEN 's' || (l_suppkey % 2) END AS symbol, CASE l_suppkey % 3 WHEN 0 THEN 'return_contract' WHEN 1 THEN 'symbol_ref' ELSE 'file_ref' END AS kind FROM lineitem)"


def _facts(li: DataFrame) -> DataFrame:
    s = c("l_suppkey")
    return li.select(F.concat(F.lit("t"), c("l_partkey") % 30).alias("target"), F.concat(F.lit("f"), c("l_orderkey") % 40).alias("file"), c("l_linenumber").alias("start"), F.when(s % 3 == 0, "x").alias("expected"), F.when(s % 3 < 2, F.concat(F.lit("s"), s % 2)).alias("symbol"), F.when(s % 3 == 0, "return_contract").when(s % 3 == 1, "symbol_ref").otherwise("file_ref").alias("kind"))


@query("lineitem", "nation", sql=f"WITH {_FACTS} SELECT target, file, start, arg_min(kind, CASE kind WHEN 'return_contract' THEN 0 WHEN 'symbol_ref' THEN 1 ELSE 2 END) AS kind FROM f WHERE target IN (SELECT 't' || n_nationkey FROM nation) GROUP BY target, file, start")
def dependents(li: DataFrame, n: DataFrame) -> DataFrame:
    return evidence.dependents(_facts(li), n.select(F.concat(F.lit("t"), "n_nationkey").alias("target")))


@query("lineitem", sql=f"WITH {_FACTS} SELECT target, symbol, string_agg(DISTINCT file || ':' || start, ',' ORDER BY file || ':' || start) AS places FROM f WHERE kind <> 'return_contract' GROUP BY target, symbol")
def reference_candidates(li: DataFrame) -> DataFrame:
    out = evidence.reference_candidates(_facts(li).withColumn("line_no", c("start")).withColumn("col", F.lit(1)))
    return out.select("target", "symbol", F.array_join(F.array_sort(F.transform("places", lambda p: F.concat(p["file"], F.lit(":"), p["line_no"].cast("string")))), ",").alias("places"))


@query("lineitem", sql=f"WITH {_FACTS}, d AS (SELECT DISTINCT target, symbol, substr(target, 2)::INT AS n FROM f WHERE kind <> 'return_contract') SELECT target, symbol, CASE n % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'gap' ELSE 'unresolved' END AS outcome, n % 4 < 2 AS known, CASE n % 4 WHEN 0 THEN NULL WHEN 1 THEN 'r' WHEN 2 THEN 'r' ELSE 'not_found' END AS reason FROM d")
def known_references(li: DataFrame) -> DataFrame:
    d = evidence.reference_candidates(_facts(li).withColumn("line_no", c("start")).withColumn("col", F.lit(1))).select("target", "symbol")
    n = F.substring("target", 2, 9).cast("int")
    return evidence.known_references(d, d.where(n % 4 < 3).withColumn("outcome", F.when(n % 4 == 0, "resolved").when(n % 4 == 1, "gap").otherwise("unresolved")).withColumn("reason", F.lit("r")))


@query("orders", "customer", sql="""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 OR o_custkey % 5 = 0 THEN 'unresolved' WHEN o_orderkey % 3 = 0 THEN 'resolved' WHEN o_custkey % 6 = 0 THEN 'gap' WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 = 0 THEN 'unresolved' WHEN o_orderkey % 3 = 2 AND o_orderkey % 4 = 1 THEN 'unresolved' WHEN o_orderkey % 3 = 1 THEN 'gap' ELSE 'resolved' END AS outcome,
  CASE WHEN o_orderkey % 7 = 0 THEN 'invalid_path' WHEN o_custkey % 5 = 0 THEN 'file_not_found' WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_custkey % 6 = 0 THEN 'file_incomplete' WHEN o_orderkey % 3 = 1 AND o_orderkey % 4 = 0 THEN 'symbol_not_found' WHEN o_orderkey % 3 = 2 AND o_orderkey % 4 = 1 THEN 'owner_not_found' WHEN o_orderkey % 3 = 1 THEN 'symbol_ambiguous' END AS reason,
  CASE WHEN o_orderkey % 7 <> 0 AND o_custkey % 5 <> 0 AND o_orderkey % 3 = 2 AND o_custkey % 6 <> 0 AND o_orderkey % 4 <> 1 THEN o_custkey * 10 + 1 END AS node_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def resolve_references(o: DataFrame, cu: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    target = F.concat(F.when(k % 7 == 0, "/").otherwise("./"), F.lit("f"), c("o_custkey"))
    symbol = F.when(k % 3 == 1, F.when(k % 4 == 0, "none").otherwise("g")).when(k % 3 == 2, F.when(k % 4 == 1, "C.g").otherwise("A.g"))
    r = o.join(cu, k.isNotNull() & (c("o_custkey") == c("c_custkey")), "left_semi").select(k.alias("id"), target.alias("target"), symbol.alias("symbol"))
    f = cu.where("c_custkey % 5 <> 0")
    path = F.concat(F.lit("f"), c("c_custkey")).alias("path")
    nodes = f.select(path, F.explode(F.array(*[F.struct((c("c_custkey") * 10 + n).alias("node_id"), F.lit("g").alias("name"), F.lit(w).alias("owner")) for n, w in ((1, "A"), (2, "B"))])).alias("x")).select("path", "x.*")
    return evidence.resolve_references(r, f.select(path, (c("c_custkey") % 6 != 0).alias("complete")), nodes)


@query("orders", sql="SELECT DISTINCT unnest([file, target]) AS path FROM (SELECT 'd' || (o_custkey % 50) AS file, 's' || (o_orderkey % 70) AS target FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY 'd' || (o_custkey % 50), o_orderkey LIMIT 64)")
def history_paths(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    return evidence.history_paths(o.select(F.concat(F.lit("d"), c("o_custkey") % 50).alias("file"), F.concat(F.lit("s"), k % 70).alias("target"), k.alias("start"), (k % 3 != 0).alias("resolved")))


@query("lineitem", "orders", sql="SELECT o_orderkey AS id, arg_max(l_partkey, l_partkey * 10000 + l_suppkey) AS \"commit\" FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber BETWEEN 2 AND 2 + o_custkey % 3 GROUP BY o_orderkey")
def line_changes(li: DataFrame, o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    h = li.select(c("l_orderkey").alias("path"), c("l_linenumber").alias("line_no"), c("l_partkey").alias("commit"), (c("l_partkey") * 10000 + c("l_suppkey")).alias("seq"))
    return evidence.line_changes(o.select(k.alias("id"), k.alias("path"), F.lit(2).alias("first"), (2 + c("o_custkey") % 3).cast("int").alias("last")), h)


@query("modtree", sql=", w AS (SELECT module AS node_id, parent AS at, 1 AS n FROM modtree UNION ALL SELECT w.node_id, m.parent, n + 1 FROM w JOIN modtree m ON m.module = w.at WHERE w.at % 3 <> 0) SELECT module AS node_id, max(w.at) FILTER (WHERE w.at % 3 = 0) AS section_id FROM modtree JOIN w ON w.node_id = module GROUP BY module")
def section_of(m: DataFrame) -> DataFrame:
    return evidence.section_of(m.select(c("module").alias("node_id"), "parent", F.when(c("module") % 3 == 0, "doc_section").otherwise("requirement").alias("kind")))


_DIAG = ("unresolved_reference", "unsupported_syntax", "contract_source_read_failed", "document_excluded")


def _diagnostics(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    return o.select(F.get(F.array(*map(F.lit, _DIAG)), (k % 4).cast("int")).alias("code"), F.concat(F.lit("f"), c("o_custkey") % 9).alias("file"), F.concat(F.lit("e"), k).alias("evidence_id"))


@query("orders", "customer", sql="""SELECT ['unsupported_syntax', 'contract_source_read_failed', 'document_excluded'][o_orderkey % 4] AS code, ['unsupported_construct', 'truth_source_gap', 'coverage_exclusion'][o_orderkey % 4] AS classification, CASE o_orderkey % 4 WHEN 2 THEN 'docs.return_contracts' ELSE 'docs.claims' END AS surface, 'f' || (o_custkey % 9) AS file, 'warning' AS severity FROM orders WHERE o_orderkey % 4 > 0
UNION ALL SELECT 'docs_claim_unverified', 'truth_source_gap', 'docs.claims', 'f' || c_custkey, 'warning' FROM customer""")
def report_diagnostics(o: DataFrame, cu: DataFrame) -> DataFrame:
    return evidence.report_diagnostics(_diagnostics(o), cu.select(F.concat(F.lit("f"), "c_custkey").alias("file")))


@query("orders", "customer", sql="SELECT kind, severity, path, count(*) AS n FROM (SELECT 'docs_return_contract_mismatch' AS kind, 'high' AS severity, 'f' || (c_custkey % 5) AS path FROM customer UNION ALL SELECT 'docs_code_reference_unresolved', 'medium', 'f' || (o_custkey % 9) FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'docs_claim_stale', 'medium', 'f' || (c_custkey % 11) FROM customer) GROUP BY ALL")
def report_cards(o: DataFrame, cu: DataFrame) -> DataFrame:
    at = lambda x: cu.select(F.concat(F.lit("f"), x).alias("file"), F.concat(F.lit("c"), "c_custkey").alias("evidence_id"), "c_custkey")
    return evidence.report_cards(at(c("c_custkey") % 5), _diagnostics(o), at(c("c_custkey") % 11)).groupBy("kind", "severity", "path").agg(F.count(F.lit(1)).alias("n"))


@query("orders", "nation", sql="""WITH l AS (SELECT 0 AS part, '# Documentation truth' AS line UNION ALL SELECT 2, '## Drifts' UNION ALL SELECT 4, '## Diagnostics' UNION ALL SELECT 1, unnest(['- drifts: ' || (SELECT count(*) FROM nation), '- orders: ' || (SELECT count(*) FROM orders)])
  UNION ALL SELECT 3, '- `f' || n_nationkey || '`: expected `1`, found `' || n_name || '`' FROM nation UNION ALL SELECT 5, '- `f' || (o_custkey % 9) || '`: ' || ['unresolved_reference', 'unsupported_syntax', 'contract_source_read_failed', 'document_excluded'][o_orderkey % 4 + 1] FROM orders)
SELECT row_number() OVER (ORDER BY part, line) AS place, line FROM l""")
def render_report(o: DataFrame, n: DataFrame) -> DataFrame:
    drifts = n.select(F.concat(F.lit("f"), "n_nationkey").alias("file"), F.lit("1").alias("expected"), c("n_name").alias("actual"))
    score = n.agg(F.count(F.lit(1)).alias("drifts")).withColumn("orders", o.agg(F.count(F.lit(1))).scalar())
    return evidence.render(score, drifts, _diagnostics(o))


_LINES = ("const x: {} = 1", "f(a: number): {} {{", "type A<T extends {}> = T", "y satisfies {}", "Map<{}, b>", "let z = {}['k']", "T extends {} ? 1 : 2", "Layer.of({})", "import {}", "keyof {}", "a{}b: x")
_LEVELS = ("medium", "high", "high", "high", "medium", "high", "high", "high", "low", "high", "low")
_REASONS = ("parameter_property_annotation", "return_type_contract", "generic_constraint", "satisfies_type_contract", "generic_type_argument", "mapped_keyof_indexed_type_contract", "conditional_type_contract", "layer_provider_type_contract", "type_reference", "mapped_keyof_indexed_type_contract", "type_reference")


@query("orders", sql=f"SELECT DISTINCT 'f' || (o_custkey % 7) AS file, o_orderkey % 100 AS line_no, CASE WHEN o_orderkey % 10 = 0 THEN 'high' ELSE {list(_LEVELS)}[o_orderkey % 11 + 1] END AS level, CASE WHEN o_orderkey % 10 = 0 THEN 'heritage_contract' ELSE {list(_REASONS)}[o_orderkey % 11 + 1] END AS reason FROM orders WHERE o_orderkey % 10 < 8")
def pressure_rows(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    text = F.get(F.array(*[F.lit(x.format("Nm").replace("{{", "{")) for x in _LINES]), (k % 11).cast("int"))
    kind = F.when(k % 10 == 0, "extends").when(k % 10 < 8, "type_ref").otherwise("calls")
    return evidence.pressure_rows(o.select(F.concat(F.lit("f"), c("o_custkey") % 7).alias("file"), (k % 100).alias("line_no"), kind.alias("kind"), text.alias("line"), F.lit("Nm").alias("name"), k.alias("seq"))).drop("seq")


@query("orders", sql="SELECT DISTINCT 'f' || (o_custkey % 9) AS file, o_orderkey AS line_no, 'b' || (o_orderkey % 5) AS binding, 'go' AS method FROM orders WHERE o_orderkey % 5 IN (0, 2) AND o_custkey % 9 % 2 = 0")
def service_calls(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    lines = o.select(F.concat(F.lit("f"), c("o_custkey") % 9).alias("file"), k.alias("line_no"), F.concat(F.lit("x = b"), k % 5, F.lit(".go (1) + b"), k % 5, F.lit(".stop")).alias("text"))
    b = lines.where(c("file").isin("f0", "f2", "f4", "f6", "f8")).select("file", F.explode(F.array(F.lit("b0"), F.lit("b2"), F.lit("q"))).alias("binding"))
    return evidence.service_calls(b, lines)


@query("orders", sql="SELECT 'f' || (o_custkey % 9) AS file, o_orderkey AS line_no, 'p' || CASE WHEN o_custkey % 9 % 2 = 0 THEN 1 ELSE 0 END AS provider, CASE WHEN o_custkey % 9 % 2 = 0 THEN 'composed' ELSE 'missing_composition' END AS status FROM orders WHERE o_orderkey % 3 = 0")
def provider_context(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    calls = o.select(F.concat(F.lit("f"), c("o_custkey") % 9).alias("file"), k.alias("line_no"), F.concat(F.lit("s"), k % 3).alias("service"))
    providers = calls.sparkSession.createDataFrame([("s0", "p0"), ("s0", "p1")], "service string, provider string")
    return evidence.provider_context(calls, providers, calls.where(c("file").isin("f0", "f2", "f4", "f6", "f8")).select("file", F.lit("p1").alias("provider")))


# Fingerprints and inventories


@query("orders", sql="SELECT o_custkey AS repo, sha256(string_agg('f' || o_orderkey || chr(0) || 'h' || (o_orderkey % 9) || chr(0), '' ORDER BY 'f' || o_orderkey)) AS fingerprint FROM orders GROUP BY o_custkey")
def world_fingerprint(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    return manifests.world_fingerprint(o.select(c("o_custkey").alias("repo"), F.concat(F.lit("f"), k).alias("file"), F.concat(F.lit("h"), k % 9).alias("hash")))


_FRAMED = "lpad(to_hex(strlen({0})), 16, '0') || hex({0})"


@query("documents", sql=f"""WITH f AS (SELECT source AS repo, doc_id::VARCHAR AS path, sha256(text) AS digest FROM documents)
SELECT repo, sha256(unhex(string_agg({_FRAMED.format('path')} || {_FRAMED.format("'bytes'")} || {_FRAMED.format('digest')}, '' ORDER BY path))) AS fingerprint FROM f GROUP BY repo""")
def framed_fingerprint(d: DataFrame) -> DataFrame:
    return manifests.framed_fingerprint(d.select(c("source").alias("repo"), c("doc_id").cast("string").alias("path"), F.lit("bytes").alias("tag"), c("text").alias("content")))


@query("orders", sql=f"""WITH f AS (SELECT o_custkey % 40 AS repo, 'f' || o_orderkey AS path, o_orderpriority AS content FROM orders), b AS (SELECT repo, string_agg(hex(path) || '00' || hex(content) || '00', '' ORDER BY path) AS bytes FROM f GROUP BY repo)
SELECT repo, 'fnv1a64:' || lpad(lower(to_hex({FNV.format('bytes')})), 16, '0') AS fingerprint FROM b""")
def tree_fnv(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    return manifests.tree_fnv(o.select((c("o_custkey") % 40).alias("repo"), F.concat(F.lit("f"), k).alias("path"), c("o_orderpriority").alias("content")))


@query("documents", sql="SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'extra' WHEN doc_id % 11 = 0 THEN 'link' ELSE 'changed' END AS problem FROM documents WHERE (doc_id % 7 = 0) <> (doc_id % 5 = 0) OR (doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND (doc_id % 11 = 0 OR doc_id % 13 = 0))")
def manifest_errors(d: DataFrame) -> DataFrame:
    i = c("doc_id")
    files = d.where(i % 7 != 0).select(i.cast("string").alias("path"), F.sha2(F.concat("text", F.when(i % 13 == 0, "!").otherwise("")), 256).alias("sha256"), (i % 11 == 0).alias("is_link"))
    return manifests.manifest_errors(files, d.where(i % 5 != 0).select(i.cast("string").alias("path"), F.sha2("text", 256).alias("sha256")))


@query("orders", sql="SELECT o_custkey AS path, 'captured' AS side FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderkey % 9 <> 0) UNION ALL SELECT -1, 'again'")
def observation_changes(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    one = o.select(F.lit(-1).cast("bigint").alias("path")).limit(1)
    return manifests.observation_changes(o.select(c("o_custkey").alias("path")), o.where(k % 9 != 0).select(c("o_custkey").alias("path")).unionByName(one))


@query("part", "paths", sql="SELECT outcome, count(*) AS n FROM (SELECT DISTINCT path, CASE WHEN starts_with(path, '/') OR regexp_matches(path, '(^|/)(\\.|\\.\\.|\\.[^/]*)?(/|$)') OR regexp_matches(path, '(^|/)(node_modules|venv|target|dist|coverage|build|__pycache__)(/|$)') THEN 'shape' WHEN regexp_matches(lower(path), '[^/]\\.py$') THEN 'skipped_extension' WHEN regexp_matches(lower(path), '[^/]\\.(tsx?|js|rs)$') THEN 'admitted' ELSE 'unsupported' END AS outcome FROM paths) GROUP BY outcome")
def git_inventory(_: DataFrame, p: DataFrame) -> DataFrame:
    return manifests.git_inventory(p).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("part", sql="""WITH f AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'x/src/' ELSE 'a/b/c/' END || CASE p_size % 4 WHEN 0 THEN 'index.ts' WHEN 1 THEN 'main.rs' WHEN 2 THEN 'mod.rs' ELSE 'other' || p_size || '.ts' END AS path FROM part),
r AS (SELECT path, CASE WHEN regexp_matches(path, '(^|/)src/main\\.rs$') THEN 0 WHEN path LIKE '%/mod.rs' THEN 2 WHEN path = 'src/index.ts' THEN 1 END AS rank FROM f), s AS (SELECT path FROM f WHERE path LIKE 'a/b/c/other%')
SELECT path FROM s UNION ALL SELECT path FROM (SELECT path FROM r WHERE rank IS NOT NULL ORDER BY rank, path LIMIT greatest(0, 64 - (SELECT count(*) FROM s)))""")
def working_set(p: DataFrame) -> DataFrame:
    i, z = c("p_partkey"), c("p_size")
    path = F.concat(F.when(i % 3 == 0, "src/").when(i % 3 == 1, "x/src/").otherwise("a/b/c/"), F.when(z % 4 == 0, "index.ts").when(z % 4 == 1, "main.rs").when(z % 4 == 2, "mod.rs").otherwise(F.concat(F.lit("other"), z, F.lit(".ts"))))
    f = p.select(path.alias("path")).distinct().withColumn("language", F.when(c("path").endswith(".rs"), "rust").otherwise("typescript")).withColumn("role", F.lit("product"))
    return manifests.working_set(f, f.where("path like 'a/b/c/other%'"))


@query("lineitem", sql="SELECT l_orderkey AS package, 'd' || (l_partkey % 20) AS name, CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_partkey % 20 < 15 THEN 'w' || (l_partkey % 20) END ELSE 'v' || l_linenumber END AS version, CASE WHEN l_suppkey % 2 = 0 AND l_partkey % 20 < 15 THEN 'p' END AS path FROM lineitem")
def dependencies(li: DataFrame) -> DataFrame:
    d = li.select(c("l_orderkey").alias("package"), F.concat(F.lit("d"), c("l_partkey") % 20).alias("name"), F.concat(F.lit("v"), "l_linenumber").alias("version"), F.lit(None).cast("string").alias("path"), (c("l_suppkey") % 2 == 0).alias("inherited"))
    w = d.select("name").distinct().withColumn("n", F.substring("name", 2, 9).cast("int")).where("n < 15")
    return manifests.dependencies(d, w.select("name", F.concat(F.lit("w"), "n").alias("version"), F.lit("p").alias("path")))


@query("part", sql="SELECT path, CASE WHEN starts_with(path, 'src/a1/') THEN 'corpus' WHEN starts_with(path, 'src/a2/') OR starts_with(path, 'src/a1') THEN 'benchmark' WHEN path LIKE '%/tests/%' THEN 'contract_test' ELSE 'product' END AS role FROM (SELECT DISTINCT 'src/a' || (p_partkey % 4) || CASE p_size % 2 WHEN 0 THEN '/tests/' ELSE '/lib/' END || 'f' || (p_partkey % 50) || '.ts' AS path FROM part)")
def marked_roles(p: DataFrame) -> DataFrame:
    f = p.select(F.concat(F.lit("src/a"), c("p_partkey") % 4, F.when(c("p_size") % 2 == 0, "/tests/").otherwise("/lib/"), F.lit("f"), c("p_partkey") % 50, F.lit(".ts")).alias("path")).distinct()
    return manifests.marked_roles(f, f.sparkSession.createDataFrame([(1, "./src/a1/**", "corpus"), (2, "src/a2/*", "benchmark"), (3, "src/a1/lib", "generated")], "ordinal int, path string, role string"))


@query("orders", "customer", sql="""WITH r AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'Bad ' || o_orderkey ELSE 'k' || (o_orderkey - o_orderkey % 2) END AS key, o_custkey FROM orders), p AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM r)
SELECT DISTINCT key, CASE WHEN key IS NULL THEN 'missing' WHEN NOT regexp_matches(key, '^[a-z][a-z0-9_-]{0,63}$') THEN 'malformed' ELSE 'repeated' END AS problem FROM p WHERE key IS NULL OR key LIKE 'Bad%' OR n > 1 UNION ALL SELECT DISTINCT key, 'no_parent' FROM r WHERE o_custkey % 10 = 0""")
def config_violations(o: DataFrame, cu: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    key = F.when(k % 13 == 0, None).when(k % 7 == 0, F.concat(F.lit("Bad "), k)).otherwise(F.concat(F.lit("k"), k - k % 2))
    return manifests.config_violations(o.select(key.alias("id"), "o_custkey"), "id", o.where("o_custkey % 10 <> 0").select(c("o_custkey").alias("id")).distinct(), "o_custkey")


# Trees

_SHAPE = "NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)(\\.[^/]*)?(/|$)') AND NOT regexp_matches(path, '(^|/)(node_modules|venv|target|dist|coverage|build|__pycache__)(/|$)')"
_LANGUAGE = "CASE WHEN e IN ('ts', 'tsx', 'js') THEN 'typescript' WHEN e = 'rs' THEN 'rust' WHEN e = 'py' THEN 'python' END"
_TREE = f"SELECT *, {_SHAPE} AS shaped, {_LANGUAGE} AS language, {ROLE} AS role FROM (SELECT id, path, string_split(lower(path), '/') AS p, lower(regexp_extract(path, '[^/][.]([^./]+)$', 1)) AS e FROM paths)"


@query("part", "paths", sql=f"SELECT id, path, language, role FROM ({_TREE}) WHERE shaped AND language IS NOT NULL AND role IN ('product', 'contract_test')")
def source_inventory(_: DataFrame, p: DataFrame) -> DataFrame:
    return files.source_inventory(p, "product")


@query("part", "paths", sql=f"""SELECT path, CASE WHEN regexp_matches(path, '(^|/)(node_modules|venv|target|dist|coverage|build|__pycache__)(/|$)') THEN 'hard_directory' WHEN regexp_matches(path, '(^|/)[.]([^./]|[.][^/])[^/]*') THEN 'hidden'
    WHEN language IS NULL THEN 'unsupported' ELSE 'policy' END AS reason FROM ({_TREE}) WHERE NOT (shaped AND coalesce(language = 'rust', false))""")
def source_exclusions(_: DataFrame, p: DataFrame) -> DataFrame:
    return files.excluded(p, files.source_inventory(p, "all", "rust"))


@query("part", "paths", sql="""SELECT DISTINCT path FROM paths WHERE (regexp_matches(path, '[.]py$') AND NOT regexp_matches(path, '_test[.]py$')) OR starts_with(path, 'tests/') OR (starts_with(path, 'src/') AND regexp_matches(path, '^src/[^/]*COPPER/')) OR regexp_matches(path, '(^|/)fixtures/')""")
def ignored_paths(_: DataFrame, p: DataFrame) -> DataFrame:
    rules = [(".gitignore", "# all but tests\n*.py\n!*_test.py\n\n/tests/\n**/fixtures/**  \n"), ("src/.gitignore", "/*COPPER/\nnothing\n")]
    tree = p.sparkSession.createDataFrame(rules, "path string, content string").withColumn("content", F.encode("content", "UTF-8"))
    return files.ignored(p, files.ignore_rules(tree))


# Markdown and sources

_MD = "FROM (SELECT id, ltrim(line) AS t FROM md)"


@query("md", sql=f"SELECT id, 'heading' AS kind, trim(substr(t, length(regexp_extract(t, '^#+')) + 1)) AS text {_MD} WHERE regexp_matches(t, '^#{{1,6}} ') UNION ALL SELECT id, 'task', trim(substr(t, 7)) {_MD} WHERE regexp_matches(t, '^[-*] \\[[ xX]\\] ')")
def markdown_facts(d: DataFrame) -> DataFrame:
    f = markdown.facts(markdown.line_states(d, "id", "line"), "id")
    return f.where("kind in ('heading', 'task')").select("id", "kind", "text")


@query("headed")
def markdown_claims(d: DataFrame) -> DataFrame:
    return markdown.claims(markdown.line_states(d))


@query("pages")
def markdown_html(p: DataFrame) -> DataFrame:
    return markdown.diagnostics(markdown.line_states(p, "page_id", "html"), "page_id")


@query("headed")
def markdown_anchors(d: DataFrame) -> DataFrame:
    return markdown.anchors(markdown.roles(markdown.line_states(d)))


def _code(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    body = F.concat(F.lit("import { a as b } from './m"), k % 5, F.lit("';\nexport function f"), k, F.lit("(x: number) { if (x) { return 1; } return "), F.when(k % 3 == 0, "x").otherwise(c("o_custkey").cast("string")), F.lit("; }\nf"), k, F.lit("(2);\n"), F.when(k % 7 == 0, "`open").otherwise(""))
    return o.select(k.alias("path"), body.alias("source"), F.lit("typescript").alias("language"))


@query("orders", sql="SELECT o_orderkey AS path, 'import' AS kind, './m' || (o_orderkey % 5) AS name FROM orders UNION ALL SELECT o_orderkey, 'function', 'f' || o_orderkey FROM orders UNION ALL SELECT o_orderkey, 'return_literal', 'f' || o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'call', 'f' || o_orderkey FROM orders UNION ALL SELECT o_orderkey, 'gap', NULL FROM orders WHERE o_orderkey % 7 = 0")
def code_events(o: DataFrame) -> DataFrame:
    return code.events(_code(o)).select("path", "kind", "name")


@query("orders", sql="SELECT o_orderkey AS path, 'f' || o_orderkey AS symbol, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey::VARCHAR END AS literal, 1 AS n FROM orders")
def code_literal_returns(o: DataFrame) -> DataFrame:
    return code.literal_returns(code.events(_code(o)))


@query("orders", sql="SELECT o_orderkey AS path, 1 AS declarations FROM orders")
def code_declarations(o: DataFrame) -> DataFrame:
    return code.declaration_counts(code.events(_code(o)))


@query("events", sql="SELECT event_id, sha256('{\"a\":[' || event_id || ',null],\"b\":\"' || event_type || '\"}') AS h FROM events")
def json_canonical(e: DataFrame) -> DataFrame:
    text = F.concat(F.lit('{ "b" : "'), "event_type", F.lit('", "a": [ '), "event_id", F.lit(" , null ] }"))
    return e.select("event_id", F.sha2(jsonc.canonical_json(text), 256).alias("h"))


@query("events", sql="SELECT event_id, 'sha256:canonical-json-v1:' || sha256('{\"a\":' || event_id || '}') AS content_hash, sha256('{\"a\":' || event_id || '}') AS semantic_hash, '{\"a\": ' || event_id || ' }' AS stripped, 'x, f(a,' || event_id || ')' AS parts FROM events")
def json_hashes(e: DataFrame) -> DataFrame:
    text = F.concat(F.lit('{"a": '), "event_id", F.lit("}"))
    return e.select("event_id", jsonc.content_hash(text).alias("content_hash"), jsonc.semantic_hash(text).alias("semantic_hash"), jsonc.strip_jsonc(F.concat(F.lit('{"a": '), "event_id", F.lit(", /* no */}"))).alias("s"), F.array_join(jsonc.split_top_level(F.concat(F.lit("x , f(a,"), "event_id", F.lit(")"))), ", ").alias("parts")).withColumnRenamed("s", "stripped")
