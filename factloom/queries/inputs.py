"""Code-like inputs derived from the given tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.stages import numbered

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "paths": """SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN 'src/' WHEN 1 THEN './lib/' WHEN 2 THEN 'tests/' WHEN 3 THEN 'a/../b/' WHEN 4 THEN '.hidden/'
        WHEN 5 THEN 'pkg/node_modules/' WHEN 6 THEN '/abs/' WHEN 7 THEN '../up/../' WHEN 8 THEN 'bench/./x/' WHEN 9 THEN 'gen/fixtures/' ELSE 'my-fixtures/' END
        || replace(p_type, ' ', '_') || '/' || replace(p_name, ' ', '-') || CASE p_partkey % 9 WHEN 0 THEN '.ts' WHEN 1 THEN '.TSX' WHEN 2 THEN '.rs' WHEN 3 THEN '.py'
        WHEN 4 THEN '.md' WHEN 5 THEN '.test.ts' WHEN 6 THEN '' WHEN 7 THEN '_test.py' ELSE '.gen.js' END AS path FROM part""",
    "md": """SELECT c_custkey AS id, CASE c_custkey % 19 WHEN 0 THEN '# ' || c_name WHEN 1 THEN '### API contracts of ' || c_mktsegment WHEN 2 THEN '- [ ] call ' || c_name WHEN 3 THEN '* [X] done'
        WHEN 4 THEN '```' || c_mktsegment WHEN 5 THEN 'See `src/a' || c_custkey || '.ts#f.g` and `npm run x`, é `not a ref` or `lib` here' WHEN 6 THEN 'é Contract: `src/a' || c_custkey || '.ts#f` returns `' || c_nationkey || '`.'
        WHEN 7 THEN '- MUST hold ' || c_name WHEN 8 THEN '12. item' WHEN 9 THEN '~~~~ ' WHEN 10 THEN 'https://a.b/' || c_custkey WHEN 11 THEN 'a.b@c-d.org' WHEN 12 THEN 'This is a claim about ' || c_mktsegment || '.'
        WHEN 13 THEN '####### too deep' WHEN 14 THEN 'Architecture decision records' WHEN 15 THEN 'name:src/x.ts:' || c_nationkey WHEN 16 THEN 'Contract: `bad ref#f` returns `1`' WHEN 17 THEN 'cargo test' ELSE '```a`b' END AS line FROM customer""",
    "claims2": """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 12 WHEN 0 THEN '.' WHEN 1 THEN 'none' WHEN 2 THEN './Read-Only/' WHEN 3 THEN 'src/a' || (l_partkey % 5) WHEN 4 THEN 'src/a' || (l_partkey % 5) || '/b' WHEN 5 THEN '../other/x'
        WHEN 6 THEN '' WHEN 7 THEN '/abs' WHEN 8 THEN 'src/../lib' WHEN 9 THEN '../../z' WHEN 10 THEN 'C:/x' ELSE ' src ' END AS a,
        CASE l_suppkey % 9 WHEN 0 THEN 'src' WHEN 1 THEN 'src/a' || (l_suppkey % 5) WHEN 2 THEN '/' WHEN 3 THEN '../other' WHEN 4 THEN 'lib/x/' WHEN 5 THEN 'no-write' WHEN 6 THEN 'a/..' WHEN 7 THEN 'src/a' || (l_suppkey % 5) || '/b/c' ELSE '../other/x/y' END AS b FROM lineitem""",
    "codes": """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'other' END AS severity,
        CASE o_orderkey % 6 WHEN 0 THEN 'verified' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'unverified' WHEN 3 THEN 'stale' WHEN 4 THEN 'unknown' ELSE 'unsupported' END AS status,
        CASE o_orderkey % 8 WHEN 0 THEN 'document_excluded' WHEN 1 THEN 'unsupported_syntax' WHEN 2 THEN 'unresolved_reference' WHEN 3 THEN 'contract_source_read_failed' WHEN 4 THEN 'unsupported_contract_target' WHEN 5 THEN 'code_reference_unverifiable' WHEN 6 THEN 'unsupported_reference_language' ELSE 'x' END AS diagnostic,
        CASE o_orderkey % 6 WHEN 0 THEN 'imports' WHEN 1 THEN 'type_refs' WHEN 2 THEN 'calls' WHEN 3 THEN 'exports' WHEN 4 THEN 'module_ref' ELSE 'contains' END AS graph_kind,
        CASE o_orderkey % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'rust' WHEN 2 THEN 'python' ELSE 'go' END AS language,
        CASE o_custkey % 8 WHEN 0 THEN 'import' WHEN 1 THEN 'queries' WHEN 2 THEN 'struct' WHEN 3 THEN 'tests' WHEN 4 THEN 'package' WHEN 5 THEN 'macro_expansions' WHEN 6 THEN 'exports' ELSE 'nothing' END AS fact_kind,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' ELSE 'c' || (o_custkey % 3) END AS section, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'c' || (o_orderkey % 3) END AS reference,
        CASE o_orderkey % 5 WHEN 0 THEN 'same_change' WHEN 1 THEN 'section_before_reference' WHEN 2 THEN 'reference_before_section' WHEN 3 THEN 'diverged' ELSE 'unknown' END AS change_order, o_totalprice AS price FROM orders""",
    # facts: expected from orders; observed is the same, perturbed
    "expected": """SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'node' ELSE 'call' END AS kind, 'f' || o_custkey AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'function' ELSE 'calls' END AS graph_kind, 'n' || o_orderkey AS name,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'w' || (o_orderkey % 5) END AS owner, CASE WHEN o_orderkey % 2 = 1 THEN 's' || (o_orderkey % 4) END AS source, CASE WHEN o_orderkey % 2 = 1 THEN 't' || (o_orderkey % 6) END AS target, 10 * (o_orderkey % 9) AS span FROM orders""",
    "actual": """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'node' ELSE 'call' END AS kind, 'f' || o_custkey AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'function' ELSE 'calls' END AS graph_kind, CASE WHEN o_orderkey % 13 = 0 THEN 'new' ELSE 'n' END || o_orderkey AS name,
        CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 17 <> 0 THEN NULL ELSE 'w' || (o_orderkey % 5) END AS owner, CASE WHEN o_orderkey % 2 = 1 THEN 's' || (o_orderkey % 4) END AS source, CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_orderkey % 19 = 0 THEN 'other' ELSE 't' || (o_orderkey % 6) END END AS target,
        10 * (o_orderkey % 9) + CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS span, 'v1' AS src_version, 'x' AS src_name, 'u' AS src_url, 'r' AS src_role FROM orders WHERE o_orderkey % 7 <> 0""",
    "nodes": """SELECT CAST(r_regionkey AS BIGINT) AS node_id, 'directory' AS kind, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, 'file', n_name FROM nation
        UNION ALL SELECT 1000 + c_custkey, 'class', c_name FROM customer UNION ALL SELECT 10000000 + o_orderkey, 'function', 'o' || (o_orderkey % 50) FROM orders""",
    "edges": """SELECT 'contains' AS kind, CAST(n_nationkey AS BIGINT) AS seq, CAST(n_regionkey AS BIGINT) AS src, CAST(100 + n_nationkey AS BIGINT) AS dst FROM nation
        UNION ALL SELECT 'contains', c_custkey, 100 + c_nationkey, 1000 + c_custkey FROM customer UNION ALL SELECT 'contains', o_orderkey, 1000 + o_custkey, 10000000 + o_orderkey FROM orders
        UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'calls' ELSE 'type_ref' END, o_orderkey, 10000000 + o_orderkey, 1000 + (o_custkey * 7) % 100 FROM orders""",
    "spans": """SELECT l_orderkey * 10 + l_linenumber AS id, 'f' || l_orderkey AS file, CAST(l_linenumber * 10 + l_partkey % 40 AS BIGINT) AS "start", CAST(l_linenumber * 10 + l_partkey % 40 + l_quantity AS BIGINT) AS stop, l_suppkey % 10 AS agent, l_linenumber % 3 = 0 AS consumed FROM lineitem""",
    "references_": """SELECT o_orderkey * 10 AS reference_id, o_custkey AS claim_id, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'src/' || o_orderkey || '.ts' END AS target FROM orders""",
    "observations": """SELECT o_orderkey * 10 AS reference_id, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'a' || (o_orderkey % 20) END AS section_change, 'a' || (o_custkey % 20) AS reference_change,
        CASE WHEN o_orderkey % 20 = o_custkey % 20 THEN 'same_change' WHEN o_orderkey % 41 = 0 THEN 'section_before_reference' ELSE 'reference_before_section' END AS change_order FROM orders WHERE o_orderkey % 31 <> 0""",
    "cards": """SELECT o_orderkey AS id, 'k' || (o_orderkey % 3) AS kind, 'c' || (o_orderkey % 2) AS classification, 's' || (o_orderkey % 4) AS graph_surface, 't' AS truth_source, 'd' || (o_orderkey % 5) AS diagnostic_code, 'x' AS suspected_subsystem,
        o_orderkey % 6 AS occurrence_count, 'p' || (o_custkey % 9) AS path, 'e' || (o_custkey % 7) AS evidence_id, CASE o_orderkey % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'critical' WHEN 2 THEN 'medium' ELSE 'low' END AS severity FROM orders""",
    "candidates": """SELECT l_orderkey % 200 AS task, 'f' || (l_partkey % 20) AS file, CAST(l_linenumber * 10 AS BIGINT) AS "start", CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS stop, l_suppkey % 3 AS decision, l_linenumber % 4 AS distance, CAST(l_quantity AS BIGINT) AS score,
        CASE l_partkey % 5 WHEN 0 THEN 'caller' WHEN 1 THEN 'test' WHEN 2 THEN 'docs' WHEN 3 THEN 'diagnostic' ELSE 'import' END AS signal FROM lineitem""",
    "journal": """SELECT row_number() OVER (ORDER BY ts, event_id) AS sequence, 'a' || user_id AS attempt, CASE event_type WHEN 'view' THEN 'prepare' WHEN 'click' THEN 'dispatch' WHEN 'signup' THEN 'finish' WHEN 'purchase' THEN 'check_start' ELSE 'check_end' END AS kind,
        CAST(event_id * 1.5 AS DOUBLE) AS monotonic, CAST(CASE WHEN event_id % 50 = 0 THEN 5 ELSE 0 END AS DOUBLE) AS clock_origin FROM events""",
    "ledger": """SELECT 'w' || o_orderkey AS work_item_id, CAST(1 + o_orderkey % 2 AS INT) AS requests_used, CASE WHEN o_orderkey % 29 = 0 THEN 'bad' ELSE sha256_(CAST(o_orderkey AS STRING_)) END AS last_state_sha256 FROM orders WHERE o_orderkey % 3 <> 0""",
    "requests": """SELECT 'w' || o_orderkey AS work_item_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 37 = 0 THEN 0 ELSE 1 + o_orderkey % 2 END AS INT) AS expected_used, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'zz' ELSE sha256_(CAST(o_orderkey AS STRING_)) END AS previous_state_sha256,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'changed' END AS change_reason, sha256_(CAST(o_orderkey - o_orderkey % 2 AS STRING_)) AS state_hash FROM orders""",
    "sources": """SELECT doc_id AS file, text AS source FROM documents""",
    "headed": """SELECT doc_id AS file, replace(replace(text, '.' || chr(10), '.' || chr(10) || '# API contract '), chr(10) || 'T', chr(10) || '### T') AS source FROM documents""",
    # walks and imports
    "commits": """SELECT c_custkey AS "commit", CAST(floor(c_custkey / 2.0) AS BIGINT) AS parent FROM customer WHERE c_custkey > 1 UNION ALL SELECT c_custkey, c_custkey - 3 FROM customer WHERE c_custkey % 5 = 0 AND c_custkey > 5 UNION ALL SELECT 1, NULL""",
    "commit_pairs": """SELECT o_orderkey AS pair_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN CAST(floor(o_custkey / 4.0) AS BIGINT) ELSE o_custkey END AS section, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_custkey / 2.0) AS BIGINT) ELSE 1 + (o_custkey * 3) % 140 END AS reference FROM orders""",
    "configs": """SELECT 'k' || p_partkey AS config, CASE WHEN p_partkey % 13 = 0 THEN 'none' WHEN p_partkey % 7 = 0 THEN NULL ELSE 'k' || CAST(floor(p_partkey / 2.0) AS BIGINT) END AS base, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS value FROM part""",
    "modtree": """SELECT c_custkey AS module, CASE WHEN c_custkey > 1 THEN CAST(floor(c_custkey / 2.0) AS BIGINT) END AS parent, repeat('a.', CAST(c_custkey % 5 AS INT)) AS scope FROM customer""",
    "scope_decls": """SELECT o_custkey AS scope, 'n' || (o_orderkey % 20) AS name, o_orderkey AS node FROM orders""",
    "scope_refs": """SELECT o_orderkey AS ref_id, 1 + (o_custkey * 7) % 150 AS scope, 'n' || (o_orderkey * 3 % 23) AS name FROM orders""",
    "imports": """SELECT o_orderkey AS id, './src/a' || (o_custkey % 7) || '/m' || (o_orderkey % 9) || CASE WHEN (o_orderkey * 7 + o_custkey) % 4 = 0 THEN '.js' ELSE '.ts' END AS importer,
        CASE o_orderkey % 8 WHEN 0 THEN './m' || ((o_orderkey * 7 + o_custkey) % 9) WHEN 1 THEN '../a' || ((o_orderkey * 7 + o_custkey) % 7) || '/m' || (o_custkey % 9) || '.js' WHEN 2 THEN '@lib/m' || ((o_orderkey * 7 + o_custkey) % 9) WHEN 3 THEN 'react' WHEN 4 THEN '@app' WHEN 5 THEN './d' || ((o_orderkey * 7 + o_custkey) % 5) WHEN 6 THEN '@lib/deep/x' ELSE '../../src/a1/m1.ts?raw' END AS specifier FROM orders""",
    "project_files": """SELECT DISTINCT './src/a' || (p_partkey % 7) || '/' || CASE p_partkey % 3 WHEN 0 THEN 'm' || (p_partkey % 9) || '.ts' WHEN 1 THEN 'm' || (p_size % 9) || '.js' ELSE 'd' || (p_size % 5) || '/index.ts' END AS path FROM part""",
    "aliases": """SELECT n_nationkey AS ordinal, CASE n_nationkey % 3 WHEN 0 THEN './' WHEN 1 THEN './src/a' || (n_nationkey % 7) ELSE './src/' END AS scope_dir, CASE n_nationkey % 4 WHEN 0 THEN '@lib/*' WHEN 1 THEN '@app' WHEN 2 THEN '@lib/deep/*' ELSE '@*' END AS pattern,
        './src/a' || (n_nationkey % 7) || CASE WHEN n_nationkey % 4 = 1 THEN '/m1' ELSE '/*' END AS t1, './src/a1/../a' || (n_nationkey % 5) || '/*' AS t2 FROM nation""",
    "labelled": """SELECT 'contains' AS kind, CAST(100 + c_nationkey AS BIGINT) AS src, 1000 + c_custkey AS dst, CAST(NULL AS STRING_) AS label, c_custkey AS seq FROM customer
        UNION ALL SELECT 'exports', 100 + c_nationkey, 1000 + c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'y' || (c_custkey % 30) END, c_custkey FROM customer
        UNION ALL SELECT 'imports', 100 + c_custkey % 25, 100 + c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN '*' ELSE 'default as d' || c_custkey || ', ' || chr(123) || ' ' || c_name || ' as z' || (c_custkey % 40) || ' , type ' || c_mktsegment || ' ' || chr(125) END, c_custkey FROM customer""",
    "bindings": """SELECT o_custkey AS file, 'x' || (o_orderkey % 2) AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'value' ELSE 'type' END AS space, o_orderkey * 3 AS node, o_orderkey AS seq FROM orders""",
    "rust_items": """SELECT 'a' || (c_custkey % 5) || '::b' || (c_custkey % 7) || '::f' || (c_custkey % 97) AS path, c_custkey AS node FROM customer""",
    # archives
    "blobs_in": """SELECT doc_id AS file_id, 'p' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN lang || source ELSE text END AS content FROM documents""",
}


def view_sql(name: str, engine: str) -> str:
    text = VIEWS[name]
    if engine == "spark":
        return re.sub(r'"(start|commit)"', r"`\1`", text).replace("sha256_(", "sha2_(").replace("STRING_", "STRING").replace("sha2_(CAST(o_orderkey AS STRING))", "sha2(CAST(o_orderkey AS STRING), 256)").replace("sha2_(CAST(o_orderkey - o_orderkey % 2 AS STRING))", "sha2(CAST(o_orderkey - o_orderkey % 2 AS STRING), 256)")
    return text.replace("sha256_(", "sha256(").replace("STRING_", "VARCHAR")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input (or a given table), with only the tables that it names."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = view_sql(name, "spark")
    # A number over all rows would put them into one task: Spark counts them by ranges.
    counted = re.match(r"SELECT row_number\(\) OVER \(ORDER BY ([\w, ]+)\) AS (\w+)", sql)
    if counted:
        sql = sql.replace(counted[0], f"SELECT {counted[1]}", 1)
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"FROM {t}\b", sql)}
    df = spark.sql(re.sub(r"FROM (\w+)\b", lambda m: f"FROM {{{m[1]}}}" if m[1] in used else m[0], sql), **used)
    if counted:
        order = counted[1].split(", ")
        df = numbered(df, *order).select(F.col("place").cast("int").alias(counted[2]), *[x for x in df.columns if x not in order])
    return df


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL with the derived inputs as common table expressions."""
    views = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({view_sql(n, 'duckdb')})" for n in names)
    return views + ("" if body.lstrip().startswith(",") else "\n") + body


#: FNV-1a (64 bits) of the bytes whose hex digits stand in {0}.
FNV = "list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(0, length({0}) // 2), lambda i: ('0x' || substr({0}, 2 * i + 1, 2))::INT::UHUGEINT)), lambda h, b: xor(h, b) * 1099511628211 % 18446744073709551616)"
