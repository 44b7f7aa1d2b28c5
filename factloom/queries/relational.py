"""Relational, graph, interval, window, journal and set queries on derived inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import paths
from factloom.operators import claims, diff, graph, hazards, journal, lines, plan
from factloom.queries.inputs import TABLES, load, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(*views: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*[load(spark, sf_dir, v) for v in views])

        QUERIES[f.__name__] = run
        if sql is not None:
            derived = [v for v in views if v not in TABLES]
            ORACLE_SQL[f.__name__] = with_views(sql, *dict.fromkeys(derived)) if derived else sql
        return f

    return add


# Facts

_DIFF = """, e AS (SELECT * FROM expected), a AS (SELECT DISTINCT ON (kind, file, graph_kind, name, owner, source, target, span) * FROM actual),
x AS (SELECT e.*, a.name IS NOT NULL AS found FROM e LEFT JOIN a ON e.kind = a.kind AND e.file = a.file AND e.graph_kind = a.graph_kind AND e.name = a.name AND e.owner IS NOT DISTINCT FROM a.owner AND e.source IS NOT DISTINCT FROM a.source AND e.target IS NOT DISTINCT FROM a.target AND e.span = a.span),
u AS (SELECT a.* FROM a LEFT JOIN e ON e.kind = a.kind AND e.file = a.file AND e.graph_kind = a.graph_kind AND e.name = a.name AND e.owner IS NOT DISTINCT FROM a.owner AND e.source IS NOT DISTINCT FROM a.source AND e.target IS NOT DISTINCT FROM a.target AND e.span = a.span WHERE e.ord IS NULL),
w AS (SELECT x.*, u.name IS NOT NULL AS taken, u.owner AS uo, u.target AS ut, u.span AS us, u.graph_kind AS ug FROM x LEFT JOIN u ON NOT x.found AND x.kind = u.kind AND x.file = u.file AND x.name = u.name AND x.source IS NOT DISTINCT FROM u.source
  AND (x.kind = 'node' OR (x.owner IS NOT DISTINCT FROM u.owner AND (x.span = u.span OR (x.target IS NOT DISTINCT FROM u.target AND x.graph_kind = u.graph_kind)))) WHERE NOT x.found),
d AS (SELECT ord, kind, file, graph_kind, name, owner, source, target, span, CASE WHEN NOT taken THEN CASE WHEN kind = 'node' THEN 'missing_node' ELSE 'missing_edge' END WHEN graph_kind <> ug THEN 'wrong_kind' WHEN owner IS DISTINCT FROM uo THEN 'wrong_owner' WHEN target IS DISTINCT FROM ut THEN 'wrong_target' ELSE 'wrong_span' END AS diff FROM w
  UNION ALL SELECT NULL, u.kind, u.file, u.graph_kind, u.name, u.owner, u.source, u.target, u.span, CASE WHEN u.kind = 'node' THEN 'extra_node' ELSE 'extra_edge' END FROM u LEFT JOIN w ON w.taken AND w.name = u.name WHERE w.ord IS NULL)"""


@query("expected", "actual", sql=_DIFF + " SELECT *, 'silent_divergence' AS classification, CASE WHEN diff IN ('missing_node', 'missing_edge', 'wrong_target') THEN 'high' ELSE 'medium' END AS severity FROM d")
def fact_diff(e: DataFrame, a: DataFrame) -> DataFrame:
    return diff.classify(e, a)


@query("expected", "actual", sql=_DIFF + " SELECT diff, count(*) AS n FROM d GROUP BY diff")
def fact_diff_counts(e: DataFrame, a: DataFrame) -> DataFrame:
    return diff.classify(e, a).groupBy("diff").agg(F.count(F.lit(1)).alias("n"))


@query("expected", "actual", sql=_DIFF + " SELECT (SELECT count(*) FROM e) AS expected, (SELECT count(*) FROM actual) AS actual, count(*) AS diffs, count(*) AS silent, 0 AS explained, ((SELECT count(*) FROM e) - count(ord)) / (SELECT count(*) FROM e)::DOUBLE AS coverage FROM d")
def fact_scorecard(e: DataFrame, a: DataFrame) -> DataFrame:
    return diff.scorecard(e.count(), a.count(), diff.classify(e, a))


@query("actual", sql="SELECT kind, count(*) AS n FROM (SELECT DISTINCT kind, file, graph_kind, name, owner, source, target, span FROM actual) GROUP BY kind")
def fact_representatives(a: DataFrame) -> DataFrame:
    return diff.representatives(a.union(a)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_CLUSTER = "kind, classification, graph_surface, truth_source, diagnostic_code, suspected_subsystem"


@query("cards", sql=f"""SELECT {_CLUSTER}, sum(occurrence_count) AS occurrence_count, count(DISTINCT path) AS n_paths, count(DISTINCT evidence_id) AS n_evidence,
    CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, min(path) AS path FROM cards GROUP BY {_CLUSTER}""")
def cluster_cards(d: DataFrame) -> DataFrame:
    return diff.cluster_cards(d)


@query("cards", sql=f"SELECT DISTINCT {_CLUSTER}, 'path' AS member, path AS value FROM cards WHERE path IS NOT NULL UNION ALL SELECT DISTINCT {_CLUSTER}, 'evidence', evidence_id::VARCHAR FROM cards WHERE evidence_id IS NOT NULL")
def cluster_members(d: DataFrame) -> DataFrame:
    return diff.cluster_members(d)


@query("paths", sql="SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' ELSE 'unexpected' END AS problem FROM (SELECT DISTINCT path FROM paths WHERE id % 5 <> 0) a FULL JOIN (SELECT DISTINCT path FROM paths WHERE id % 7 <> 0) b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL")
def role_completeness(p: DataFrame) -> DataFrame:
    return diff.role_completeness(p.where("id % 5 <> 0"), p.where("id % 7 <> 0"))


@query("documents", sql="SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN lower(source) ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0) b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h")
def snapshot_changes(d: DataFrame) -> DataFrame:
    a = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    b = d.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("doc_id") % 9 == 0, F.lower("source")).otherwise(F.col("text")), 256).alias("sha256"))
    return diff.snapshot_changes(a, b)


# Graph


@query("edges", sql="SELECT dst AS node_id, kind, src AS neighbour, seq FROM edges WHERE kind = 'calls'")
def graph_incoming(e: DataFrame) -> DataFrame:
    return graph.adjacency(e, "dst", "calls")


@query("edges", sql="SELECT src AS node_id, kind, dst AS neighbour, seq FROM edges WHERE kind = 'type_ref'")
def graph_outgoing(e: DataFrame) -> DataFrame:
    return graph.adjacency(e, "src", "type_ref")


@query("nodes", sql="SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def graph_node_counts(n: DataFrame) -> DataFrame:
    return graph.kind_counts(n)


@query("edges", sql="SELECT kind, count(*) AS n FROM edges GROUP BY kind")
def graph_edge_counts(e: DataFrame) -> DataFrame:
    return graph.kind_counts(e)


@query("nodes", "edges", sql=', g AS (SELECT node_id, count(e.src) AS degree FROM nodes n LEFT JOIN edges e ON e.src = n.node_id GROUP BY node_id) SELECT node_id, CAST(coalesce(sum(degree) OVER (ORDER BY node_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", degree FROM g')
def graph_offsets(n: DataFrame, e: DataFrame) -> DataFrame:
    return graph.offsets(n, e)


@query("edges", sql=", o AS (SELECT kind, src, dst, seq AS out_slot, row_number() OVER (PARTITION BY kind, src, dst ORDER BY seq) AS r FROM edges), i AS (SELECT kind, src, dst, -seq AS in_slot, row_number() OVER (PARTITION BY kind, src, dst ORDER BY -seq) AS r FROM edges) SELECT o.kind, o.src, o.dst, out_slot, in_slot FROM o JOIN i ON o.kind = i.kind AND o.src = i.src AND o.dst = i.dst AND o.r = i.r")
def graph_mirror_slots(e: DataFrame) -> DataFrame:
    return graph.mirror_slots(e.withColumn("slot", F.col("seq")), e.withColumn("slot", -F.col("seq")))


@query("edges", sql="SELECT kind, src, dst, count(*) AS surplus FROM edges WHERE seq % 97 = 0 GROUP BY kind, src, dst")
def graph_mirror_violations(e: DataFrame) -> DataFrame:
    return graph.mirror_violations(e, e.where("seq % 97 <> 0"))


@query("nodes", "edges", sql=", up AS (SELECT dst, arg_min(src, seq) AS src FROM edges WHERE kind = 'contains' GROUP BY dst), w AS (SELECT node_id, node_id AS at, kind FROM nodes UNION ALL SELECT w.node_id, up.src, n.kind FROM w JOIN up ON up.dst = w.at JOIN nodes n ON n.node_id = up.src WHERE w.kind <> 'file') SELECT n.node_id, max(w.at) FILTER (WHERE w.kind = 'file') AS file_id FROM nodes n JOIN w ON w.node_id = n.node_id GROUP BY n.node_id")
def graph_file_of(n: DataFrame, e: DataFrame) -> DataFrame:
    return graph.file_of(n, e)


@query("nodes", "edges", sql="SELECT e.dst AS node_id, a.name, e.kind, e.src AS user_id, b.name AS user_name FROM edges e JOIN nodes a ON a.node_id = e.dst JOIN nodes b ON b.node_id = e.src WHERE e.kind IN ('calls', 'type_ref') AND e.src <> e.dst")
def graph_uses(n: DataFrame, e: DataFrame) -> DataFrame:
    return graph.uses(n, e)


@query("nodes", "edges", sql=", b AS (SELECT src AS node_id, 'out' AS direction, kind, dst AS other FROM edges UNION ALL SELECT dst, 'in', kind, src FROM edges), d AS (SELECT DISTINCT b.node_id, direction, b.kind, n.name AS other_name FROM b JOIN nodes n ON n.node_id = b.other) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY direction, kind, other_name) AS place, greatest(count(*) OVER (PARTITION BY node_id) - 50, 0) AS omitted FROM d) WHERE place <= 50")
def graph_relationships(n: DataFrame, e: DataFrame) -> DataFrame:
    return graph.relationships(n, e)


@query("nodes", sql="SELECT name, CASE WHEN count(*) = 1 THEN min(node_id) END AS node_id FROM nodes GROUP BY name")
def graph_unique_names(n: DataFrame) -> DataFrame:
    return graph.unique_names(n, "name", "node_id")


@query("nodes", sql="SELECT name AS string, row_number() OVER (ORDER BY first, name) - 1 AS id FROM (SELECT name, min(node_id) AS first FROM nodes GROUP BY name)")
def graph_intern(n: DataFrame) -> DataFrame:
    return graph.intern(n, "name", "node_id")


# Lines and tokens

_LINES = """, r AS (SELECT file, string_split(source, chr(10)) AS a FROM {0}), q AS (SELECT file, CASE WHEN len(a) > 1 AND a[-1] = '' THEN a[:-2] ELSE a END AS a FROM r),
p AS (SELECT file, unnest(a) AS raw, unnest(range(1, len(a) + 1)) AS line_no FROM q),
l AS (SELECT file, line_no, CAST(coalesce(sum(strlen(raw) + 1) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, regexp_replace(raw, '\r$', '') AS text FROM p)"""


@query("sources", sql=_LINES.format("sources") + " SELECT file, line_no, start, text FROM l")
def lines_with_offsets(d: DataFrame) -> DataFrame:
    return lines.lines(d)


@query("sources", sql=_LINES.format("sources") + ', o AS (SELECT file, unnest(range(0, strlen(source), 37)) AS "offset" FROM sources) SELECT o.file, o."offset", l.line_no AS line, o."offset" - l.start + 1 AS col FROM o ASOF JOIN l ON o.file = l.file AND o."offset" >= l.start')
def line_col(d: DataFrame) -> DataFrame:
    at = d.where("octet_length(source) > 0").select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.octet_length("source").cast("bigint") - 1, F.lit(37).cast("bigint"))).alias("offset"))
    return lines.line_col(at, lines.lines(d))


_SECTIONS = _LINES.format("headed") + """, h AS (SELECT file, line_no, length(regexp_extract(trim(text), '^#+')) AS level, trim(substr(trim(text), length(regexp_extract(trim(text), '^#+')) + 1)) AS title FROM l WHERE regexp_matches(trim(text), '^#{1,6} ')),
e AS (SELECT h.file, h.line_no, min(k.line_no) AS stop FROM h JOIN h k ON h.file = k.file AND k.line_no > h.line_no AND k.level <= h.level GROUP BY h.file, h.line_no), t AS (SELECT file, max(line_no) AS total FROM l GROUP BY file)"""


@query("headed", sql=_SECTIONS + " SELECT h.file, h.line_no, h.level, h.title, coalesce(e.stop - 1, t.total) AS last_line, CASE WHEN regexp_matches(lower(title), '(^|[^a-z0-9])api([^a-z0-9]|$)') AND regexp_matches(lower(title), '(^|[^a-z0-9])contracts?([^a-z0-9]|$)') THEN 'api_contract' END AS role FROM h JOIN t ON t.file = h.file LEFT JOIN e ON e.file = h.file AND e.line_no = h.line_no")
def sections(d: DataFrame) -> DataFrame:
    return lines.sections(lines.lines(d))


@query("sources", sql="SELECT file, len(regexp_extract_all(source, '[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+|[^ \t\n\r\f\x0b]')) AS n, 0 AS depth FROM sources")
def token_counts(d: DataFrame) -> DataFrame:
    t = lines.tokens(d).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"))
    return d.select("file").join(t, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("depth", F.lit(0)).alias("depth"))


@query("sources", sql="SELECT token, file, pos FROM (SELECT token, file, pos, row_number() OVER (PARTITION BY token ORDER BY file, pos) AS r FROM (SELECT file, unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM (SELECT file, list_filter(regexp_split_to_array(source, '[^\\p{L}\\p{N}_$]+'), lambda x: strlen(x) <= 128 AND regexp_matches(x, '^[\\p{L}_$]')) AS t FROM sources))) WHERE r = 1 ORDER BY file, pos LIMIT 128")
def support_queries(d: DataFrame) -> DataFrame:
    return lines.support_queries(d)


@query("sources", sql=_LINES.format("(SELECT file, replace(source, '.' || chr(10), chr(10) || '```' || chr(10)) AS source FROM sources)") + """, m AS (SELECT *, trim(text) = '```' AS mark FROM l), k AS (SELECT *, sum(mark::INT) OVER w AS n, max(line_no) FILTER (WHERE mark) OVER w AS last, max(line_no) FILTER (WHERE mark) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m WINDOW w AS (PARTITION BY file ORDER BY line_no))
SELECT file, line_no, CASE WHEN n % 2 = 1 THEN last WHEN mark THEN before END AS fence FROM k""")
def fences(d: DataFrame) -> DataFrame:
    return lines.fenced(lines.lines(d.select("file", F.replace("source", F.lit(".\n"), F.lit("\n```\n")).alias("source")))).select("file", "line_no", "fence")


# Claims

_VERDICT = """CASE WHEN o.reference_id IS NULL THEN NULL WHEN section_change IS NULL THEN 'history_unavailable' WHEN (section_change = reference_change) <> (change_order = 'same_change') THEN 'inconsistent_evidence' WHEN change_order = 'same_change' THEN 'same_change' WHEN change_order = 'section_before_reference' THEN 'reference_changed_after_section' ELSE 'section_changed_after_reference' END"""


@query("customer", "references_", "observations", sql=f""", v AS (SELECT r.claim_id, o.reference_id IS NULL AS missing, {_VERDICT} AS reason FROM references_ r LEFT JOIN observations o ON o.reference_id = r.reference_id WHERE r.target IS NOT NULL),
g AS (SELECT claim_id, count(*) AS checked, count(*) FILTER (WHERE missing) AS missing, count(*) FILTER (WHERE reason = 'reference_changed_after_section') AS stale, count(*) FILTER (WHERE reason IN ('history_unavailable', 'inconsistent_evidence')) AS unknown, coalesce(string_agg(DISTINCT reason, '; ' ORDER BY reason), '') AS reasons FROM v GROUP BY claim_id)
SELECT c_custkey AS claim_id, CASE WHEN checked IS NULL THEN 'unverified' WHEN missing > 0 THEN 'contradicted' WHEN stale > 0 THEN 'stale' WHEN unknown > 0 THEN 'unknown' ELSE 'unverified' END AS status, coalesce(checked, 0) AS checked, coalesce(missing, 0) AS missing, coalesce(reasons, '') AS reasons FROM customer LEFT JOIN g ON g.claim_id = c_custkey""")
def verify_claims(c: DataFrame, r: DataFrame, o: DataFrame) -> DataFrame:
    return claims.verify_claims(c.select(F.col("c_custkey").alias("claim_id")), r, o)


@query("orders", sql="SELECT o_orderkey AS contract_id, CASE WHEN o_orderkey % 5 = 4 THEN 'unsupported_contract_target' WHEN o_orderkey % 5 = 3 THEN 'contract_source_read_failed' WHEN o_orderkey % 5 = 2 OR o_custkey % 4 = 0 THEN 'contract_source_return_unknown' WHEN o_custkey % 3 = 0 THEN 'verified' ELSE 'return_contract_mismatch' END AS outcome FROM orders")
def check_contracts(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    want = o.select(k.alias("contract_id"), F.concat(F.lit("f"), k, F.when(k % 5 == 4, ".rs").otherwise(".ts")).alias("target"), F.lit("s").alias("symbol"), F.lit("0").alias("expected"))
    have = o.where(k % 5 < 3).select(F.concat(F.lit("f"), k, F.lit(".ts")).alias("path"), F.lit("s").alias("symbol"), F.when(F.col("o_custkey") % 4 != 0, (F.col("o_custkey") % 3).cast("string")).alias("literal"), F.when(k % 5 == 2, 2).otherwise(1).alias("n"))
    return claims.check_contracts(want, have)


@query("references_", sql="SELECT claim_id, arg_max(CAST(reference_id % 3 AS VARCHAR), reference_id) AS status, string_agg(DISTINCT 'e' || (reference_id % 7), ',' ORDER BY 'e' || (reference_id % 7)) AS evidence_ids FROM references_ GROUP BY claim_id")
def consumer_view(r: DataFrame) -> DataFrame:
    v = r.select("claim_id", (F.col("reference_id") % 3).cast("string").alias("status"), F.col("reference_id").alias("ordinal"), F.concat(F.lit("e"), F.col("reference_id") % 7).alias("evidence_id"))
    return claims.consumer_view(v).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query("orders", "customer", sql="SELECT o_orderkey AS id, o_custkey AS claim_id, CASE WHEN o_orderkey % 3 = 0 THEN 'unverified' ELSE 'unknown' END AS status FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 < 2 AND c_custkey % 4 <> 0")
def unproven_claims(o: DataFrame, c: DataFrame) -> DataFrame:
    v = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("claim_id"), F.when(F.col("o_orderkey") % 3 == 0, "unverified").when(F.col("o_orderkey") % 3 == 1, "unknown").otherwise("verified").alias("status"))
    return claims.unproven(v, c.select(F.col("c_custkey").alias("claim_id"), F.when(F.col("c_custkey") % 4 == 0, "api_contract").otherwise("requirement").alias("kind")))


@query("spans", sql='SELECT DISTINCT file, "start", stop FROM spans s WHERE NOT consumed AND NOT EXISTS (SELECT 1 FROM spans k WHERE k.consumed AND k.file = s.file AND k."start" < s.stop AND s."start" < k.stop)')
def unlinked_subjects(s: DataFrame) -> DataFrame:
    return claims.unlinked(s.where("not consumed").select("file", "start", "stop"), s.where("consumed"))


# Hazards

_PAIRS = 'SELECT w.file, w.id AS a_id, r.id AS b_id, w."start" AS a_start, r."start" AS b_start, w.agent AS wa, r.agent AS ra, r.consumed FROM spans w JOIN spans r ON w.file = r.file AND w."start" < r.stop AND r."start" < w.stop'


@query("spans", sql=f"SELECT file, a_id, b_id, a_start, b_start FROM ({_PAIRS})")
def span_overlaps(s: DataFrame) -> DataFrame:
    return hazards.overlaps(s, s)


@query("spans", sql=f"SELECT file, a_id AS write_id, b_id AS read_id FROM ({_PAIRS}) WHERE wa <> ra AND NOT consumed")
def write_after_read(s: DataFrame) -> DataFrame:
    return hazards.write_after_read(s, s)


@query("orders", sql="SELECT o_orderkey AS intent_id, 'f' || o_custkey AS file, CASE WHEN o_custkey % 3 = 0 THEN 'missing_source' ELSE 'stale_hash' END AS reason FROM orders WHERE o_custkey % 3 = 0 OR o_orderkey % 5 <> o_custkey % 5")
def stale_sources(o: DataFrame) -> DataFrame:
    want = o.select(F.col("o_orderkey").alias("intent_id"), F.concat(F.lit("f"), "o_custkey").alias("file"), (F.col("o_orderkey") % 5).alias("hash"))
    return hazards.stale_sources(want, o.where("o_custkey % 3 <> 0").select(F.concat(F.lit("f"), "o_custkey").alias("file"), (F.col("o_custkey") % 5).alias("hash")).distinct())


@query("lineitem", sql="SELECT l_orderkey AS intent_id, l_linenumber AS gate FROM lineitem r WHERE NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = r.l_orderkey AND p.l_linenumber = r.l_linenumber AND p.l_partkey % 3 = 0)")
def missing_gates(li: DataFrame) -> DataFrame:
    g = li.select(F.col("l_orderkey").alias("intent_id"), F.col("l_linenumber").alias("gate"), (F.col("l_partkey") % 3 == 0).alias("passed"))
    return hazards.missing_gates(g.drop("passed"), g)


@query("lineitem", sql="SELECT stage, reason, evidence, addresses, ord FROM (SELECT *, row_number() OVER w AS n, lag(addresses) OVER w AS before FROM (SELECT l_linenumber AS stage, l_returnflag AS reason, l_suppkey AS evidence, l_partkey % 3 AS addresses, l_orderkey AS ord FROM lineitem) WINDOW w AS (PARTITION BY stage, reason, evidence ORDER BY ord, addresses)) WHERE n = 1 OR addresses IS DISTINCT FROM before")
def dedup_stalls(li: DataFrame) -> DataFrame:
    return hazards.dedup_stalls(li.select(F.col("l_linenumber").alias("stage"), F.col("l_returnflag").alias("reason"), F.col("l_suppkey").alias("evidence"), (F.col("l_partkey") % 3).alias("addresses"), F.col("l_orderkey").alias("ord")))


# Plans

_MERGED = """, p AS (SELECT *, list_position(['diagnostic', 'test', 'truth_gap', 'dirty_hunk', 'caller', 'callee', 'type_ref', 'import', 'export', 'docs'], signal) - 1 AS priority FROM candidates),
m AS (SELECT task, file, "start", stop, min(decision) AS decision, min(distance) AS distance, string_agg(DISTINCT signal, ',' ORDER BY signal) AS signals, min(priority) AS priority, max(score) + sum(DISTINCT CASE signal WHEN 'diagnostic' THEN 100 WHEN 'test' THEN 90 WHEN 'caller' THEN 65 WHEN 'import' THEN 45 ELSE 30 END)::BIGINT + 5 * (count(DISTINCT signal) - 1) AS score FROM p GROUP BY task, file, "start", stop),
o AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY decision, priority, distance, score DESC, file, "start", stop) AS place FROM m)"""


@query("candidates", sql=_MERGED + " SELECT * FROM o")
def plan_ordered(d: DataFrame) -> DataFrame:
    return plan.ordered(plan.merge(d)).withColumn("signals", F.array_join("signals", ","))


@query("candidates", sql=_MERGED + """, f AS (SELECT task, file, "start", stop, place, stop - "start" AS used, true AS kept FROM o WHERE place = 1
    UNION ALL SELECT o.task, o.file, o."start", o.stop, o.place, CASE WHEN f.used + o.stop - o."start" <= 300 THEN f.used + o.stop - o."start" ELSE f.used END, f.used + o.stop - o."start" <= 300 FROM f JOIN o ON o.task = f.task AND o.place = f.place + 1)
SELECT task, file, "start", stop, place FROM f WHERE kept""")
def plan_within_budget(d: DataFrame) -> DataFrame:
    return plan.within_budget(plan.ordered(plan.merge(d)), 300)


@query("documents", sql="SELECT doc_id, lang FROM (SELECT doc_id, lang, sum(n_chars) OVER w AS used, row_number() OVER w AS n FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)) WHERE used <= 20000 OR n = 1")
def plan_prefix_budget(d: DataFrame) -> DataFrame:
    return plan.prefix_within_budget(d, "lang", "doc_id", "n_chars", 20000).select("doc_id", "lang")


# Journal and ledger

_STEPS = "list_position(['prepare', 'dispatch', 'finish', 'check_start', 'check_end'], kind)"
_BAD = f", n AS (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY sequence) AS n FROM journal), b AS (SELECT *, bool_or({_STEPS} <> n) OVER (PARTITION BY attempt ORDER BY sequence) AS bad FROM n)"


@query("journal", sql=_BAD + " SELECT attempt, sequence, kind FROM b WHERE bad")
def journal_invalid(j: DataFrame) -> DataFrame:
    return journal.invalid_transitions(j)


@query("journal", sql=_BAD + " SELECT attempt, sequence, kind, NOT bad AS accepted FROM b")
def journal_judged(j: DataFrame) -> DataFrame:
    return journal.judged(j)


def _dur(a: str, b: str) -> str:
    return f"CASE WHEN abs({a}.clock_origin - {b}.clock_origin) <= 2 AND {b}.monotonic >= {a}.monotonic THEN round({b}.monotonic - {a}.monotonic, 6) END"


@query("journal", sql=", s AS (SELECT attempt, kind, arg_max({'sequence': sequence, 'monotonic': monotonic, 'clock_origin': clock_origin}, sequence) AS v FROM journal GROUP BY attempt, kind), p AS (SELECT attempt, max(v) FILTER (WHERE kind = 'prepare') AS a, max(v) FILTER (WHERE kind = 'dispatch') AS b, max(v) FILTER (WHERE kind = 'finish') AS c, max(v) FILTER (WHERE kind = 'check_start') AS d, max(v) FILTER (WHERE kind = 'check_end') AS e FROM s GROUP BY attempt)"
    + f" SELECT attempt, {_dur('a', 'b')} AS pre_dispatch_queue_seconds, {_dur('b', 'c')} AS process_seconds, {_dur('d', 'e')} AS verification_seconds, {_dur('a', 'e')} AS attempt_through_verification_seconds, CASE WHEN c IS NULL THEN 'pending' ELSE 'observed' END AS transport_status FROM p WHERE a IS NOT NULL")
def journal_report(j: DataFrame) -> DataFrame:
    return journal.report(j)


@query("journal", sql="SELECT attempt, max(sequence) AS sequence, 'check_end' AS kind FROM journal WHERE kind = 'check_end' GROUP BY attempt")
def journal_latest_assessment(j: DataFrame) -> DataFrame:
    return journal.latest_assessment(j)


@query("requests", "ledger", sql="""SELECT r.work_item_id, CASE WHEN last_state_sha256 = 'bad' THEN 'invalid_advice_ledger' WHEN expected_used <> coalesce(requests_used, 0) THEN 'advice_ledger_count_mismatch'
    WHEN expected_used = 0 AND (previous_state_sha256 IS NOT NULL OR change_reason IS NOT NULL) THEN 'invalid_initial_advice_basis' WHEN expected_used <> 0 AND (previous_state_sha256 IS DISTINCT FROM last_state_sha256 OR coalesce(trim(change_reason), '') = '') THEN 'advice_ledger_state_mismatch'
    WHEN state_hash = coalesce(last_state_sha256, '') THEN 'unchanged_advice_state' WHEN coalesce(requests_used, 0) >= 2 THEN 'advice_budget_exhausted' END AS error FROM requests r LEFT JOIN ledger l ON l.work_item_id = r.work_item_id""")
def ledger_request_errors(r: DataFrame, ledger: DataFrame) -> DataFrame:
    return journal.request_errors(r, ledger)


@query("requests", "ledger", sql="SELECT r.work_item_id, coalesce(requests_used, 0) AS requests_used, last_state_sha256 FROM requests r LEFT JOIN ledger l ON l.work_item_id = r.work_item_id")
def ledger_snapshot(r: DataFrame, ledger: DataFrame) -> DataFrame:
    return journal.ledger_snapshot(r, ledger)


@query("orders", sql="""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown_choice' WHEN o_orderkey % 7 = 1 THEN 'invalid_distribution_keys' WHEN o_orderkey % 7 = 2 THEN 'invalid_distribution_value' WHEN o_orderkey % 7 = 3 THEN 'invalid_distribution_sum' WHEN o_orderkey % 7 = 4 THEN 'inconsistent_choice' WHEN o_orderkey % 7 = 5 THEN 'invalid_confidence' END AS error FROM orders""")
def distribution_errors(o: DataFrame) -> DataFrame:
    m = lambda **kv: F.create_map(*[F.lit(x) for k, v in kv.items() for x in (k, v)])
    r = F.col("o_orderkey") % 7
    p = F.when(r == 1, m(a=1.0)).when(r == 2, m(a=1.5, b=-0.5)).when(r == 3, m(a=0.7, b=0.302)).when(r == 4, m(a=0.4, b=0.6)).otherwise(m(a=0.6, b=0.4005))
    return journal.distribution_errors(o.select(F.col("o_orderkey").alias("id"), F.when(r == 0, "z").otherwise("a").alias("choice"), F.array(F.lit("a"), F.lit("b")).alias("options"), p.alias("probabilities"), F.when(r == 5, 1.5).otherwise(0.5).alias("confidence")))


@query("orders", sql="SELECT 'p' || (o_custkey % 10) AS pool, count(*) AS used, 100 + 10 * (o_custkey % 10) AS most FROM orders GROUP BY o_custkey % 10 HAVING count(*) > 100 + 10 * (o_custkey % 10)")
def capacity_errors(o: DataFrame) -> DataFrame:
    pool = o.select(F.concat(F.lit("p"), F.col("o_custkey") % 10).alias("pool"), "o_orderkey")
    limits = o.select((F.col("o_custkey") % 10).alias("k")).distinct().select(F.concat(F.lit("p"), "k").alias("pool"), (100 + 10 * F.col("k")).alias("most"))
    return journal.capacity_errors(pool.where("o_orderkey % 2 = 0"), pool.where("o_orderkey % 2 = 1"), limits)


@query("lineitem", sql="SELECT l_orderkey AS task, l_suppkey % 2 AS model, bool_and(l_discount >= 0.03) AS qualified FROM lineitem GROUP BY 1, 2")
def qualified(li: DataFrame) -> DataFrame:
    return journal.qualified(li.select(F.col("l_orderkey").alias("task"), (F.col("l_suppkey") % 2).alias("model"), F.col("l_discount").alias("probability")), 0.03)


@query("lineitem", sql="SELECT pool, task, model FROM (SELECT l_suppkey % 4 AS pool, l_orderkey AS task, min({'l': l_linenumber, 'p': l_partkey}).p AS model, row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_orderkey) AS n FROM lineitem GROUP BY 1, 2) WHERE n <= 25")
def assigned(li: DataFrame) -> DataFrame:
    return journal.assign(li.select((F.col("l_suppkey") % 4).alias("pool"), F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("model"), F.col("l_linenumber").alias("preference")), 25)


@query("orders", sql="""SELECT o_orderkey AS id, CASE WHEN e IS NULL THEN greatest(0.0, 100 - u) END AS remaining_percent, e AS error FROM (SELECT o_orderkey, o_totalprice / 3000 AS u, CASE WHEN o_orderkey % 11 = 0 THEN 'usage_unavailable' WHEN o_totalprice / 3000 >= 100 THEN 'quota_exhausted_or_unmapped_sublimit' WHEN o_orderdate <= TIMESTAMP '1995-01-01' THEN 'reset_requires_refresh' WHEN o_orderkey % 13 = 0 THEN 'invalid_duration' END AS e FROM orders)""")
def quota_windows(o: DataFrame) -> DataFrame:
    now = F.lit("1995-01-01").cast("timestamp_ntz")
    d = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 3000).alias("used_percent"), F.col("o_orderdate").alias("resets_at"), now.alias("now"), now.alias("observed_at"), F.when(F.col("o_orderkey") % 13 == 0, 0).otherwise(60).alias("duration_minutes"))
    return journal.quota_windows(d)


@query("events", sql="SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(e: DataFrame) -> DataFrame:
    return e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("part", "paths", sql="SELECT CASE WHEN e IN ('ts', 'tsx', 'js') THEN 'typescript' WHEN e = 'rs' THEN 'rust' WHEN e = 'py' THEN 'python' END AS language, count(*) AS n FROM (SELECT lower(regexp_extract(path, '[^/][.]([^./]+)$', 1)) AS e FROM paths) GROUP BY 1")
def language_counts(_: DataFrame, p: DataFrame) -> DataFrame:
    return p.groupBy(paths.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n"))
