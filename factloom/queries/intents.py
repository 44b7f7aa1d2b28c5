"""Write intents, usage, corrections and plans: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import hazards, journal, usage
from factloom.queries.relational import query
from factloom.queries.scalars import _SCOPES

c = F.col


@query("orders", sql="SELECT o_orderkey AS intent_id, 'writeback' AS stage, 'raw_stale_source' AS reason, 's' || (o_orderkey % 3) || '/t' || (o_orderkey % 2) AS evidence FROM orders WHERE o_orderkey % 3 <> o_custkey % 5 % 3 OR o_orderkey % 2 <> o_custkey % 5 % 2")
def base_stalls(o: DataFrame) -> DataFrame:
    name = lambda p, x: F.concat(F.lit(p), x)
    i = o.select(c("o_orderkey").alias("intent_id"), (c("o_custkey") % 5).alias("repo"), name("s", c("o_orderkey") % 3).alias("git_sha"), name("t", c("o_orderkey") % 2).alias("worktree"))
    r = c("repo")
    return hazards.base_stalls(i, i.select("repo").distinct().select("repo", name("s", r % 3).alias("git_sha"), name("t", r % 2).alias("worktree")))


@query("lineitem", sql="""SELECT l_orderkey * 10 + l_linenumber AS intent_id, 'hazard' AS stage, 'stale_' || ['decode', 'graph', 'truth', 'capability', 'verification'][l_suppkey % 5 + 1] || '_epoch' AS reason, 'e' || (l_partkey % 3) || ' is not e' || (l_suppkey % 5 % 3) AS evidence FROM lineitem WHERE l_partkey % 3 <> l_suppkey % 5 % 3""")
def epoch_stalls(li: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, hazards.EPOCHS))
    r = li.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("intent_id"), F.lit("r").alias("repo"), F.get(names, (c("l_suppkey") % 5).cast("int")).alias("name"), F.concat(F.lit("e"), c("l_partkey") % 3).alias("epoch"))
    w = li.select((c("l_suppkey") % 5).alias("k")).distinct().select(F.lit("r").alias("repo"), F.get(names, c("k").cast("int")).alias("name"), F.concat(F.lit("e"), c("k") % 3).alias("epoch"))
    return hazards.epoch_stalls(r, w)


@query("claims2", sql=_SCOPES + """, m AS (SELECT DISTINCT a, ka, fa, ha FROM h), o2 AS (SELECT DISTINCT b, kb, fb, hb FROM h)
SELECT m.a AS intent_id, o2.b AS other_id FROM m, o2 WHERE CASE WHEN ka = 'none' OR kb = 'none' THEN false WHEN ka IS NULL OR kb IS NULL THEN true WHEN 'repo' IN (ka, kb) THEN 'cross' NOT IN (ka, kb) WHEN ka = 'cross' AND kb = 'cross' THEN ha <> hb OR starts_with(fb || '/', fa || '/') OR starts_with(fa || '/', fb || '/') WHEN 'cross' IN (ka, kb) THEN false ELSE starts_with(fb || '/', fa || '/') OR starts_with(fa || '/', fb || '/') END""")
def claim_conflicts(d: DataFrame) -> DataFrame:
    """Between the distinct claims, so that many intents with the same claim make no pairs."""
    side = lambda x: d.select(c(x).alias("intent_id"), F.lit(x).alias("agent"), c(x).alias("claim")).distinct()
    return hazards.claim_conflicts(side("b"), side("a"))


@query("claims2", sql=_SCOPES + " SELECT id AS intent_id, 'writeback' AS stage, 'unparseable_write_scope' AS reason, a AS evidence FROM h WHERE ka IS NULL")
def unreadable_claims(d: DataFrame) -> DataFrame:
    return hazards.unreadable_claims(d.select(c("id").alias("intent_id"), c("a").alias("claim")))


@query("orders", sql="""SELECT o_orderkey AS intent_id, 'writeback' AS stage, 'precision_writeback_blocked' AS reason, 'intent_mode=' || CASE WHEN o_orderkey % 2 = 0 THEN 'autonomous_write' ELSE 'preview_only' END || '; autonomous_write_ready=' || CASE WHEN o_orderkey % 3 <> 0 THEN 'true' ELSE 'false' END
    || CASE WHEN o_orderkey % 5 = 0 THEN '; calibration_profile=p' ELSE '' END || CASE WHEN o_orderkey % 7 = 0 THEN '; precision_blockers=ambiguous,unverified' ELSE '' END || CASE WHEN o_orderkey % 11 = 0 THEN '; evidence_tiers=a:1,b:' || (o_custkey % 4) ELSE '' END AS evidence
FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0)""")
def precision_stalls(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    tiers = F.when(k % 11 == 0, F.create_map(F.lit("b"), (c("o_custkey") % 4).cast("int"), F.lit("a"), F.lit(1))).otherwise(F.create_map().cast("map<string,int>"))
    return hazards.precision_stalls(o.select(k.alias("intent_id"), F.when(k % 2 == 0, "autonomous_write").otherwise("preview_only").alias("mode"), (k % 3 != 0).alias("ready"), F.when(k % 5 == 0, "p").alias("profile"), F.when(k % 7 == 0, F.array(F.lit("unverified"), F.lit("ambiguous"))).otherwise(F.array().cast("array<string>")).alias("blockers"), tiers.alias("tiers")))


_HIT = """SELECT DISTINCT l_orderkey AS intent_id, c_custkey AS evidence_id, ['verified', 'stale', 'contradicted', 'unverified'][c_custkey % 4 + 1] AS status, 'e' || (c_custkey % 3) AS epoch FROM lineitem JOIN customer ON l_partkey IN (c_custkey, c_custkey + 7) WHERE c_custkey % 4 <> 0"""


def _hit(li: DataFrame, cu: DataFrame) -> DataFrame:
    k = c("c_custkey")
    e = cu.select(k.alias("evidence_id"), F.get(F.array(*map(F.lit, hazards.DOC_REASONS)), (k % 4).cast("int")).alias("status"), F.concat(F.lit("e"), k % 3).alias("epoch"), F.array(k, k + 7).alias("files"))
    return hazards.affected(li.select(c("l_orderkey").alias("intent_id"), c("l_partkey").alias("file")), e)


@query("lineitem", "customer", sql=_HIT)
def affected_evidence(li: DataFrame, cu: DataFrame) -> DataFrame:
    return _hit(li, cu)


@query("lineitem", "customer", sql=f"SELECT intent_id, 'hazard' AS stage, CASE status WHEN 'contradicted' THEN 'contradicted_docs' ELSE 'stale_docs' END AS reason, evidence_id AS evidence FROM ({_HIT}) WHERE (intent_id + evidence_id) % 3 <> 0")
def evidence_stalls(li: DataFrame, cu: DataFrame) -> DataFrame:
    h = _hit(li, cu)
    known = h.where((c("intent_id") + c("evidence_id")) % 3 < 2).withColumn("epoch", F.when((c("intent_id") + c("evidence_id")) % 3 == 1, "old").otherwise(c("epoch")))
    return hazards.evidence_stalls(h, known, hazards.DOC_REASONS)


@query("lineitem", "customer", sql=f"SELECT intent_id, 'writeback' AS stage, CASE status WHEN 'contradicted' THEN 'contradicted_docs' ELSE 'stale_docs' END AS reason, evidence_id AS evidence FROM ({_HIT}) WHERE (intent_id + evidence_id) % 3 = 0 AND NOT (status = 'contradicted' AND intent_id % 2 = 0 AND epoch <> 'e1')")
def uncovered_updates(li: DataFrame, cu: DataFrame) -> DataFrame:
    h = _hit(li, cu)
    u = h.select("intent_id", "evidence_id", F.lit("update_code").alias("action"), F.when(c("intent_id") % 2 == 0, "e1").otherwise(" ").alias("produced_epoch"))
    return hazards.uncovered_updates(h, h.where((c("intent_id") + c("evidence_id")) % 3 == 0), u, hazards.DOC_REASONS, hazards.DOC_RECOVERY)


@query("orders", sql="""SELECT o_orderkey AS intent_id, 'writeback' AS stage, 'unclaimed_write_scope' AS reason, 'src/a' || (o_custkey % 4) || '/b.ts is not covered by ' || concat_ws(', ', CASE WHEN NOT g THEN 'claimed_files' END, CASE WHEN o_orderkey % 5 = 0 THEN 'touched_addresses' END, CASE WHEN o_orderkey % 7 = 0 THEN 'expected_source_hashes' END) AS evidence
FROM (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN true WHEN 1 THEN o_custkey % 4 = 1 WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE o_custkey % 4 = 2 END AS g FROM orders) WHERE NOT g OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0""")
def scope_gaps(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    w = o.select(k.alias("intent_id"), F.concat(F.lit("src/a"), c("o_custkey") % 4, F.lit("/b.ts")).alias("file"))
    claim = F.when(k % 6 == 0, ".").when(k % 6 == 1, "src/a1").when(k % 6 == 2, "src/").when(k % 6 == 3, "../src").when(k % 6 == 4, "/src").otherwise("src/a2/b.ts")
    return hazards.scope_gaps(w, o.select(k.alias("intent_id"), claim.alias("claim")), w.where(c("intent_id") % 5 != 0), w.where(c("intent_id") % 7 != 0))


@query("lineitem", sql="SELECT l_orderkey AS bundle_id, l_suppkey AS file, count(*) - 1 AS extra FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_files(li: DataFrame) -> DataFrame:
    return hazards.repeated_files(li.select(c("l_orderkey").alias("bundle_id"), c("l_suppkey").alias("file")))


def _bundle(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    op = F.when(k % 3 == 0, "create").when(k % 3 == 1, "replace").otherwise("delete")
    file = F.concat(F.lit("f"), k)
    proof = F.when(k % 5 != 0, F.sha2(F.concat(F.lit("s\0t\0"), file, F.lit("\0")), 256)).otherwise("x")
    content = F.when(k % 4 != 0, F.concat(F.lit("c"), c("o_custkey")))
    return o.select(
        k.alias("bundle_id"), file.alias("file"), op.alias("operation"), (k % 7 != 0).alias("claimed"), (k % 11 != 0).alias("touched"), (k % 13 != 0).alias("hashed"), F.when(k % 2 == 0, F.concat(F.lit("h"), k % 17)).otherwise("").alias("base_hash"), content.alias("proposed"),
        proof.alias("nonexistence"), F.lit("s").alias("git_sha"), F.lit("t").alias("worktree"), F.lit("h0").alias("expected_hash"), F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("c"), c("o_custkey") - (k % 9 == 0).cast("int")), 256)).alias("proposed_hash"),
    )


@query("orders", sql="""SELECT * FROM (SELECT o_orderkey AS bundle_id, 'f' || o_orderkey AS file, concat_ws(', ', CASE WHEN o_orderkey % 7 = 0 THEN 'claimed_files' END, CASE WHEN op = 0 AND o_orderkey % 5 = 0 THEN 'nonexistence_evidence' END, CASE WHEN op > 0 AND o_orderkey % 11 = 0 THEN 'touched_addresses' END, CASE WHEN op > 0 AND o_orderkey % 13 = 0 THEN 'expected_source_hashes' END,
    CASE WHEN op > 0 AND o_orderkey % 2 = 1 THEN 'bundle.expected_base_source_hash' END, CASE WHEN op < 2 AND o_orderkey % 4 = 0 THEN 'proposed_bytes' END, CASE WHEN op = 2 AND o_orderkey % 4 <> 0 THEN 'no_proposed_bytes_for_delete' END) AS missing FROM (SELECT *, o_orderkey % 3 AS op FROM orders)) WHERE missing <> ''""")
def bundle_gaps(o: DataFrame) -> DataFrame:
    return hazards.bundle_gaps(_bundle(o))


@query("orders", sql="SELECT o_orderkey AS bundle_id, 'f' || o_orderkey AS file, 'base_hash' AS problem FROM orders WHERE CASE WHEN o_orderkey % 2 = 0 THEN 'h' || (o_orderkey % 17) ELSE '' END <> 'h0' UNION ALL SELECT o_orderkey, 'f' || o_orderkey, 'proposed_hash' FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 9 = 0")
def bundle_hash_conflicts(o: DataFrame) -> DataFrame:
    return hazards.bundle_hash_conflicts(_bundle(o))


@query("orders", "customer", sql="""SELECT file, hash FROM (SELECT file, arg_max(op, seq) AS op, arg_max(hash, seq) AS hash FROM (SELECT c_custkey AS file, -1 AS seq, 1 AS op, 'w' AS hash FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_orderkey % 3, 'h' || o_orderkey FROM orders) GROUP BY file) WHERE op <> 0""")
def fold_bundles(o: DataFrame, cu: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    ops = o.select(c("o_custkey").alias("file"), k.alias("seq"), F.when(k % 3 == 0, "delete").otherwise("replace").alias("operation"), F.concat(F.lit("h"), k).alias("hash"))
    return hazards.fold_bundles(cu.where("c_custkey % 2 = 0").select(c("c_custkey").alias("file"), F.lit("w").alias("hash")), ops)


# Journals and plans

_CORR = ", e AS (SELECT *, CASE WHEN sequence % 5 = 0 THEN 'check_correction' ELSE kind END AS k, CASE WHEN sequence % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, sequence % 2 = 0 AS accepted FROM journal)"


def _corrections(j: DataFrame) -> DataFrame:
    s = c("sequence")
    d = j.select("attempt", "sequence", F.when(s % 5 == 0, "check_correction").otherwise(c("kind")).alias("kind"), F.when(s % 7 == 0, "failed").otherwise("completed").alias("status"), (s % 2 == 0).alias("accepted"))
    return d.withColumn("supersedes", F.expr("last(CASE WHEN kind IN ('check_end', 'check_correction') THEN sequence END, true) OVER (PARTITION BY attempt ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)") + (s % 3 == 0).cast("int")).withColumn("reason", F.when(s % 11 != 0, "r"))


@query("journal", sql=_CORR + """, l AS (SELECT *, last_value(CASE WHEN k IN ('check_end', 'check_correction') THEN sequence END IGNORE NULLS) OVER w AS latest, first_value(CASE WHEN k = 'finish' THEN status END IGNORE NULLS) OVER w AS ended FROM e WINDOW w AS (PARTITION BY attempt ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT attempt, sequence, CASE WHEN latest IS NULL OR sequence % 11 = 0 THEN 'sequence_and_reason_required' WHEN sequence % 3 = 0 THEN 'must_supersede_latest' WHEN accepted AND ended IS DISTINCT FROM 'completed' THEN 'failed_transport' END AS error FROM l WHERE k = 'check_correction'""")
def correction_errors(j: DataFrame) -> DataFrame:
    return journal.correction_errors(_corrections(j))


@query("journal", sql=_CORR + """, a AS (SELECT attempt, bool_or(k = 'prepare') AS p, count(*) FILTER (WHERE k = 'dispatch') AS n, arg_max(status, sequence) FILTER (WHERE k = 'finish') AS done, arg_max(accepted, sequence) FILTER (WHERE k = 'check_end') AS ch, arg_max(accepted, sequence) FILTER (WHERE k = 'check_correction') AS co FROM e GROUP BY attempt),
s AS (SELECT count(*) FILTER (WHERE p) AS assigned, sum(n)::BIGINT AS attempted, count(*) FILTER (WHERE p AND coalesce(co, ch)) AS accepted, count(*) FILTER (WHERE p AND done = 'failed') AS failed_transport, count(*) FILTER (WHERE p AND done IS NULL) AS pending, count(*) FILTER (WHERE p AND coalesce(co, ch) IS NULL) AS unverified FROM a)
SELECT *, assigned > 0 AND pending = 0 AND unverified = 0 AS may_complete FROM s""")
def run_summary(j: DataFrame) -> DataFrame:
    return journal.run_summary(_corrections(j))


@query("requests", "ledger", sql="SELECT work_item_id, requests_used, last_state_sha256 FROM ledger UNION ALL SELECT work_item_id, 1, state_hash FROM requests r WHERE expected_used = 0 AND previous_state_sha256 IS NULL AND change_reason IS NULL AND work_item_id NOT IN (SELECT work_item_id FROM ledger)")
def ledger_reserve(r: DataFrame, ledger: DataFrame) -> DataFrame:
    new = r.where("expected_used = 0 and previous_state_sha256 is null and change_reason is null").join(ledger, "work_item_id", "left_anti")
    return journal.reserve(ledger, new)


@query("requests", "ledger", sql="SELECT work_item_id, requests_used, last_state_sha256 FROM ledger")
def ledger_refused(r: DataFrame, ledger: DataFrame) -> DataFrame:
    return journal.reserve(ledger, r)


@query("orders", sql="""SELECT o_orderkey AS id, CASE WHEN u >= 2 THEN 'advice_budget_exhausted' WHEN u = 0 AND o_custkey % 2 = 0 THEN 'invalid_initial_advice_basis' WHEN u = 1 AND (o_custkey % 2 = 1 OR o_orderkey % 5 = 0) THEN 'invalid_advice_basis' WHEN u = 1 AND o_orderkey % 7 = 0 THEN 'unchanged_advice_state' END AS error FROM (SELECT *, o_orderkey % 3 AS u FROM orders)""")
def advice_basis_errors(o: DataFrame) -> DataFrame:
    k, h = c("o_orderkey"), F.sha2(F.lit("a"), 256)
    return journal.advice_basis_errors(o.select(k.alias("id"), (k % 3).alias("used"), F.when(c("o_custkey") % 2 == 0, h).alias("previous"), F.when((k % 3 == 1) & (k % 5 != 0), "r").alias("reason"), F.when(k % 7 == 0, h).otherwise("z").alias("state_hash")))


@query("lineitem")
def cache_hits(li: DataFrame) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")).cast("bigint")
    return journal.cache_hits(li.select(c("l_suppkey").alias("cache"), n.alias("seq"), F.concat(F.lit("p"), c("l_partkey") % 20).alias("address"), c("l_quantity").cast("bigint").alias("size")), 100)


@query("lineitem", sql="SELECT l_suppkey AS cache, count(*) AS lookups, count(*) FILTER (WHERE l_partkey % 3 = 0) AS hits, count(*) FILTER (WHERE l_partkey % 3 = 0) * 10000 // count(*) AS basis_points FROM lineitem GROUP BY l_suppkey")
def hit_rate(li: DataFrame) -> DataFrame:
    return journal.hit_rate(li.select(c("l_suppkey").alias("cache"), (c("l_partkey") % 3 == 0).alias("hit")))


@query("customer", "nation", "region", sql="SELECT 'fit_' || (row_number() OVER (ORDER BY c_custkey DESC, n_name, r_name) - 1) AS question_id, c_custkey AS task, n_name AS model, r_name AS criterion FROM customer JOIN nation ON n_regionkey = c_custkey % 5 JOIN region ON r_regionkey <= c_custkey % 3")
def questions(cu: DataFrame, n: DataFrame, r: DataFrame) -> DataFrame:
    t = cu.select(c("c_custkey").alias("task"), (-c("c_custkey")).alias("place"))
    p = t.withColumn("k", c("task") % 5).join(n, c("n_regionkey") == c("k")).select("task", c("n_name").alias("place"), c("n_name").alias("model"))
    k = t.withColumn("x", F.explode(F.sequence(F.lit(0), c("task") % 3))).join(r, c("r_regionkey") == c("x")).select("task", c("r_name").alias("place"), c("r_name").alias("criterion"))
    return journal.questions(t, p, k)


@query("orders", "customer", sql="""SELECT task, model, error FROM (SELECT o_orderkey AS task, o_orderkey % 3 AS model, CASE WHEN c_custkey IS NULL OR o_orderkey % 10 = 0 THEN 'unknown_or_duplicate_task' WHEN o_orderkey % 4 = 0 THEN 'task_not_dispatch_ready' WHEN o_orderkey % 3 = 2 THEN 'ineligible_model' END AS error
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 9 <> 0, (SELECT unnest([0, 1]) AS twice) WHERE twice = 0 OR o_orderkey % 10 = 0) WHERE error IS NOT NULL""")
def plan_errors(o: DataFrame, cu: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    t = o.join(cu.where("c_custkey % 9 <> 0"), c("o_custkey") == c("c_custkey"), "left_semi").select(k.alias("task"), (k % 4 != 0).alias("ready"))
    a = o.select(k.alias("task"), (k % 3).alias("model"), F.explode(F.sequence(F.lit(0), F.when(k % 10 == 0, 1).otherwise(0))))
    return journal.plan_errors(a.drop("col"), t, t.select("task", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("model")))


@query("orders", sql="SELECT o_orderkey AS task, CASE WHEN o_orderkey % 3 = 0 THEN 'eligible_and_excluded' ELSE 'roster_not_covered' END AS error FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 4 = 0")
def roster_errors(o: DataFrame) -> DataFrame:
    k, a = c("o_orderkey"), lambda *x: F.array(*map(F.lit, x))
    return journal.roster_errors(o.select(k.alias("task"), a("x", "y").alias("eligible"), F.when(k % 3 == 0, a("y")).otherwise(a("z")).alias("excluded"), F.when(k % 4 == 0, a("x", "w")).otherwise(a("x", "y")).alias("required")))


@query("orders", sql="SELECT o_orderkey AS task, CASE WHEN o_custkey % 7 <> 0 THEN o_custkey END AS model, CASE WHEN o_custkey % 7 = 0 THEN 'local_runtime_changed' END AS reason FROM orders")
def withdrawn(o: DataFrame) -> DataFrame:
    return journal.withdrawn(o.select(c("o_orderkey").alias("task"), c("o_custkey").alias("model")), o.where("o_custkey % 7 = 0").select(c("o_custkey").alias("model")))


# Usage

_RAW = """'{"usage": {"input_tokens": ' || o_custkey || ', "output_tokens": ' || CASE o_orderkey % 4 WHEN 0 THEN '-1' WHEN 1 THEN '2.5' WHEN 2 THEN '"x"' ELSE '7' END || '}, "stats": {"input_tokens": 3}, "total_cost_usd": 0.25}'"""


@query("orders", sql=f"""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 3 AS p, o_custkey, o_orderkey % 4 AS k FROM orders), n AS (SELECT unnest({list(usage.NAMES)}) AS measurement)
SELECT id, measurement, CASE WHEN p = 0 AND measurement = 'native_input_tokens' THEN o_custkey::DOUBLE WHEN p = 0 AND measurement = 'native_output_tokens' AND k = 3 THEN 7.0 WHEN p = 0 AND measurement = 'provider_estimated_cost_usd' THEN 0.25 WHEN p = 1 AND measurement = 'native_input_tokens' THEN 3.0 END AS value,
  CASE WHEN (p = 0 AND measurement IN ('native_input_tokens', 'provider_estimated_cost_usd')) OR (p = 1 AND measurement = 'native_input_tokens') THEN NULL WHEN p = 0 AND measurement = 'native_output_tokens' THEN CASE k WHEN 3 THEN NULL WHEN 1 THEN 'noninteger count at usage.output_tokens' ELSE 'invalid value at usage.output_tokens' END ELSE 'not exposed' END AS reason FROM r, n""")
def extract_usage(o: DataFrame) -> DataFrame:
    raw = F.expr(_RAW)
    return usage.extract_usage(o.select(c("o_orderkey").alias("id"), F.get(F.array(*map(F.lit, usage.COUNTERS)), (c("o_orderkey") % 3).cast("int")).alias("provider"), raw.alias("raw")))


@query("orders", sql="""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 < 7 AND o_orderkey % 13 <> 0 AND o_orderkey % 7 <> 6 THEN greatest(0, o_orderkey % 10 * 60 - 4) END AS age_seconds, CASE WHEN o_orderkey % 13 = 0 THEN 'invalid_max_age' WHEN o_orderkey % 7 = 6 THEN 'invalid_timestamp' WHEN o_orderkey % 10 >= 7 THEN 'stale_or_future_snapshot' END AS error FROM orders""")
def freshness_errors(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    at = F.concat(F.date_format(now - F.make_dt_interval(mins=k % 10, secs=F.lit(-4)), "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 7 == 6, "").otherwise("Z"))
    return usage.freshness_errors(o.select(k.alias("id"), at.alias("observed_at"), now.alias("now"), F.when(k % 13 == 0, 0).otherwise(360).alias("max_age")))


@query("lineitem", sql="""WITH w AS (SELECT l_orderkey AS s, 'w' || l_linenumber AS label, CASE WHEN l_suppkey % 97 = 0 THEN 4 WHEN l_partkey % 89 = 0 THEN 6 END AS rule, 's' || (l_suppkey % 2) AS scope FROM lineitem), g AS (SELECT s, min(rule) AS rule, count(*) > count(DISTINCT label) AS twice, count(DISTINCT scope) AS n FROM w GROUP BY s)
SELECT * FROM (SELECT s AS snapshot, CASE WHEN twice THEN 'duplicate_window' WHEN rule = 4 THEN 'usage_unavailable' WHEN rule = 6 THEN 'inconsistent_remaining' WHEN n < 2 THEN 'missing_shared_window' END AS error FROM g) WHERE error IS NOT NULL""")
def usage_window_errors(li: DataFrame) -> DataFrame:
    used = c("l_quantity")
    w = li.select(c("l_orderkey").alias("snapshot"), F.concat(F.lit("w"), "l_linenumber").alias("label"), F.concat(F.lit("s"), c("l_suppkey") % 2).alias("scope"), F.lit("subscription quota").alias("kind"), F.lit("percent").alias("unit"), F.when(c("l_suppkey") % 97 != 0, "observed").alias("status"), used.alias("used"), (100 - used - F.when(c("l_partkey") % 89 == 0, 0.01).otherwise(0.0005)).alias("remaining"))
    return usage.window_errors(w, ("s0", "s1"))


@query("lineitem", sql="SELECT * FROM (SELECT l_orderkey AS snapshot, CASE WHEN count(*) > 4 THEN 'invalid_bundle' WHEN count(DISTINCT l_suppkey % 20) < count(*) OR count(DISTINCT l_partkey) < count(*) THEN 'duplicate_provider_or_pool' END AS error FROM lineitem GROUP BY l_orderkey) WHERE error IS NOT NULL")
def pool_errors(li: DataFrame) -> DataFrame:
    return usage.pool_errors(li.select(c("l_orderkey").alias("snapshot"), (c("l_suppkey") % 20).alias("provider"), c("l_partkey").alias("pool_alias")))


@query("orders", sql="SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_custkey % 3 = 0 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN 'exhausted' ELSE 'ready' END AS status FROM orders")
def billing_status(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    percent = F.when(k % 5 == 0, "null").when(k % 2 == 0, "100").otherwise("41.5")
    end = F.when(k % 7 == 0, "2024-05-09T00:00:00").otherwise("2024-05-09T00:00:00Z")
    raw = F.concat(F.lit('{"config": {"creditUsagePercent": '), percent, F.lit(', "currentPeriod": {"start": "2024-05-02T02:00:00+02:00", "end": "'), end, F.lit('"}}}'))
    now = F.when(c("o_custkey") % 3 == 0, "2024-05-09 00:00:00").otherwise("2024-05-02 00:00:00").cast("timestamp")
    return usage.billing_status(o.select(k.alias("id"), raw.alias("raw"), now.alias("now")))


@query("part", sql="SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'invalid_local_memory' WHEN p_size % 3 = 0 THEN 'local_pressure_unavailable_or_critical' WHEN p_size % 4 > 1 THEN 'local_slot_unavailable' WHEN p_partkey % 7 = 0 THEN 'local_model_not_ready' WHEN p_partkey % 11 = 0 THEN 'unsupported_local_runtime_capacity' END AS error FROM part")
def host_errors(p: DataFrame) -> DataFrame:
    k = c("p_partkey")
    return usage.host_errors(p.select(k.alias("id"), F.when(k % 5 != 0, 8).alias("memory_bytes"), F.lit(50.0).alias("free_percent"), (c("p_size") % 3).alias("pressure"), (c("p_size") % 4).alias("active"), F.when(k % 7 == 0, 2).otherwise(1).alias("instances"), F.when(k % 11 != 0, 1).alias("parallel")))
