"""Symbols, effects and observations: queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import scope
from factloom.operators import effects, symbols
from factloom.queries.relational import query
from factloom.queries.scalars import _SCOPES

c = F.col
say = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])


@query("orders", sql="SELECT o_orderkey AS id, ['keyword', 'language', 'platform', NULL, 'platform'][o_orderkey % 5 + 1] AS class, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'calls' WHEN o_orderkey % 3 = 1 THEN 'type_ref' ELSE 'value_ref' END AS edge, CASE WHEN o_orderkey % 4 < 2 THEN 'k' || o_custkey END AS key, o_custkey % 7 >= 2 AND o_custkey % 7 + 3 <= 8 AS within FROM orders")
def symbol_scalars(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    name = F.get(F.array(*map(F.lit, ("const", "WeakRef", "Window", "mine", "fetch"))), (k % 5).cast("int"))
    kind = F.when(k % 3 == 0, "function").when(k % 3 == 1, "trait").otherwise("variable")
    prefix = F.when(k % 4 == 0, say("  k", c("o_custkey"), " ?: ")).when(k % 4 == 1, say("a, k", c("o_custkey"), ":")).when(k % 4 == 2, "k = ").otherwise(":")
    s = c("o_custkey") % 7
    return o.select(k.alias("id"), symbols.name_class(name).alias("class"), symbols.reference_edge(kind, c("o_custkey") % 2 == 0).alias("edge"), symbols.property_key(prefix).alias("key"), symbols.within(s, s + 3, F.lit(2), F.lit(8)).alias("within"))


@query("nodes", "labelled", sql="SELECT DISTINCT e.src AS file_id, coalesce(e.label, n.name) AS name FROM labelled e JOIN nodes n ON n.node_id = e.dst WHERE e.kind = 'exports'")
def exports_symbol(n: DataFrame, e: DataFrame) -> DataFrame:
    return symbols.exports_symbol(e, n)


@query("nodes", "edges", sql="SELECT n.node_id FROM nodes n JOIN edges e ON e.kind = 'contains' AND e.dst = n.node_id AND e.src % 3 = 0 WHERE n.kind = 'function'")
def type_members(n: DataFrame, e: DataFrame) -> DataFrame:
    as_types = n.withColumn("kind", F.when(c("kind") == "function", "property").when(c("node_id") % 3 == 0, "interface").otherwise(c("kind")))
    return symbols.type_members(as_types, e)


@query("orders", sql="""WITH d AS (SELECT DISTINCT 'n' || (o_orderkey % 400) AS name, 'f' || (o_custkey % 30) AS file, o_custkey AS line_no FROM orders), t AS (SELECT o_orderkey AS subject_id, unnest(list_distinct(['see', 'n' || (o_orderkey % 700), 'and', 'n' || (o_custkey % 500)])) AS token FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file, line_no) AS n FROM d), g AS (SELECT name, count(*) AS found, string_agg(CASE WHEN n <= 3 THEN file || ':' || line_no END, ', ' ORDER BY n) AS places FROM r GROUP BY name)
SELECT subject_id, token, CASE WHEN found IS NULL THEN 'missing' WHEN found = 1 THEN 'unique' ELSE 'ambiguous' END AS outcome, coalesce(places, '') AS places, greatest(coalesce(found, 0) - 3, 0) AS omitted FROM t LEFT JOIN g ON g.name = t.token""")
def propose_support(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    d = o.select(say("n", k % 400).alias("name"), say("f", c("o_custkey") % 30).alias("file"), c("o_custkey").alias("line_no"))
    return symbols.propose_support(o.select(k.alias("subject_id"), say("see n", k % 700, " and `n", c("o_custkey") % 500, "`.").alias("text")), d, citations=3)


@query("orders", sql="SELECT o_orderkey AS edge_id, CASE WHEN o_orderkey % 3 = 0 THEN 5 WHEN o_orderkey % 3 = 1 THEN 4 END AS line_no FROM orders WHERE o_orderkey % 3 < 2")
def import_lines(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    rows = F.array(F.lit("import {"), F.lit("x"), F.lit("import {"), F.when(k % 3 == 1, "  Nm,").otherwise("  Other,"), F.when(k % 3 == 0, "  Nm as q").otherwise("  Nmx"), F.lit("} from './m'; Nm()"))
    lines = o.select(k.alias("file"), F.posexplode(rows).alias("i", "text")).select("file", (c("i") + 1).alias("line_no"), "text")
    return symbols.import_lines(o.select(k.alias("edge_id"), k.alias("file"), F.lit("Nm").alias("name"), F.lit(5).alias("first"), F.lit(5).alias("last")), lines)


@query("orders", sql="SELECT o_orderkey AS file, unnest([3, 4]) AS line_no, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS start_line FROM orders")
def awaited_bindings(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    rows = F.array(F.when(k % 3 != 0, "const [a] = await Promise.all([").otherwise("if (a == Promise.all([b])) {"), F.when(k % 2 == 0, "let [z] = Promise.all( [").otherwise("x"), F.lit("  import('./m'),"), F.lit("import('n')"), F.lit("]);"))
    return symbols.awaited_bindings(o.select(k.alias("file"), F.posexplode(rows).alias("i", "text")).select("file", (c("i") + 1).alias("line_no"), "text"))


@query("orders", "part", sql="SELECT DISTINCT 'f' || o_orderkey AS file, './p' || (p_partkey % 50) || '/x' || p_partkey || '.ts' AS target FROM orders JOIN part ON p_partkey % 50 = o_custkey % 50 AND starts_with('x' || p_partkey, 'x' || (o_orderkey % 9)) AND length('x' || p_partkey) > length('x' || (o_orderkey % 9)) WHERE o_orderkey % 4 <> 0")
def possible_loads(o: DataFrame, p: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    spec = F.when(k % 4 == 0, "./p/${a}/${b}").otherwise(say("./p", c("o_custkey") % 50, "/x", k % 9, "${name}.ts"))
    path = say("./p", c("p_partkey") % 50, "/x", c("p_partkey"), ".ts")
    return symbols.possible_loads(o.select(say("f", k).alias("file"), spec.alias("specifier")), p.select(path.alias("target"), path.alias("variant")))


@query("orders", "customer", sql="SELECT DISTINCT 'f' || (o_custkey % 40) AS file, 's' || (o_orderkey % 60) AS source FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey % 40 = o.o_custkey % 40 AND c_custkey % 60 = o.o_orderkey % 60)")
def dynamic_reachability(o: DataFrame, cu: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    u = cu.select(say("s", c("c_custkey") % 60).alias("source"), c("c_custkey").alias("node_id"))
    return symbols.dynamic_reachability(o.select(say("s", k % 60).alias("source"), say("f", c("o_custkey") % 40).alias("file")), u, cu.select(say("f", c("c_custkey") % 40).alias("file"), c("c_custkey").alias("node_id")))


@query("orders", "customer", sql="""WITH n AS (SELECT 'n' || (c_custkey % 100) AS name, 'f' || (c_custkey % 3) AS file, c_custkey % 5 AS line_no, c_custkey AS node_id FROM customer), q AS (SELECT o_orderkey AS query, 'n' || (o_orderkey % 120) AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || (o_custkey % 3) END AS file, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 5 END AS line_no FROM orders),
g AS (SELECT query, count(node_id) AS candidates, min(node_id) AS node_id FROM q LEFT JOIN n ON n.name = q.name AND (q.file IS NULL OR q.file = n.file) AND (q.line_no IS NULL OR q.line_no = n.line_no) GROUP BY query)
SELECT query, CASE candidates WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS outcome, CASE WHEN candidates = 1 THEN node_id END AS node_id, candidates FROM g""")
def task_view(o: DataFrame, cu: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    n = c("c_custkey")
    nodes = cu.select(say("n", n % 100).alias("name"), say("f", n % 3).alias("file"), (n % 5).alias("line_no"), n.alias("node_id"))
    return symbols.task_view(nodes, o.select(k.alias("query"), say("n", k % 120).alias("name"), F.when(k % 2 == 0, say("f", c("o_custkey") % 3)).alias("file"), F.when(k % 4 == 0, c("o_custkey") % 5).alias("line_no")))


@query("claims2", sql=_SCOPES + " SELECT id, a, b, coalesce(ka = 'none', false) AND coalesce(kb = 'none', false) AS nothing, coalesce(ka = 'cross', false) OR coalesce(kb = 'cross', false) AS crosses, CASE WHEN overlap THEN a || '|' || b END AS first FROM o")
def scope_sets(d: DataFrame) -> DataFrame:
    both = F.array("a", "b")
    f = scope.first_overlap(F.array("a"), F.array("b"))
    return d.select("id", "a", "b", scope.writes_nothing(both).alias("nothing"), scope.crosses(both).alias("crosses"), F.concat(f["left"], F.lit("|"), f["right"]).alias("first"))


# Effects and observations


def _bundle(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    return o.select(c("o_custkey").alias("bundle_id"), F.when(k % 5 == 0, say("top", k)).otherwise(say("d", k % 3, "/f", k)).alias("file"), F.when(k % 4 == 0, "delete").when(k % 4 == 1, "create").otherwise("replace").alias("operation"))


_EFFECTS = """WITH b AS (SELECT o_custkey AS b, CASE WHEN o_orderkey % 5 = 0 THEN 'top' ELSE 'd' || (o_orderkey % 3) || '/f' END || o_orderkey AS f, CASE WHEN o_orderkey % 5 <> 0 THEN 'd' || (o_orderkey % 3) END AS p, CASE WHEN o_orderkey % 4 = 0 THEN 'file_delete:' ELSE 'file_write:' END AS k FROM orders),
e AS (SELECT DISTINCT b, 'federation_invalidation:' AS effect, NULL::VARCHAR AS file, []::VARCHAR[] AS d FROM b UNION ALL SELECT DISTINCT b, 'receipt_write:', NULL, ['federation_invalidation:'] FROM b UNION ALL SELECT DISTINCT b, 'directory_create:' || p, p, ['federation_invalidation:'] FROM b WHERE p IS NOT NULL
UNION ALL SELECT b, k || f, f, CASE WHEN p IS NULL THEN ['federation_invalidation:'] ELSE ['directory_create:' || p, 'federation_invalidation:'] END FROM b UNION ALL SELECT b, 'ledger_append:' || f, f, [k || f, 'receipt_write:'] FROM b
UNION ALL SELECT b, 'evidence_persist:', NULL, list_sort(['federation_invalidation:', 'receipt_write:'] || list(k || f) || list('ledger_append:' || f)) FROM b GROUP BY b)"""


@query("orders", sql=_EFFECTS + " SELECT b AS bundle_id, effect, file, array_to_string(d, ',') AS depends_on FROM e")
def planned_effects(o: DataFrame) -> DataFrame:
    return effects.planned_effects(_bundle(o)).withColumn("depends_on", F.array_join("depends_on", ","))


@query("orders", sql=_EFFECTS + " SELECT b AS bundle_id, effect, file, CASE WHEN effect IN ('federation_invalidation:', 'receipt_write:') OR effect LIKE 'directory%' THEN 'executed' ELSE 'planned' END AS status FROM e")
def executed_effects(o: DataFrame) -> DataFrame:
    p = effects.planned_effects(_bundle(o)).drop("depends_on")
    return effects.mark_executed(p, p.where("effect in ('federation_invalidation:', 'receipt_write:') or effect like 'directory%'"))


def _observed(o: DataFrame, shift: int) -> DataFrame:
    k = c("o_orderkey")
    r = k + shift
    return o.select(
        k.alias("model"), F.when(r % 5 == 0, "unavailable").otherwise("ready").alias("auth_observed"), F.when(r % 7 == 0, "unknown").otherwise("ready").alias("runtime_capability"), F.lit("ready").alias("billing_status"),
        F.when(r % 11 == 0, "exhausted").otherwise("ready").alias("quota"), F.when(r % 13 != 0, "ready").alias("model_inference"), (c("o_custkey") + shift).alias("observed_at"),
    )


@query("orders", sql="SELECT o_orderkey AS model, NOT (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) AS ready, CASE WHEN o_orderkey % 3 = 0 THEN 'unobserved' ELSE concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'auth_observed:unavailable' END, CASE WHEN o_orderkey % 7 = 0 THEN 'runtime_capability:unknown' END, CASE WHEN o_orderkey % 11 = 0 THEN 'quota:exhausted' END, CASE WHEN o_orderkey % 13 = 0 THEN 'model_inference:null' END) END AS reasons FROM orders")
def model_readiness(o: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    return effects.readiness(o.select(k.alias("model")), _observed(o.where(k % 3 != 0), 0))


@query("orders", sql="""SELECT o_orderkey AS model, CASE WHEN NOT r THEN 'kept' WHEN o_orderkey % 5 = 0 OR o_orderkey % 11 = 0 THEN 'conflict' ELSE 'adopted' END AS outcome, CASE WHEN r AND NOT (o_orderkey % 5 = 0 OR o_orderkey % 11 = 0) THEN o_custkey - 2 ELSE o_custkey END AS observed_at
FROM (SELECT *, NOT (abs(o_orderkey - 2) % 5 = 0 OR abs(o_orderkey - 2) % 7 = 0 OR abs(o_orderkey - 2) % 11 = 0 OR abs(o_orderkey - 2) % 13 = 0) AS r FROM orders)""")
def merged_responses(o: DataFrame) -> DataFrame:
    return effects.merge_responses(_observed(o, 0), _observed(o, -2))


@query("customer", sql="""WITH RECURSIVE t AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey AS n, c_custkey % 9 <> 0 AS ready, c_custkey % 4 <> 0 AS known, [20, 5, 60] AS room FROM customer),
w AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS task, NULL::BIGINT AS pick, NULL::VARCHAR AS reason, [20, 5, 60] AS room, 70 AS spare UNION ALL
SELECT i, n, pick, CASE WHEN NOT ready THEN 'task_not_dispatch_ready' WHEN NOT known THEN 'no_supported_model' WHEN pick IS NULL THEN 'capacity' END, [room[1] - (pick IS NOT DISTINCT FROM 0)::INT, room[2] - (pick IS NOT DISTINCT FROM 1)::INT, room[3] - (pick IS NOT DISTINCT FROM 2)::INT], spare - (pick IS NOT NULL)::INT
FROM (SELECT t.i, t.n, t.ready, t.known, w.room, w.spare, CASE WHEN NOT ready OR NOT known OR spare = 0 THEN NULL WHEN w.room[t.n % 3 + 1] > 0 THEN t.n % 3 WHEN w.room[(t.n + 1) % 3 + 1] > 0 THEN (t.n + 1) % 3 END AS pick FROM w JOIN t ON t.i = w.i + 1))
SELECT task, 'm' || pick AS model, 'p' || pick AS pool, reason FROM w WHERE i > 0""")
def composed_plan(cu: DataFrame) -> DataFrame:
    n = c("c_custkey")
    tasks = cu.select(n.alias("task"), n.alias("place"), (n % 9 != 0).alias("ready"))
    q = cu.where("c_custkey % 4 <> 0").select(n.alias("task"), F.posexplode(F.array(say("m", n % 3), say("m", (n + 1) % 3))).alias("preference", "model")).withColumn("pool", F.concat(F.lit("p"), F.substring("model", 2, 1)))
    return effects.compose(tasks, q, cu.sparkSession.createDataFrame([("p0", 20), ("p1", 5), ("p2", 60)], "pool string, room int"), 70)


@query("orders", "customer", sql="""SELECT o_orderkey AS intent_id, 'f' || o_custkey AS file, CASE WHEN c_custkey % 3 = 0 THEN 'w' || c_custkey WHEN o_orderkey % 2 = 0 THEN 'own' || o_orderkey ELSE 'else' || o_orderkey END AS address FROM orders JOIN customer ON c_custkey = o_custkey""")
def intent_addresses(o: DataFrame, cu: DataFrame) -> DataFrame:
    k = c("o_orderkey")
    i = o.join(cu, c("o_custkey") == c("c_custkey"), "left_semi").select(k.alias("intent_id"), say("f", c("o_custkey")).alias("file"))
    w = cu.where("c_custkey % 3 = 0").select(say("f", c("c_custkey")).alias("file"), say("w", c("c_custkey")).alias("address"))
    t = i.select("intent_id", F.when(c("intent_id") % 2 == 0, c("file")).otherwise("another").alias("file"), F.when(c("intent_id") % 2 == 0, say("own", c("intent_id"))).otherwise(say("else", c("intent_id"))).alias("address"))
    return effects.addresses_for(i, w, t)
