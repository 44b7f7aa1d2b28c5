"""Queries of linking, on small projects made of the customers' numbers, and of what packets and attempts say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import jsonc
from factloom.operators import journal, linking, symbols
from factloom.plans.stages import written
from factloom.queries.inputs import FNV
from factloom.queries.relational import query
from factloom.sources import code

c = F.col
N = "c_custkey"


def _events(cu: DataFrame, source: Column, language: str) -> DataFrame:
    """Written, as all of linking reads events several times."""
    return written(code.events(cu.select(c(N).cast("string").alias("path"), source.alias("source"), F.lit(language).alias("language"))))


def _project(cu: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every fifth file declares ``base``, the others pass it on; each calls what the file before it exports."""
    before = (c(N) - 1).cast("string")
    own = F.when(c(N) % 5 == 0, "export function base() {}\n").otherwise(F.concat(F.lit("export * from './"), before, F.lit("';\n")))
    registry = F.concat(F.lit("const r = { 'k"), c(N), F.lit("': () => import('./"), before, F.lit("'), other: [1, { deep: require('./"), before, F.lit("') }], ...rest, t: import(`./${x}`) };\n"))
    layers = F.concat(F.lit("export const P"), c(N), F.lit(" = Layer.effect<X<Y>>(S"), c(N) % 3, F.lit(", f);\nconst all = base.pipe(Layer.provide(P"), before, F.lit("));\n"))
    text = F.concat(own, registry, layers, F.lit("import { base as b } from './"), before, F.lit("';\nimport * as all from './"), before, F.lit("';\nb(); all.base(); all.none(); other();\n"))
    targets = cu.where("c_custkey > 1").select(c(N).cast("string").alias("path"), F.concat(F.lit("./"), before).alias("specifier"), before.alias("target"))
    return _events(cu, text, "typescript"), targets


@query("customer", sql="SELECT (c_custkey - c_custkey % 5)::VARCHAR AS file, 'base' AS symbol, c_custkey::VARCHAR AS path, 'wildcard' AS kind, NULL AS alias FROM customer WHERE c_custkey >= 5 AND c_custkey % 5 <> 0 UNION ALL SELECT i::VARCHAR, 'P' || i, c_custkey::VARCHAR, 'wildcard', NULL FROM customer, LATERAL (SELECT unnest(range(greatest(c_custkey - c_custkey % 5, 1), c_custkey)) AS i) WHERE c_custkey % 5 <> 0 AND c_custkey >= 2")
def re_exports(cu: DataFrame) -> DataFrame:
    events, targets = _project(cu)
    return linking.re_exports(events, targets, linking.resolved_exports(events, targets))


@query("customer", sql="SELECT (c_custkey - 1)::VARCHAR AS file, symbol, c_custkey::VARCHAR AS path, CASE v.i WHEN 0 THEN 'k' || c_custkey ELSE 'other' END AS key, CASE v.i WHEN 0 THEN 'import' ELSE 'require' END AS loader FROM customer, (VALUES (0), (1)) AS v(i), LATERAL (SELECT 'P' || (c_custkey - 1) AS symbol UNION ALL SELECT 'base' WHERE (c_custkey - 1) % 5 = 0) WHERE c_custkey > 1")
def registry_exports(cu: DataFrame) -> DataFrame:
    events, targets = _project(cu)
    return linking.registry_exports(events, targets, linking.resolved_exports(events, targets)).drop("start")


@query("customer", sql="SELECT 'S' || (c_custkey % 3) AS service, 'P' || c_custkey AS provider, NULL AS file FROM customer UNION ALL SELECT NULL, CASE c_custkey WHEN 0 THEN 'P' ELSE 'P' || (c_custkey - 1) END, c_custkey::VARCHAR FROM customer")
def provider_tables(cu: DataFrame) -> DataFrame:
    providers, compositions = linking.provider_tables(_project(cu)[0])
    return providers.withColumn("file", F.lit(None).cast("string")).unionByName(compositions.withColumn("service", F.lit(None).cast("string")))


def _crate(cu: DataFrame) -> tuple[DataFrame, DataFrame]:
    before = (c(N) - 1).cast("string")
    text = F.when(c(N) % 5 == 0, "pub fn base() {}\nfn call() { base(); self::base(); }").otherwise(F.concat(F.lit("pub use super::m"), before, F.lit("::{base, base as b};\nfn call() { b(); super::m"), before, F.lit("::base(); none(); }\npub trait Tr {} struct S; impl Tr for S {} impl Lost for S { } impl Gone {}")))
    return _events(cu, text, "rust"), cu.select(c(N).cast("string").alias("path"), F.concat(F.lit("crate::m"), c(N)).alias("module"))


@query("customer", sql="SELECT c_custkey::VARCHAR AS path, 'base' AS name, (c_custkey - c_custkey % 5)::VARCHAR AS file, 'base' AS symbol FROM customer WHERE c_custkey >= 5 OR c_custkey = 0 UNION ALL SELECT c_custkey::VARCHAR, 'P' || i, i::VARCHAR, 'P' || i FROM customer, LATERAL (SELECT unnest(range(greatest(c_custkey - c_custkey % 5, least(c_custkey, 1)), c_custkey + 1)) AS i)")
def resolved_exports(cu: DataFrame) -> DataFrame:
    return linking.resolved_exports(*_project(cu))


@query("customer", sql="SELECT c_custkey::VARCHAR AS path, name, (c_custkey - 1 - (c_custkey - 1) % 5)::VARCHAR AS file, 'base' AS symbol FROM customer, (VALUES ('b'), ('base')) AS v(name) WHERE c_custkey >= 6")
def linked_uses(cu: DataFrame) -> DataFrame:
    events, targets = _project(cu)
    return linking.linked_uses(events, targets, linking.resolved_exports(events, targets)).select("path", "name", "file", "symbol")


@query("customer", sql="SELECT c_custkey::VARCHAR AS path, local, (c_custkey - 1)::VARCHAR AS target, name FROM customer, (VALUES ('b', 'base'), ('all', '*')) AS v(local, name) WHERE c_custkey > 1")
def import_bindings(cu: DataFrame) -> DataFrame:
    return linking.import_bindings(*_project(cu))


@query("customer", sql="SELECT 'crate::m' || c_custkey || '::' || name AS alias, 'crate::m' || (c_custkey - c_custkey % 5) || '::base' AS item FROM customer, (VALUES ('b'), ('base')) AS v(name) WHERE c_custkey % 5 <> 0")
def rust_aliases(cu: DataFrame) -> DataFrame:
    events, modules = _crate(cu)
    return linking.rust_aliases(events, modules, linking.rust_items(events, modules))


@query("customer", sql="""SELECT c_custkey::VARCHAR AS path, name, 'crate::m' || c_custkey || '::base' AS item FROM customer, (VALUES ('base'), ('self::base')) AS v(name) WHERE c_custkey % 5 = 0
UNION ALL SELECT c_custkey::VARCHAR, CASE v.i WHEN 0 THEN 'b' ELSE 'super::m' || (c_custkey - 1) || '::base' END, 'crate::m' || (c_custkey - c_custkey % 5) || '::base' FROM customer, (VALUES (0), (1)) AS v(i) WHERE c_custkey % 5 <> 0""")
def linked_rust_calls(cu: DataFrame) -> DataFrame:
    events, modules = _crate(cu)
    items = linking.rust_items(events, modules)
    return linking.linked_rust_calls(events, modules, items, linking.rust_aliases(events, modules, items)).select("path", "name", "item")


@query("customer", sql="SELECT c_custkey::VARCHAR AS path, 'crate::m' || c_custkey || '::S' AS type, CASE v.i WHEN 0 THEN 'crate::m' || c_custkey || '::Tr' END AS trait FROM customer, (VALUES (0), (1)) AS v(i) WHERE c_custkey % 5 <> 0")
def rust_impls(cu: DataFrame) -> DataFrame:
    events, modules = _crate(cu)
    items = linking.rust_items(events, modules)
    return linking.rust_impls(events, modules, items, linking.rust_aliases(events, modules, items)).select("path", "type", "trait")


@query("customer", sql="SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'function  f(a /* x */, b: T' || c_custkey || ')/2' ELSE 'function f(a , b: T' || c_custkey || ')' END AS signature FROM customer")
def normalized_signatures(cu: DataFrame) -> DataFrame:
    text = F.concat(F.lit("function  f(a /* x */, b: T"), c(N), F.lit(")"), F.when(c(N) % 3 == 0, "/2").otherwise(" // end"))
    return cu.select(c(N).alias("id"), code.normalized_signature(text, F.lit("typescript")).alias("signature"))


@query("customer", sql=f"SELECT c_custkey AS id, lpad(lower(to_hex({FNV.format("hex('fn f(x: u8) -> T' || c_custkey)")})), 16, '0') AS hash FROM customer")
def signature_hashes(cu: DataFrame) -> DataFrame:
    return cu.select(c(N).alias("id"), code.signature_hash(F.concat(F.lit("fn   f(x: /* /* */ */ u8) -> T"), c(N)), F.lit("rust")).alias("hash"))


@query("orders", sql="SELECT o_orderkey AS attempt, CASE WHEN o_custkey % 10 = 9 OR o_orderkey % 7 = 0 THEN 'manifest_changed' WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN 'packet_not_regular' ELSE 'packet_changed' END AS error FROM orders WHERE o_custkey % 10 = 9 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0")
def dispatch_errors(o: DataFrame) -> DataFrame:
    k, run = c("o_orderkey"), c("o_custkey") % 10
    attempts = o.select(k.alias("attempt"), run.alias("run"), k.alias("packet"), F.when(k % 7 == 0, "old").otherwise(F.concat(F.lit("m"), run)).alias("manifest_sha256"), F.lit("p").alias("packet_sha256"))
    manifests = o.select(run.alias("run")).where("run < 9").distinct().select("run", F.concat(F.lit("m"), "run").alias("sha256"))
    return journal.dispatch_errors(attempts, manifests, o.where(k % 11 != 0).select(k.alias("packet"), F.when(k % 17 == 0, "other").otherwise("p").alias("sha256"), (k % 13 == 0).alias("is_link")))


@query("orders", sql="SELECT o_orderkey AS task, 'm' || (o_custkey % 3) AS model, o_orderstatus AS criterion, (o_custkey % 10) / 10.0 AS probability, o_custkey % 10 >= 7 AS reached FROM orders")
def judgment_outcomes(o: DataFrame) -> DataFrame:
    return journal.outcomes(o.select(c("o_orderkey").alias("task"), F.concat(F.lit("m"), c("o_custkey") % 3).alias("model"), c("o_orderstatus").alias("criterion"), (c("o_custkey") % 10 / F.lit(10.0)).alias("probability")), 0.7)


@query("events", sql="SELECT event_id AS id, sha256('{\"evidence\":\"e\",\"goal\":\"g' || event_id || '\",\"lookups\":[{\"reason\":\"r\",\"target\":\"a\",\"tool\":\"context\"},{\"reason\":\"r\",\"target\":\"b\",\"tool\":\"context\"}],\"question\":\"q\"}') AS hash FROM events")
def packet_state_hash(e: DataFrame) -> DataFrame:
    item = lambda i, t: f'{{"id":"{i}","tool":"context","target":"{t}","reason":"r"}}'
    a, b = item(1, "a"), item(2, "b")
    lookups = F.when(c("event_id") % 2 == 0, f"{a},{b}").otherwise(f"{b},{a}")
    raw = F.concat(F.lit('{"goal":"g'), c("event_id"), F.lit('","question":"q","evidence":"e","work_item_id":"w","lookups":['), lookups, F.lit("]}"))
    return e.select(c("event_id").alias("id"), jsonc.state_hash(raw).alias("hash"))


@query("nodes", sql="SELECT node_id, kind IN ('class', 'interface', 'type_alias') AS container, kind IN ('function', 'class', 'variable', 'property') AS callable FROM nodes")
def node_kinds(n: DataFrame) -> DataFrame:
    return n.select("node_id", symbols.is_container(c("kind")).alias("container"), symbols.is_callable(c("kind")).alias("callable"))


@query("customer", sql="SELECT c_custkey AS path, 0 AS place, CASE c_custkey % 2 WHEN 0 THEN 'path' ELSE 'types' END AS attribute, './x' || c_custkey AS target FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 7 <> 0")
def directives(cu: DataFrame) -> DataFrame:
    n = c(N)
    text = F.concat(F.when(n % 7 == 0, "f();\n").otherwise("// first\n/* /// */ "), F.when(n % 3 == 0, "////").otherwise("///"), F.lit(" <reference "), F.when(n % 2 == 0, "path").otherwise("types"), F.lit(" = './x"), n, F.lit("' />\nf();"))
    return code.directives(cu.select(n.alias("path"), text.alias("source")))
