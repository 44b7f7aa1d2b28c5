"""Queries of quota snapshots, on snapshots made of the customers' numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import snapshots
from factloom.queries.relational import query

c = F.col
N = "c_custkey"


def _window(label: Column, scope: str, used: Column, left: Column) -> Column:
    head = F.concat(F.lit('{"label":"'), label, F.lit(f'","scope":"{scope}","kind":"subscription quota","unit":"percent","status":"observed","duration_minutes":300,"resets_at_utc":"2026-05-04T14:00:00Z","used_percent":'), used)
    return F.concat(head, F.lit(',"remaining_percent":'), left, F.lit("}"))


def _rows(cu: DataFrame) -> DataFrame:
    used = c(N) % 120
    left = F.when(c(N) % 7 == 0, F.lit(101)).otherwise(F.greatest(F.lit(0), 100 - used))
    alias = F.when(c(N) % 13 == 0, "Bad").otherwise("pool")
    raw = F.concat(
        F.lit('{"snapshot_id":"s","source":"app","runtime_version":"1","billing_lane":"A subscription","observed_at_utc":"2026-05-04T11:59:00Z","provider":"'), F.when(c(N) % 17 == 0, "Nobody").otherwise("Anthropic"), F.lit('","pool_alias":"'), alias,
        F.lit('","usage_credits_enabled":false,"windows":['), _window(F.lit("a"), snapshots.SHARED_SCOPES[0], used, left), F.lit(","), _window(F.when(c(N) % 11 == 0, "a").otherwise("b"), snapshots.SHARED_SCOPES[1], F.lit(0), F.lit(100)), F.lit("]}"),
    )
    return cu.select(c(N).alias("id"), raw.alias("raw"), F.lit("2026-05-04 12:00:00").cast("timestamp").alias("now"), F.lit(3600).alias("max_age"))


_ERROR = """CASE WHEN c_custkey % 17 = 0 THEN 'unsupported_provider' WHEN c_custkey % 13 = 0 THEN 'invalid_pool_alias' WHEN c_custkey % 120 >= 100 THEN 'quota_exhausted_or_unmapped_sublimit' WHEN c_custkey % 7 = 0 THEN 'inconsistent_remaining'
    WHEN c_custkey % 11 = 0 THEN 'duplicate_window' END"""


@query("customer", sql=f"SELECT c_custkey AS id, CASE WHEN c_custkey % 17 = 0 THEN 'Nobody' ELSE 'Anthropic' END AS provider, {_ERROR} AS error FROM customer")
def snapshot_errors(cu: DataFrame) -> DataFrame:
    return snapshots.snapshot_errors(_rows(cu))


@query("customer", sql=f"SELECT c_custkey AS id, label, CASE label WHEN 'a' THEN c_custkey % 120 ELSE 0 END::DOUBLE AS used_percent, CASE label WHEN 'a' THEN 100 - c_custkey % 120 ELSE 100 END::DOUBLE AS remaining_percent FROM customer, (VALUES ('a'), ('b')) AS v(label) WHERE {_ERROR} IS NULL")
def snapshot_windows(cu: DataFrame) -> DataFrame:
    return snapshots.snapshot_windows(_rows(cu)).select("id", "label", "used_percent", "remaining_percent")


@query("customer", sql=f"SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'invalid_bundle' ELSE coalesce({_ERROR}, CASE WHEN c_custkey % 3 = 0 THEN 'duplicate_provider_or_pool' END) END AS error FROM customer")
def snapshot_bundles(cu: DataFrame) -> DataFrame:
    lost = F.concat(F.lit('{"observed_at_utc":"2026-05-04T11:00:00Z","reason":"r","source":"s","provider":"xAI","pool_alias":"'), F.when(c("id") % 3 == 0, "pool").otherwise("other"), F.lit('"}'))
    raw = F.concat(F.lit('{"schema_version":'), F.when(c("id") % 5 == 0, "2").otherwise("1"), F.lit(',"snapshot_id":"b","pools":['), "raw", F.lit('],"unavailable_pools":['), lost, F.lit("]}"))
    return snapshots.bundle_errors(_rows(cu).withColumn("raw", raw))


@query("customer", sql="SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'billing_invalid' END AS error, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 150 <= 100 THEN (c_custkey % 150)::DOUBLE END AS percent, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 2 = 0 THEN c_custkey END AS cap FROM customer")
def billing_facts(cu: DataFrame) -> DataFrame:
    config = F.concat(F.lit('{"creditUsagePercent":'), c(N) % 150, F.lit(',"onDemandCap":'), F.when(c(N) % 2 == 0, F.concat(F.lit('{"val":'), c(N), F.lit("}"))).otherwise("5"), F.lit("}"))
    raw = F.concat(F.lit('{"config":'), F.when(c(N) % 5 == 0, "[]").otherwise(config), F.lit("}"))
    return snapshots.billing_facts(cu.select(c(N).alias("id"), raw.alias("raw"))).select("id", "error", "percent", "cap")
