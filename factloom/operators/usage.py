"""Usage and quota observations of providers: counters, windows, freshness and billing. Unknown stays null, with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Measurement -> places in the response by provider, the later ones first choice.
COUNTERS = {
    "metered": {
        "native_input_tokens": ("$.usage.input_tokens",), "native_output_tokens": ("$.usage.output_tokens",), "cached_input_tokens": ("$.usage.cache_read_input_tokens",),
        "cache_creation_input_tokens": ("$.usage.cache_creation_input_tokens",), "reasoning_tokens": ("$.usage.reasoning_tokens",), "provider_estimated_cost_usd": ("$.total_cost_usd",),
    },
    "local": {"native_input_tokens": ("$.stats.input_tokens",), "native_output_tokens": ("$.stats.total_output_tokens",), "reasoning_tokens": ("$.stats.reasoning_output_tokens",), "provider_ttft_seconds": ("$.stats.time_to_first_token_seconds",)},
    "native": {},
}
# End of fixed values.
NAMES = ("native_input_tokens", "native_output_tokens", "cached_input_tokens", "cache_creation_input_tokens", "reasoning_tokens", "provider_estimated_cost_usd", "provider_ttft_seconds")


def _counter(raw: Column, name: str, paths: tuple[str, ...]) -> Column:
    """struct(value, reason) of one measurement."""
    out = F.struct(F.lit(None).cast("double").alias("value"), F.lit("not exposed").alias("reason"))
    for p in paths:
        text = F.get_json_object(raw, p)
        value = text.try_cast("double")
        bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (value < 0)
        whole = F.lit(False) if not name.endswith("tokens") else value != F.floor(value)
        say = lambda v, r: F.struct(v.cast("double").alias("value"), F.lit(r).cast("string").alias("reason"))
        out = F.when(text.isNull(), out).when(bad, say(F.lit(None), f"invalid value at {p[2:]}")).when(whole, say(F.lit(None), f"noninteger count at {p[2:]}")).otherwise(say(value, None))
    return out


def extract_usage(rows: DataFrame, counters: dict = COUNTERS) -> DataFrame:
    """(id, measurement, value, reason) of ``rows(id, provider, raw)``: allow-listed counters of a JSON response.

    A counter that is missing, negative, not finite, or no whole number of tokens is null with the reason, never 0.
    An unknown provider raises.
    """
    known = F.when(F.col("provider").isin(*counters), F.col("provider")).otherwise(F.raise_error(F.concat(F.lit("unsupported provider: "), "provider")).cast("string"))
    none = F.struct(F.lit(None).cast("double").alias("value"), F.lit("not exposed").alias("reason"))
    each = []
    for name in NAMES:
        c = none
        for provider, table in counters.items():
            c = F.when(known == provider, _counter(F.col("raw"), name, table.get(name, ()))).otherwise(c)
        each.append(F.struct(F.lit(name).alias("measurement"), c.alias("m")))
    return rows.select("id", F.explode(F.array(*each)).alias("x")).select("id", "x.measurement", "x.m.value", "x.m.reason")


def zoned(text: Column) -> Column:
    """An ISO-8601 text with a zone as a timestamp, else null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"), t.try_cast("timestamp"))


def freshness_errors(rows: DataFrame) -> DataFrame:
    """(id, age_seconds, error) of ``rows(id, observed_at, now, max_age)``: an observation 5 s ahead at most, no older than max_age."""
    at = zoned(F.col("observed_at"))
    age = F.unix_micros("now") / 1e6 - F.unix_micros(at) / 1e6
    error = F.when(~F.coalesce(F.col("max_age").between(1, 3600), F.lit(False)), "invalid_max_age").when(at.isNull(), "invalid_timestamp").when(~age.between(-5, F.col("max_age")), "stale_or_future_snapshot")
    return rows.select("id", F.when(error.isNull(), F.greatest(F.lit(0), F.rint(age).cast("bigint"))).alias("age_seconds"), error.alias("error"))


def window_errors(windows: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """(snapshot, error): the first rule that a snapshot's ``windows(snapshot, label, scope, kind, unit, status, used, remaining)`` break.

    Labels are unique, all are observed percents of a subscription quota, what is said to remain agrees with what is
    used to 0.001, and every ``required`` scope is there. Sound snapshots have no row.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    left = F.greatest(F.lit(0.0), 100 - F.col("used"))
    rule = (
        F.when(blank("label") | blank("scope"), 1).when(~F.coalesce((F.col("kind") == "subscription quota") & (F.col("unit") == "percent"), F.lit(False)), 3).when(~F.coalesce(F.col("status") == "observed", F.lit(False)), 4)
        .when(~F.coalesce(F.col("used") >= 0, F.lit(False)), 4).when(left <= 0, 5).when(~F.coalesce(F.col("remaining").between(0, 100) & (F.abs(F.col("remaining") - left) <= 0.001), F.lit(False)), 6)
    )
    there = F.collect_set("scope")
    g = windows.withColumn("rule", rule).groupBy("snapshot").agg(F.min("rule").alias("rule"), (F.count(F.lit(1)) > F.count_distinct("label")).alias("twice"), there.alias("scopes"))
    lacks = F.size(F.array_except(F.array(*map(F.lit, required)), "scopes")) > 0 if required else F.lit(False)
    names = {1: "invalid_window", 3: "unsupported_window", 4: "usage_unavailable", 5: "quota_exhausted_or_unmapped_sublimit", 6: "inconsistent_remaining"}
    error = F.when(lacks, "missing_shared_window")
    for k, v in reversed(names.items()):
        error = F.when(F.col("rule") == k, v).otherwise(error)
    error = F.when((F.col("rule") == 1), "invalid_window").when(F.col("twice"), "duplicate_window").otherwise(error)
    return g.select("snapshot", error.alias("error")).where("error is not null")


def pool_errors(pools: DataFrame, most: int = 4) -> DataFrame:
    """(snapshot, error) of ``pools(snapshot, provider, pool_alias)``: too many pools, or a provider or alias twice."""
    g = pools.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("provider").alias("p"), F.count_distinct("pool_alias").alias("a"))
    return g.select("snapshot", F.when(F.col("n") > most, "invalid_bundle").when((F.col("p") < F.col("n")) | (F.col("a") < F.col("n")), "duplicate_provider_or_pool").alias("error")).where("error is not null")


def billing_status(rows: DataFrame) -> DataFrame:
    """(id, status) of ``rows(id, raw, now)``: ready, exhausted, or unknown outside the period or without percent.

    Only typed facts count: a percent from 0 to 100, and a period whose two zoned ends are in order.
    """
    j = lambda p: F.get_json_object("raw", p)
    percent = j("$.config.creditUsagePercent").try_cast("double")
    a, b = zoned(j("$.config.currentPeriod.start")), zoned(j("$.config.currentPeriod.end"))
    inside = F.coalesce((a < b) & (a <= F.col("now")) & (F.col("now") < b) & percent.between(0, 100), F.lit(False))
    return rows.select("id", F.when(~inside, "unknown").when(percent == 100, "exhausted").otherwise("ready").alias("status"))


def host_errors(hosts: DataFrame) -> DataFrame:
    """(id, error) of ``hosts(id, memory_bytes, free_percent, pressure, active, instances, parallel)``: a local machine that may take work has none."""
    ok = lambda c: ~F.coalesce(c, F.lit(False))
    error = (
        F.when(ok(F.col("memory_bytes") > 0) | ok((F.col("free_percent") > 0) & (F.col("free_percent") <= 100)), "invalid_local_memory").when(ok(F.col("pressure").isin(1, 2)), "local_pressure_unavailable_or_critical")
        .when(ok(F.col("active").between(0, 1)), "local_slot_unavailable").when(ok(F.col("instances") == 1), "local_model_not_ready").when(ok(F.col("parallel") == 1), "unsupported_local_runtime_capacity")
    )
    return hosts.select("id", error.alias("error"))
