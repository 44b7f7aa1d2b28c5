"""Quota snapshots of providers, each in its own JSON shape: the first rule that one breaks, and its windows if it is sound."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.codes import is_identifier, is_model_identifier
from factloom.operators.usage import zoned
from factloom.plans.stages import computed, spread

# Providers with the shape of their snapshots, billing lanes, scopes and texts that a snapshot must have.
SHAPES = {"LM Studio": "local", "Anthropic": "windows", "xAI": "weekly", "OpenAI": "bucket"}
LANES = {"local": "Local Mac inference", "weekly": "Grok Build subscription", "bucket": "Codex subscription"}
SHARED_SCOPES = ("subscription shared session window", "subscription all models")
WEEKLY = {"label": "Weekly limit (SuperGrok)", "scope": "shared Grok Build subscription", "duration_minutes": 10080}
WEEKLY_AUTH, BUCKET = "grok.com", "codex"
LOCAL_MODEL = {"key": "qwen3.8-flash-next", "type": "llm", "format": "gguf"}
LOCAL_QUANTIZATION = "IQ4_XS"
METADATA = ("model_mapping", "reset_text", "reset_precision", "percentage_precision")
WEEKLY_METADATA = ("reset_text", "reset_timezone", "reset_precision", "percentage_precision")
# End of fixed values.

Rules = list[tuple[str | Column, Column]]


class Json:
    """A variant's members by path: whether they have a kind, and their values (null if they have another)."""

    def __init__(self, v: Column):
        self.v = v

    def at(self, path: str) -> Column:
        return F.try_variant_get(self.v, f"$.{path}", "variant")

    def kind(self, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(self.at(path)), F.lit(""))

    def has(self, path: str) -> Column:
        return self.at(path).isNotNull()

    def null(self, path: str) -> Column:
        """There is none, or it is a JSON null."""
        return self.kind(path).isin("", "VOID")

    def is_object(self, path: str) -> Column:
        return self.kind(path).startswith("OBJECT")

    def text(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", F.try_variant_get(self.v, f"$.{path}", "string"))

    def filled(self, path: str) -> Column:
        return _sure(F.trim(self.text(path)) != "")

    def number(self, path: str) -> Column:
        return F.when(self.kind(path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(self.v, f"$.{path}", "double"))

    def whole(self, path: str) -> Column:
        return F.when(self.kind(path) == "BIGINT", F.try_variant_get(self.v, f"$.{path}", "bigint"))

    def flag(self, path: str) -> Column:
        return F.when(self.kind(path) == "BOOLEAN", F.try_variant_get(self.v, f"$.{path}", "boolean"))

    def array(self, path: str) -> Column:
        return F.when(self.kind(path).startswith("ARRAY"), F.try_variant_get(self.v, f"$.{path}", "array<variant>"))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _first(rules: Rules) -> Column:
    """The name of the first rule that doesn't hold, else null."""
    return reduce(lambda out, rule: F.when(~_sure(rule[1]), rule[0]).otherwise(out), reversed(rules), F.lit(None).cast("string"))


def _percent(used: Column, reset: Column, duration: Column, no_duration: Column, now: Column, observed: Column) -> Rules:
    return [
        ("usage_unavailable", (used >= 0) & (used < float("inf"))), ("quota_exhausted_or_unmapped_sublimit", used < 100),
        ("reset_requires_refresh", (reset > now) & (reset > observed)), ("invalid_duration", no_duration | (duration > 0)),
    ]


def _context(j: Json, shape: str, now: Column, observed: Column, age: Column) -> Rules:
    seconds = F.unix_micros(now) / 1e6 - F.unix_micros(observed) / 1e6
    lane = j.text("billing_lane") == LANES["local"] if shape == "local" else F.lower(j.text("billing_lane")).contains("subscription")
    named = reduce(lambda a, b: a & b, [j.filled(k) for k in ("snapshot_id", "source", "runtime_version", "billing_lane", "pool_alias")])
    return [("invalid_snapshot", named), ("invalid_pool_alias", is_identifier(j.text("pool_alias"))), ("unsupported_billing_lane", lane), ("invalid_max_age", age.between(1, 3600)), ("invalid_timestamp", observed.isNotNull()), ("stale_or_future_snapshot", seconds.between(-5, age))]


def _stated(used: Column, remaining: Column) -> Rules:
    left = F.greatest(F.lit(0.0), 100 - used)
    return [("inconsistent_remaining", remaining.between(0, 100) & (F.abs(remaining - left) <= 0.001))]


def _fields(w: Column) -> Column:
    """What the rules ask of a window, each member read once."""
    j = Json(w)
    metadata = reduce(lambda a, b: a & b, [~j.has(k) | j.filled(k) for k in METADATA] + [~j.has(k) | j.flag(k).isNotNull() for k in ("reset_date_inferred", "reset_year_inferred")])
    told = {"kind": j.text("kind"), "unit": j.text("unit"), "status": j.text("status"), "used": j.number("used_percent"), "remaining": j.number("remaining_percent"), "reset": zoned(j.text("resets_at_utc")), "duration": j.whole("duration_minutes"), "no_duration": j.null("duration_minutes")}
    return F.struct(j.text("label").alias("label"), j.text("scope").alias("scope"), *[v.alias(k) for k, v in told.items()], metadata.alias("metadata"))


def _window(w: Column, now: Column, observed: Column) -> Rules:
    return [
        ("unsupported_window", (w["kind"] == "subscription quota") & (w["unit"] == "percent")), ("usage_unavailable", w["status"] == "observed"), ("invalid_timestamp", w["reset"].isNotNull()),
        *_percent(w["used"], w["reset"], w["duration"], w["no_duration"], now, observed), *_stated(w["used"], w["remaining"]), ("invalid_window_metadata", w["metadata"]),
    ]


def _window_error(fields: Column, now: Column, observed: Column) -> Column:
    """The first rule that the first unsound window breaks, else null."""
    labels = fields["label"]
    filled = lambda x: _sure(F.trim(x) != "")
    told = lambda w, i: _first([("invalid_window", filled(w["label"]) & filled(w["scope"])), ("duplicate_window", ~_sure(F.array_position(labels, w["label"]) <= i)), *_window(w, now, observed)])
    return F.get(F.filter(F.transform(fields, told), lambda e: e.isNotNull()), F.lit(0))


def _windows(j: Json, now: Column, observed: Column) -> Rules:
    """Upon ``fields`` and ``window_error``, which ``_judged`` computes before."""
    fields, error = F.col("fields"), F.col("window_error")
    return [
        ("unknown_credit_status", j.flag("usage_credits_enabled").isNotNull()), ("missing_usage_windows", F.size(fields) > 0), (error, error.isNull()),
        ("missing_shared_window", F.size(F.array_except(F.array(*map(F.lit, SHARED_SCOPES)), fields["scope"])) == 0),
    ]


def _bucket_of(j: Json) -> Json:
    split = ~j.null("codex_usage.rateLimitsByLimitId")
    return Json(F.when(split, j.at(f"codex_usage.rateLimitsByLimitId.{BUCKET}")).otherwise(j.at("codex_usage.rateLimits")))


def _epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(F.when(seconds.between(1, 253_402_300_799), seconds))


def _bucket(j: Json, now: Column, observed: Column) -> Rules:
    b = _bucket_of(j)
    split = ~j.null("codex_usage.rateLimitsByLimitId")
    only = F.json_object_keys(F.to_json(j.at("codex_usage.rateLimitsByLimitId"))) == F.array(F.lit(BUCKET))
    rules: Rules = [
        ("unsupported_billing_lane", j.text("billing_lane") == LANES["bucket"]), ("invalid_codex_usage", j.is_object("codex_usage")), ("ordinary_usage_unavailable_or_blocked", j.flag("codex_usage.ordinaryUsageAllowed")),
        ("unsupported_codex_bucket_scope", ~split | (j.is_object("codex_usage.rateLimitsByLimitId") & only)), ("missing_codex_bucket", b.text("limitId") == BUCKET),
        ("unsupported_codex_bucket_scope", (b.kind("normalModelSlug") == "VOID") & (b.kind("individualLimit") == "VOID")), ("spend_control_unavailable_or_blocked", ~b.flag("spendControlReached")), ("rate_limit_unavailable_or_blocked", b.kind("rateLimitReachedType") == "VOID"),
    ]
    for name in ("primary", "secondary"):
        reset, absent = _epoch(b.whole(f"{name}.resetsAt")), b.null(name)
        own = [("invalid_window", b.is_object(name)), ("invalid_timestamp", reset.isNotNull()), *_percent(b.number(f"{name}.usedPercent"), reset, b.whole(f"{name}.windowDurationMins"), b.null(f"{name}.windowDurationMins"), now, observed)]
        rules += [(n, absent | _sure(c)) for n, c in own]
    either = lambda k: b.null(f"credits.{k}") | b.flag(f"credits.{k}").isNotNull()
    return [
        *rules, ("missing_usage_windows", ~b.null("primary") | ~b.null("secondary")), ("invalid_credits", b.null("credits") | b.is_object("credits")), ("invalid_credits", either("hasCredits") & either("unlimited")),
        ("invalid_credit_balance", b.null("credits.balance") | b.text("credits.balance").rlike(r"^[0-9]+(\.[0-9]+)?$")), ("invalid_plan_type", b.null("planType") | is_identifier(b.text("planType"))),
    ]


def _weekly(j: Json, now: Column, observed: Column) -> Rules:
    windows = j.array("windows")
    w = Json(F.get(windows, F.lit(0)))
    reset = zoned(w.text("resets_at_utc"))
    one = (F.size(windows) == 1) & (w.text("label") == WEEKLY["label"]) & (w.text("scope") == WEEKLY["scope"]) & (w.number("duration_minutes") == WEEKLY["duration_minutes"])
    seen = (w.text("kind") == "subscription quota") & (w.text("unit") == "percent") & (w.text("status") == "observed")
    metadata = reduce(lambda a, b: a & b, [w.filled(k) for k in WEEKLY_METADATA])
    paid = F.array_sort(F.json_object_keys(F.to_json(j.at("paid_allowance")))) == F.array(F.lit("reason"), F.lit("status"))
    return [
        ("unsupported_billing_lane", j.text("billing_lane") == LANES["weekly"]), ("unsupported_grok_auth", j.text("auth_method") == WEEKLY_AUTH), ("incomplete_grok_usage", j.flag("all_displayed_limits_recorded")), ("unsupported_grok_window_scope", one), ("usage_unavailable", seen),
        ("invalid_timestamp", reset.isNotNull()), *_percent(w.number("used_percent"), reset, w.whole("duration_minutes"), F.lit(False), now, observed), *_stated(w.number("used_percent"), w.number("remaining_percent")), ("invalid_window_metadata", metadata & w.flag("reset_year_inferred").isNotNull()),
        ("unsupported_grok_paid_allowance", j.is_object("paid_allowance") & paid & (j.text("paid_allowance.status") == "unavailable") & j.filled("paid_allowance.reason")),
    ]


def _local(j: Json, now: Column, observed: Column) -> Rules:
    host = F.array_sort(F.json_object_keys(F.to_json(j.at("host")))) == F.array(*map(F.lit, ("active_requests", "free_percent", "memory_pressure_level", "physical_memory_bytes", "slot_evidence")))
    model = reduce(lambda a, b: a & b, [j.text(f"local_model.{k}") == v for k, v in LOCAL_MODEL.items()])
    instances = j.array("local_model.loaded_instances")
    i = Json(F.get(instances, F.lit(0)))
    return [
        ("unverified_local_endpoint", j.flag("intended_mac_loopback_verified")), ("invalid_local_host", j.is_object("host") & host), ("invalid_local_memory", (j.whole("host.physical_memory_bytes") > 0) & (j.number("host.free_percent") > 0) & (j.number("host.free_percent") <= 100)),
        ("local_pressure_unavailable_or_critical", j.whole("host.memory_pressure_level").isin(1, 2)), ("local_slot_unavailable", j.whole("host.active_requests").between(0, 1) & j.filled("host.slot_evidence")), ("unsupported_local_model", model),
        ("unsupported_local_quantization", j.text("local_model.quantization.name") == LOCAL_QUANTIZATION), ("invalid_local_model_size", j.whole("local_model.size_bytes") > 0), ("local_model_not_ready", F.size(instances) == 1),
        ("invalid_local_instance", is_model_identifier(i.text("id"))), ("unsupported_local_runtime_capacity", (i.whole("config.context_length") > 0) & (i.whole("config.parallel") == 1)),
        ("unqualified_local_draft", ~i.flag("config.speculative_draft_mtp") & ~i.flag("config.speculative_draft_simple") & (i.text("config.speculative_draft_model") == "")),
    ]


RULES: dict[str, Callable[[Json, Column, Column], Rules]] = {"windows": _windows, "bucket": _bucket, "weekly": _weekly, "local": _local}


def _judged(rows: DataFrame) -> DataFrame:
    """``rows`` with their variant ``v``, ``provider`` and ``error``. What several rules ask for is computed once, in steps."""
    d = computed(spread(rows), v=F.try_parse_json("raw"))
    j, now = Json(F.col("v")), F.col("now")
    d = computed(d, is_object=_sure(F.schema_of_variant("v").startswith("OBJECT")), provider=j.text("provider"), observed=zoned(j.text("observed_at_utc")))
    provider, observed = F.col("provider"), F.col("observed")
    listed = provider.isin(*[n for n, s in SHAPES.items() if s == "windows"])
    d = computed(d, fields=F.when(listed, F.transform(j.array("windows"), _fields)))
    d = computed(d, window_error=_window_error(F.col("fields"), now, observed))
    error = F.lit("unsupported_provider")
    for name, shape in SHAPES.items():
        error = F.when(provider == name, _first([*_context(j, shape, now, observed, F.col("max_age")), *RULES[shape](j, now, observed)])).otherwise(error)
    return computed(d, error=F.when(~F.col("is_object"), "invalid_snapshot").otherwise(error))


def snapshot_errors(rows: DataFrame) -> DataFrame:
    """(id, provider, error) of ``rows(id, raw, now, max_age)``: the first rule that each snapshot breaks, null for a sound one.

    ``raw`` is JSON. Rules common to all providers come first, then those of its shape. No JSON object: invalid_snapshot.
    """
    return _judged(rows).select("id", "provider", "error")


def snapshot_windows(rows: DataFrame) -> DataFrame:
    """(id, label, scope, used_percent, remaining_percent, duration_minutes, resets_at): the windows of sound snapshots."""
    sound = _judged(rows).where("error is null")
    j = Json(F.col("v"))
    row = lambda label, scope, used, duration, reset: F.struct(label.alias("label"), scope.alias("scope"), used.alias("used_percent"), F.greatest(F.lit(0.0), 100 - used).alias("remaining_percent"), duration.alias("duration_minutes"), reset.alias("resets_at"))
    listed = F.transform(j.array("windows"), lambda w: row(Json(w).text("label"), Json(w).text("scope"), Json(w).number("used_percent"), Json(w).whole("duration_minutes"), zoned(Json(w).text("resets_at_utc"))))
    b = _bucket_of(j)
    own = F.array_compact(F.array(*[F.when(~b.null(k), row(F.lit(k), F.lit("shared Codex account bucket"), b.number(f"{k}.usedPercent"), b.whole(f"{k}.windowDurationMins"), _epoch(b.whole(f"{k}.resetsAt")))) for k in ("primary", "secondary")]))
    shape = {n: own if s == "bucket" else listed for n, s in SHAPES.items() if s != "local"}
    windows = reduce(lambda out, n: F.when(F.col("provider") == n, shape[n]).otherwise(out), shape, F.lit(None))
    return sound.select("id", F.explode(windows).alias("w")).select("id", "w.*")


def bundle_errors(rows: DataFrame) -> DataFrame:
    """(id, error) of ``rows(id, raw, now, max_age)``: bundles of one snapshot for each provider, and of pools without one.

    The first rule that a bundle breaks: its own shape, its snapshots in order, its unavailable pools, providers or
    aliases that come twice. A single snapshot is judged by ``snapshot_errors``.
    """
    d = computed(spread(rows), v=F.try_parse_json("raw"))
    j = Json(F.col("v"))
    d = computed(d, many=_sure(j.has("pools")), pools=j.array("pools"), gone=j.array("unavailable_pools"))
    many, pools, gone = F.col("many"), F.col("pools"), F.col("gone")
    keys = F.array_sort(F.json_object_keys(F.to_json("v"))) == F.array(*map(F.lit, ("pools", "schema_version", "snapshot_id", "unavailable_pools")))
    shaped = keys & (j.whole("schema_version") == 1) & is_identifier(j.text("snapshot_id")) & (F.size(pools) > 0) & gone.isNotNull() & (F.size(pools) + F.size(gone) <= 4)
    fields = ("observed_at_utc", "pool_alias", "provider", "reason", "source")

    def lost(x: Column) -> Column:
        u, at = Json(x), zoned(Json(x).text("observed_at_utc"))
        same = F.array_sort(F.json_object_keys(F.to_json(x))) == F.array(*map(F.lit, fields))
        return _first([("invalid_unavailable_pool", same & u.filled("source") & u.filled("reason")), ("invalid_timestamp", at.isNotNull()), ("invalid_unavailable_pool", F.unix_micros("now") - F.unix_micros(at) >= -5_000_000)])

    of = lambda k: F.transform(F.concat(pools, gone), lambda x: Json(x).text(k))
    d = computed(d, names=of("provider"), aliases=of("pool_alias"), lost_errors=F.transform(gone, lost), shape=F.when(~many | _sure(shaped), None).otherwise("invalid_bundle"))
    names, aliases = F.col("names"), F.col("aliases")
    once = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    after = _first([("unsupported_provider", F.forall(names, lambda n: _sure(n.isin(*SHAPES)))), ("invalid_pool_alias", F.forall(aliases, lambda a: _sure(is_identifier(a)))), ("duplicate_provider_or_pool", once(names) & once(aliases))])
    lost_error = F.get(F.filter("lost_errors", lambda e: e.isNotNull()), F.lit(0))
    judged = d.select("id", "now", "max_age", "shape", F.when(many, lost_error).alias("lost"), F.when(many, after).alias("after"), F.when(many, F.transform(pools, lambda x: F.to_json(x))).otherwise(F.array("raw")).alias("pools"))
    each = judged.where("shape is null").select(F.col("id").alias("bundle"), "now", "max_age", F.posexplode("pools").alias("place", "raw")).withColumn("id", F.struct("bundle", "place"))
    bad = snapshot_errors(each).where("error is not null").groupBy(F.col("id.bundle").alias("id")).agg(F.min_by("error", "id.place").alias("own"))
    return judged.join(bad, "id", "left").select("id", F.coalesce("shape", "own", "lost", "after").alias("error"))


def billing_facts(rows: DataFrame) -> DataFrame:
    """(id, error, tier, on_demand_enabled, percent, unified, cap, used, prepaid, period, start, stop) of ``rows(id, raw)``.

    Only typed facts of an account's billing stay; what is absent or of another type is null. Amounts are cents.
    """
    d = rows.withColumn("v", F.try_parse_json("raw"))
    j = Json(F.col("v"))
    percent = j.number("config.creditUsagePercent")
    cents = lambda k: F.when(j.whole(f"config.{k}.val") >= 0, j.whole(f"config.{k}.val"))
    a, b, kind = zoned(j.text("config.currentPeriod.start")), zoned(j.text("config.currentPeriod.end")), j.text("config.currentPeriod.type")
    ok = _sure(kind.isin("USAGE_PERIOD_TYPE_WEEKLY", "USAGE_PERIOD_TYPE_MONTHLY") & (a < b))
    tier = j.text("subscription_tier")
    return d.select(
        "id", F.when(~j.is_object("config"), "billing_invalid").alias("error"), F.when(tier.isin("SuperGrok", "SuperGrok Heavy"), tier).alias("tier"), j.flag("on_demand_enabled").alias("on_demand_enabled"), F.when(percent.between(0, 100), percent).alias("percent"),
        j.flag("config.isUnifiedBillingUser").alias("unified"), cents("onDemandCap").alias("cap"), cents("onDemandUsed").alias("used"), cents("prepaidBalance").alias("prepaid"), F.when(ok, kind).alias("period"), F.when(ok, a).alias("start"), F.when(ok, b).alias("stop"),
    )
