"""Quota snapshots: sound ones, and each rule broken in turn."""

import copy
import datetime
import json


from factloom.operators import snapshots

NOW = datetime.datetime(2026, 5, 4, 12, 0, 0)
BASE = {"snapshot_id": "s1", "source": "app", "runtime_version": "1", "billing_lane": "Some subscription", "pool_alias": "pool_a", "observed_at_utc": "2026-05-04T11:59:00Z"}
W = {"label": "session", "scope": "subscription shared session window", "kind": "subscription quota", "unit": "percent", "status": "observed", "used_percent": 40, "remaining_percent": 60, "duration_minutes": 300, "resets_at_utc": "2026-05-04T14:00:00+00:00"}
WINDOWS = BASE | {"provider": "Anthropic", "usage_credits_enabled": False, "windows": [W, W | {"label": "week", "scope": "subscription all models", "duration_minutes": None, "used_percent": 12.5, "remaining_percent": 87.5, "reset_text": "soon"}]}
SIDE = {"usedPercent": 10, "windowDurationMins": 300, "resetsAt": 1777903200}
BUCKET = BASE | {"provider": "OpenAI", "billing_lane": "Codex subscription", "codex_usage": {"ordinaryUsageAllowed": True, "rateLimits": {"limitId": "codex", "normalModelSlug": None, "individualLimit": None, "spendControlReached": False, "rateLimitReachedType": None, "primary": SIDE, "secondary": None, "credits": {"hasCredits": True, "balance": "12.50"}, "planType": "plus"}}}
WEEKLY = BASE | {"provider": "xAI", "billing_lane": "Grok Build subscription", "auth_method": "grok.com", "all_displayed_limits_recorded": True, "paid_allowance": {"status": "unavailable", "reason": "not shown"}, "windows": [W | {"label": "Weekly limit (SuperGrok)", "scope": "shared Grok Build subscription", "duration_minutes": 10080, "reset_text": "a", "reset_timezone": "UTC", "reset_precision": "minute", "percentage_precision": "whole", "reset_year_inferred": False}]}
LOCAL = BASE | {
    "provider": "LM Studio", "billing_lane": "Local Mac inference", "intended_mac_loopback_verified": True, "host": {"physical_memory_bytes": 1, "free_percent": 50.5, "memory_pressure_level": 1, "active_requests": 0, "slot_evidence": "x"},
    "local_model": {"key": "qwen3.8-flash-next", "type": "llm", "format": "gguf", "quantization": {"name": "IQ4_XS"}, "size_bytes": 5, "loaded_instances": [{"id": "one", "config": {"context_length": 9, "parallel": 1, "speculative_draft_mtp": False, "speculative_draft_simple": False, "speculative_draft_model": ""}}]},
}
SOUND = {"windows": WINDOWS, "bucket": BUCKET, "weekly": WEEKLY, "local": LOCAL}


def put(snapshot, path, value):
    out = at = copy.deepcopy(snapshot)
    *above, last = path.split(".")
    for k in above:
        at = at[int(k) if k.isdigit() else k]
    if value is ...:
        del at[int(last) if last.isdigit() else last]
    else:
        at[int(last) if last.isdigit() else last] = value
    return out


CASES = [
    ("windows", "source", " ", "invalid_snapshot"), ("windows", "pool_alias", "Bad Alias", "invalid_pool_alias"), ("windows", "billing_lane", "pay as you go", "unsupported_billing_lane"), ("windows", "observed_at_utc", "2026-05-04T11:59:00", "invalid_timestamp"),
    ("windows", "observed_at_utc", "2026-05-04T12:00:06Z", "stale_or_future_snapshot"), ("windows", "observed_at_utc", "2026-05-04T10:59:59Z", "stale_or_future_snapshot"), ("windows", "provider", "Nobody", "unsupported_provider"), ("windows", "usage_credits_enabled", "no", "unknown_credit_status"),
    ("windows", "windows", [], "missing_usage_windows"), ("windows", "windows.1.label", "session", "duplicate_window"), ("windows", "windows.0.scope", "", "invalid_window"), ("windows", "windows.0.unit", "tokens", "unsupported_window"), ("windows", "windows.0.status", "guess", "usage_unavailable"),
    ("windows", "windows.0.used_percent", "40", "usage_unavailable"), ("windows", "windows.0.used_percent", -1, "usage_unavailable"), ("windows", "windows.0.used_percent", 100, "quota_exhausted_or_unmapped_sublimit"), ("windows", "windows.0.resets_at_utc", "2026-05-04T11:00:00Z", "reset_requires_refresh"),
    ("windows", "windows.0.duration_minutes", 0, "invalid_duration"), ("windows", "windows.0.remaining_percent", 61, "inconsistent_remaining"), ("windows", "windows.1.reset_text", 5, "invalid_window_metadata"), ("windows", "windows.1.reset_year_inferred", "x", "invalid_window_metadata"), ("windows", "windows.1", ..., "missing_shared_window"),
    ("bucket", "billing_lane", "Other subscription", "unsupported_billing_lane"), ("bucket", "codex_usage", 5, "invalid_codex_usage"), ("bucket", "codex_usage.ordinaryUsageAllowed", False, "ordinary_usage_unavailable_or_blocked"), ("bucket", "codex_usage.rateLimitsByLimitId", {"codex": {}, "more": {}}, "unsupported_codex_bucket_scope"),
    ("bucket", "codex_usage.rateLimitsByLimitId", {"codex": {}}, "missing_codex_bucket"), ("bucket", "codex_usage.rateLimits.limitId", "x", "missing_codex_bucket"), ("bucket", "codex_usage.rateLimits.individualLimit", ..., "unsupported_codex_bucket_scope"), ("bucket", "codex_usage.rateLimits.spendControlReached", True, "spend_control_unavailable_or_blocked"),
    ("bucket", "codex_usage.rateLimits.rateLimitReachedType", "x", "rate_limit_unavailable_or_blocked"), ("bucket", "codex_usage.rateLimits.primary.resetsAt", 1.5, "invalid_timestamp"), ("bucket", "codex_usage.rateLimits.primary.usedPercent", 120, "quota_exhausted_or_unmapped_sublimit"), ("bucket", "codex_usage.rateLimits.secondary", [], "invalid_window"),
    ("bucket", "codex_usage.rateLimits.primary", None, "missing_usage_windows"), ("bucket", "codex_usage.rateLimits.credits.hasCredits", 1, "invalid_credits"), ("bucket", "codex_usage.rateLimits.credits.balance", "1e3", "invalid_credit_balance"), ("bucket", "codex_usage.rateLimits.planType", "Plus Plan", "invalid_plan_type"),
    ("weekly", "auth_method", "key", "unsupported_grok_auth"), ("weekly", "all_displayed_limits_recorded", 1, "incomplete_grok_usage"), ("weekly", "windows.0.duration_minutes", 60, "unsupported_grok_window_scope"), ("weekly", "windows.0.unit", "x", "usage_unavailable"), ("weekly", "windows.0.reset_timezone", ..., "invalid_window_metadata"),
    ("weekly", "paid_allowance.more", 1, "unsupported_grok_paid_allowance"), ("weekly", "paid_allowance", ..., "unsupported_grok_paid_allowance"), ("weekly", "windows.0.remaining_percent", 1, "inconsistent_remaining"),
    ("local", "intended_mac_loopback_verified", False, "unverified_local_endpoint"), ("local", "host.more", 1, "invalid_local_host"), ("local", "host.free_percent", 0, "invalid_local_memory"), ("local", "host.memory_pressure_level", 4, "local_pressure_unavailable_or_critical"), ("local", "host.active_requests", 2, "local_slot_unavailable"),
    ("local", "local_model.format", "x", "unsupported_local_model"), ("local", "local_model.quantization.name", "x", "unsupported_local_quantization"), ("local", "local_model.size_bytes", 0, "invalid_local_model_size"), ("local", "local_model.loaded_instances", [], "local_model_not_ready"),
    ("local", "local_model.loaded_instances.0.id", "Not An Id", "invalid_local_instance"), ("local", "local_model.loaded_instances.0.config.parallel", 2, "unsupported_local_runtime_capacity"), ("local", "local_model.loaded_instances.0.config.speculative_draft_mtp", True, "unqualified_local_draft"),
]


def rows(spark, values, max_age=3600):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v), NOW, max_age) for i, v in enumerate(values)], "id int, raw string, now timestamp, max_age int")


def test_each_rule(spark):
    cases = [(s, None) for s in SOUND.values()] + [(put(SOUND[n], p, v), e) for n, p, v, e in CASES] + [(None, "invalid_snapshot"), ("{", "invalid_snapshot"), ("[]", "invalid_snapshot")]
    got = {r.id: r.error for r in snapshots.snapshot_errors(rows(spark, [c for c, _ in cases])).collect()}
    assert {i: e for i, e in got.items() if e != cases[i][1]} == {}
    assert {r.error for r in snapshots.snapshot_errors(rows(spark, [WINDOWS], 0)).collect()} == {"invalid_max_age"}
    split = put(put(BUCKET, "codex_usage.rateLimitsByLimitId", {"codex": BUCKET["codex_usage"]["rateLimits"]}), "codex_usage.rateLimits", ...)
    assert snapshots.snapshot_errors(rows(spark, [split])).first().error is None


def test_windows_of_sound_snapshots(spark):
    got = [(r.id, r.label, r.used_percent, r.remaining_percent, r.duration_minutes) for r in snapshots.snapshot_windows(rows(spark, [*SOUND.values(), put(WINDOWS, "source", "")])).orderBy("id", "label").collect()]
    assert got == [(0, "session", 40.0, 60.0, 300), (0, "week", 12.5, 87.5, None), (1, "primary", 10.0, 90.0, 300), (2, "Weekly limit (SuperGrok)", 40.0, 60.0, 10080)]


def test_bundles(spark):
    lost = {"provider": "xAI", "pool_alias": "pool_x", "observed_at_utc": "2026-05-04T11:00:00Z", "source": "s", "reason": "r"}
    bundle = {"schema_version": 1, "snapshot_id": "b1", "pools": [WINDOWS, BUCKET | {"pool_alias": "pool_b"}], "unavailable_pools": [lost]}
    cases = [
        (bundle, None), (WINDOWS, None), (put(bundle, "schema_version", 2), "invalid_bundle"), (put(bundle, "pools", []), "invalid_bundle"), (bundle | {"more": 1}, "invalid_bundle"), (put(bundle, "pools.1.pool_alias", "pool_a"), "duplicate_provider_or_pool"),
        (put(bundle, "pools.1", WINDOWS | {"pool_alias": "pool_c"}), "duplicate_provider_or_pool"), (put(bundle, "pools.1.billing_lane", "x subscription"), "unsupported_billing_lane"), (put(bundle, "unavailable_pools.0.reason", ""), "invalid_unavailable_pool"),
        (put(bundle, "unavailable_pools.0.observed_at_utc", "2026-05-04T13:00:00Z"), "invalid_unavailable_pool"), (put(bundle, "unavailable_pools.0.provider", "Nobody"), "unsupported_provider"), (put(WINDOWS, "windows", []), "missing_usage_windows"),
    ]
    got = {r.id: r.error for r in snapshots.bundle_errors(rows(spark, [c for c, _ in cases])).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}


def test_billing(spark):
    whole = {"subscription_tier": "SuperGrok", "on_demand_enabled": True, "config": {"creditUsagePercent": 12.5, "isUnifiedBillingUser": False, "onDemandCap": {"val": 500}, "prepaidBalance": {"val": -1}, "currentPeriod": {"type": "USAGE_PERIOD_TYPE_WEEKLY", "start": "2026-05-01T00:00:00Z", "end": "2026-05-08T00:00:00Z"}}}
    wrong = {"subscription_tier": "Other", "on_demand_enabled": 1, "config": {"creditUsagePercent": 101, "currentPeriod": {"type": "USAGE_PERIOD_TYPE_WEEKLY", "start": "2026-05-09T00:00:00Z", "end": "2026-05-08T00:00:00Z"}}}
    got = snapshots.billing_facts(rows(spark, [whole, wrong, {"config": []}, None])).orderBy("id").collect()
    assert (got[0].tier, got[0].on_demand_enabled, got[0].percent, got[0].unified, got[0].cap, got[0].used, got[0].prepaid, got[0].period) == ("SuperGrok", True, 12.5, False, 500, None, None, "USAGE_PERIOD_TYPE_WEEKLY")
    assert [got[1][k] for k in ("error", "tier", "on_demand_enabled", "percent", "period", "start")] == [None] * 6
    assert got[2].error == got[3].error == "billing_invalid"




def test_rules_are_computed_once(spark):
    """A rule's inputs stand in the plan once, also where a filter follows: a row's time is that of one pass."""
    d = rows(spark, [WINDOWS])
    for q in (snapshots.snapshot_errors, snapshots.snapshot_windows, snapshots.bundle_errors):
        plan = q(d)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("resets_at_utc") < 40 and plan.count("remaining_percent") < 40
