"""Event journals: transitions, durations and reports; the advice ledger; judgments and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = ("prepare", "dispatch", "finish", "check_start", "check_end")


def duration(a: Column, b: Column) -> Column:
    """Seconds between two stamps (monotonic, clock_origin) to 6 digits; null across clocks (over 2 s) or backwards."""
    value = b["monotonic"] - a["monotonic"]
    return F.when((F.abs(a["clock_origin"] - b["clock_origin"]) <= 2) & (value >= 0), F.round(value, 6))


def judged(events: DataFrame) -> DataFrame:
    """(attempt, sequence, kind, accepted): a step is accepted if it is the n-th of its attempt and of STEPS, as were all before it."""
    place = F.array_position(F.array(*map(F.lit, STEPS)), F.col("kind"))
    w = Window.partitionBy("attempt").orderBy("sequence")
    d = events.where(F.col("kind").isin(*STEPS)).withColumn("n", F.row_number().over(w))
    bad = F.max((place != F.col("n")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("bad", bad).select("attempt", "sequence", "kind", (F.col("bad") == 0).alias("accepted"))


def invalid_transitions(events: DataFrame) -> DataFrame:
    """(attempt, sequence, kind): steps that don't follow exactly the steps before them in their attempt."""
    return judged(events).where("not accepted").drop("accepted")


def report(events: DataFrame) -> DataFrame:
    """A row for each attempt: the last event of each step and the durations between them. Missing steps give nulls."""
    stamp = F.struct("sequence", "monotonic", "clock_origin")
    p = events.where(F.col("kind").isin(*STEPS)).groupBy("attempt").agg(*[F.max(F.when(F.col("kind") == k, stamp)).alias(k) for k in STEPS])
    out = p.where("prepare is not null").select(
        "attempt", duration(F.col("prepare"), F.col("dispatch")).alias("pre_dispatch_queue_seconds"), duration(F.col("dispatch"), F.col("finish")).alias("process_seconds"),
        duration(F.col("check_start"), F.col("check_end")).alias("verification_seconds"), duration(F.col("prepare"), F.col("check_end")).alias("attempt_through_verification_seconds"),
        F.when(F.col("finish").isNull(), "pending").otherwise("observed").alias("transport_status"),
    )
    return out


def latest_assessment(events: DataFrame) -> DataFrame:
    """(attempt, sequence, kind): the last check or correction of each attempt."""
    a = events.where(F.col("kind").isin("check_end", "check_correction"))
    return a.groupBy("attempt").agg(F.max(F.struct("sequence", "kind")).alias("x")).select("attempt", "x.sequence", "x.kind")


def request_errors(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """(work_item_id, error) of advice requests against the ledger; null where the request is valid."""
    hash_ = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    d = requests.join(ledger, "work_item_id", "left")
    row = F.col("requests_used").isNotNull()
    used = F.coalesce("requests_used", F.lit(0))
    basis_bad = ~F.coalesce((F.col("previous_state_sha256") == F.col("last_state_sha256")) & (F.trim("change_reason") != ""), F.lit(False)) | ~hash_("previous_state_sha256")
    error = (
        F.when(row & ~(F.col("requests_used").isin(1, 2) & hash_("last_state_sha256")), "invalid_advice_ledger").when(F.col("expected_used") != used, "advice_ledger_count_mismatch")
        .when((F.col("expected_used") == 0) & (F.col("previous_state_sha256").isNotNull() | F.col("change_reason").isNotNull()), "invalid_initial_advice_basis")
        .when((F.col("expected_used") != 0) & basis_bad, "advice_ledger_state_mismatch")
        .when(~hash_("state_hash") | (row & F.coalesce(F.col("state_hash") == F.col("last_state_sha256"), F.lit(False))), "unchanged_advice_state").when(used >= 2, "advice_budget_exhausted")
    )
    return d.select("work_item_id", error.alias("error"))


def ledger_snapshot(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """State of the given work items; one without a row has used nothing."""
    return keys.select("work_item_id").distinct().join(ledger, "work_item_id", "left").select("work_item_id", F.coalesce("requests_used", F.lit(0)).alias("requests_used"), "last_state_sha256")


def distribution_errors(rows: DataFrame) -> DataFrame:
    """``rows(id, choice, options array, probabilities map, confidence)`` with the first rule that each breaks, else null."""
    p = F.map_values("probabilities")
    ok = lambda c: F.coalesce(c, F.lit(False))
    error = (
        F.when(~ok(F.array_contains("options", F.col("choice"))), "unknown_choice").when(F.col("probabilities").isNull(), "invalid_distribution_type")
        .when(F.array_sort(F.map_keys("probabilities")) != F.array_sort("options"), "invalid_distribution_keys").when(~F.forall(p, lambda x: ok(x.between(0, 1) & ~F.isnan(x))), "invalid_distribution_value")
        .when(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) > 0.001, "invalid_distribution_sum").when(~ok(F.element_at("probabilities", F.col("choice")) >= F.array_max(p) - 1e-6), "inconsistent_choice")
        .when(~ok(F.col("confidence").between(0, 1)), "invalid_confidence")
    )
    return rows.select("id", error.alias("error"))


def capacity_errors(assigned: DataFrame, active: DataFrame, limits: DataFrame) -> DataFrame:
    """Pools whose active and newly assigned tasks exceed their limit: (pool, used, most)."""
    n = assigned.select("pool").unionByName(active.select("pool")).groupBy("pool").agg(F.count(F.lit(1)).alias("used"))
    return n.join(limits, "pool").where("used > most").select("pool", "used", "most")


def qualified(judgments: DataFrame, threshold: float) -> DataFrame:
    """(task, model, qualified): whether every criterion reached the threshold."""
    return judgments.groupBy("task", "model").agg(F.bool_and(F.coalesce(F.col("probability") >= threshold, F.lit(False))).alias("qualified"))


def outcomes(judgments: DataFrame, threshold: float) -> DataFrame:
    """(task, model, criterion, probability, reached): each judgment with whether it reached the threshold."""
    return judgments.select("task", "model", "criterion", "probability", F.coalesce(F.col("probability") >= threshold, F.lit(False)).alias("reached"))


def dispatch_errors(attempts: DataFrame, manifests: DataFrame, packets: DataFrame) -> DataFrame:
    """(attempt, error) of ``attempts(attempt, run, packet, manifest_sha256, packet_sha256)`` that may not be dispatched.

    ``manifests(run, sha256)`` and ``packets(packet, sha256, is_link)`` are what is there now: a frozen manifest or a
    prepared packet that changed or is gone refuses, and so does a packet that is a link.
    """
    m, p = manifests.select("run", F.col("sha256").alias("m_now")), packets.select("packet", F.col("sha256").alias("p_now"), "is_link")
    d = attempts.join(m, "run", "left").join(p, "packet", "left")
    error = F.when(~F.col("m_now").eqNullSafe(F.col("manifest_sha256")), "manifest_changed").when(F.col("p_now").isNull() | F.coalesce("is_link", F.lit(True)), "packet_not_regular").when(F.col("p_now") != F.col("packet_sha256"), "packet_changed")
    return d.select("attempt", error.alias("error")).where("error is not null")


def assign(candidates: DataFrame, most: int) -> DataFrame:
    """(pool, task, model): tasks in their order take the first preferred model, ``most`` in each pool.

    With one candidate model for each task and pool it is a rank, so no task holds more than a pool's rows.
    """
    first = candidates.groupBy("pool", "task").agg(F.min(F.struct("preference", "model"))["model"].alias("model"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("pool").orderBy("task"))).where(F.col("n") <= most).drop("n")


def quota_windows(rows: DataFrame) -> DataFrame:
    """Usage windows with what remains and the first rule they break: (id, remaining_percent, error)."""
    left = F.greatest(F.lit(0.0), 100 - F.col("used_percent"))
    error = (
        F.when(F.col("used_percent").isNull() | F.isnan("used_percent") | (F.col("used_percent") < 0), "usage_unavailable").when(left <= 0, "quota_exhausted_or_unmapped_sublimit")
        .when(~((F.col("resets_at") > F.col("now")) & (F.col("resets_at") > F.col("observed_at"))), "reset_requires_refresh").when(F.col("duration_minutes") <= 0, "invalid_duration")
    )
    return rows.select("id", F.when(error.isNull(), left).alias("remaining_percent"), error.alias("error"))


def correction_errors(events: DataFrame) -> DataFrame:
    """(attempt, sequence, error) of corrections: ``events`` with supersedes, reason, accepted and status; null where valid.

    A correction must name the attempt's latest assessment before it, give a reason, and can't accept a transport that
    didn't complete.
    """
    w = Window.partitionBy("attempt").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.last(F.when(F.col("kind").isin("check_end", "check_correction"), F.col("sequence")), ignorenulls=True).over(w)
    ended = F.first(F.when(F.col("kind") == "finish", F.col("status")), ignorenulls=True).over(w)
    d = events.withColumn("latest", latest).withColumn("ended", ended).where("kind = 'check_correction'")
    error = (
        F.when(F.col("accepted").isNull(), "boolean_acceptance_required").when(F.col("supersedes").isNull() | (F.coalesce(F.trim("reason"), F.lit("")) == ""), "sequence_and_reason_required")
        .when(F.col("latest").isNull() | (F.col("latest") != F.col("supersedes")), "must_supersede_latest").when(F.col("accepted") & ~F.coalesce(F.col("ended") == "completed", F.lit(False)), "failed_transport")
    )
    return d.select("attempt", "sequence", error.alias("error"))


def run_summary(events: DataFrame) -> DataFrame:
    """One row: assigned, attempted, accepted, failed_transport, pending, unverified, and whether the run may close as complete.

    ``events(attempt, sequence, kind, status, accepted)``; the last of a kind counts, corrections over checks.
    """
    last = lambda k, c: F.max_by(F.when(F.col("kind") == k, F.struct(F.col(c).alias("v"))), F.when(F.col("kind") == k, F.col("sequence")))
    a = events.where("attempt is not null").groupBy("attempt").agg(F.bool_or(F.col("kind") == "prepare").alias("prepared"), F.count_if(F.col("kind") == "dispatch").alias("dispatches"), last("finish", "status").alias("done"), last("check_end", "accepted").alias("checked"), last("check_correction", "accepted").alias("corrected"))
    a = a.withColumn("verdict", F.coalesce("corrected", "checked")["v"]).withColumn("transport", F.when(F.col("done").isNull(), "pending").otherwise(F.col("done")["v"]))
    p = F.col("prepared")
    out = a.agg(
        F.count_if(p).alias("assigned"), F.coalesce(F.sum("dispatches"), F.lit(0)).alias("attempted"), F.count_if(p & F.col("verdict")).alias("accepted"), F.count_if(p & ~F.col("transport").isin("completed", "pending")).alias("failed_transport"),
        F.count_if(p & (F.col("transport") == "pending")).alias("pending"), F.count_if(p & F.col("verdict").isNull()).alias("unverified"),
    )
    return out.withColumn("may_complete", (F.col("assigned") > 0) & (F.col("pending") == 0) & (F.col("unverified") == 0))


def reserve(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """(work_item_id, requests_used, last_state_sha256): the ledger after a batch of requests: all or none.

    One invalid request leaves the ledger as it is. The number of invalid ones is a scalar subquery.
    """
    bad = request_errors(requests, ledger).agg(F.count("error").alias("bad"))
    new = requests.select("work_item_id", F.col("state_hash").alias("hash"))
    d = ledger.join(new, "work_item_id", "full_outer").withColumn("bad", bad.scalar())
    go = (F.col("bad") == 0) & F.col("hash").isNotNull()
    out = d.select("work_item_id", F.when(go, F.coalesce("requests_used", F.lit(0)) + 1).otherwise(F.col("requests_used")).alias("requests_used"), F.when(go, F.col("hash")).otherwise(F.col("last_state_sha256")).alias("last_state_sha256"))
    return out.where("requests_used is not null")


def advice_basis_errors(rows: DataFrame) -> DataFrame:
    """(id, error) of ``rows(id, used, previous, reason, state_hash)``: budget and change rules of an advice request."""
    hash_ = F.coalesce(F.col("previous").rlike("^[0-9a-f]{64}$"), F.lit(False))
    error = (
        F.when(F.col("used").isNull() | (F.col("used") < 0), "invalid_advice_count").when(F.col("used") >= 2, "advice_budget_exhausted").when((F.col("used") == 0) & (F.col("previous").isNotNull() | F.col("reason").isNotNull()), "invalid_initial_advice_basis")
        .when((F.col("used") > 0) & (~hash_ | (F.coalesce(F.trim("reason"), F.lit("")) == "")), "invalid_advice_basis").when((F.col("used") > 0) & (F.col("previous") == F.col("state_hash")), "unchanged_advice_state")
    )
    return rows.select("id", error.alias("error"))


def cache_hits(accesses: DataFrame, capacity: int) -> DataFrame:
    """(cache, seq, hit, evicted) of ``accesses(cache, seq, address, size)``: a byte-bounded LRU, one for each ``cache``.

    Caches are independent, so each is replayed in order in one task; what is held at once fits its capacity. An entry
    larger than the capacity is never held. Of equal last uses the least address goes first.
    """
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, tuple[int, int]] = {}
        used, out = 0, []
        for x in g.sort_values("seq").itertuples(index=False):
            hit, gone = x.address in held, 0
            if hit:
                held[x.address] = (x.seq, held[x.address][1])
            elif x.size <= capacity:
                while used + x.size > capacity:
                    old = min(held, key=lambda k: (held[k][0], k))
                    used -= held.pop(old)[1]
                    gone += 1
                held[x.address] = (x.seq, x.size)
                used += x.size
            out.append((x.cache, x.seq, hit, gone))
        return pd.DataFrame(out, columns=["cache", "seq", "hit", "evicted"])

    kind = accesses.schema["cache"].dataType.simpleString()
    return accesses.select("cache", "seq", "address", "size").groupBy("cache").applyInPandas(run, f"cache {kind}, seq bigint, hit boolean, evicted int")


def hit_rate(hits: DataFrame) -> DataFrame:
    """(cache, lookups, hits, basis_points): whole hundredths of a percent."""
    n = hits.groupBy("cache").agg(F.count(F.lit(1)).alias("lookups"), F.count_if("hit").alias("hits"))
    return n.select("cache", "lookups", "hits", F.expr("hits * 10000 div lookups").alias("basis_points"))


def questions(tasks: DataFrame, preferences: DataFrame, criteria: DataFrame) -> DataFrame:
    """(question_id, task, model, criterion): each task in its order with each preferred model and each criterion.

    ``tasks(task, place)``, ``preferences(task, place, model)``, ``criteria(task, place, criterion)`` join on the task.
    Numbers run on over tasks: a task's first number is the sum of those before it.
    """
    p, c = preferences.select("task", F.col("place").alias("m"), "model"), criteria.select("task", F.col("place").alias("k"), "criterion")
    each = tasks.select("task", F.col("place").alias("t")).join(p, "task").join(c, "task")
    sizes = each.groupBy("task", "t").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("task", F.coalesce(F.sum("n").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    n = F.row_number().over(Window.partitionBy("task").orderBy("m", "k")) - 1
    return each.withColumn("n", n).join(base, "task").select(F.concat(F.lit("fit_"), (F.col("base") + F.col("n")).cast("string")).alias("question_id"), "task", "model", "criterion")


def plan_errors(assignments: DataFrame, tasks: DataFrame, eligible: DataFrame) -> DataFrame:
    """(task, model, error) of a plan's assignments: unknown, repeated or unready tasks and models that aren't eligible."""
    n = assignments.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    d = assignments.join(n, "task").join(tasks.select("task", "ready"), "task", "left").join(eligible.select("task", "model", F.lit(True).alias("fits")), ["task", "model"], "left")
    error = F.when(F.col("ready").isNull() | (F.col("n") > 1), "unknown_or_duplicate_task").when(~F.col("ready"), "task_not_dispatch_ready").when(F.col("fits").isNull(), "ineligible_model")
    return d.select("task", "model", error.alias("error")).where("error is not null")


def roster_errors(tasks: DataFrame) -> DataFrame:
    """(task, error) of ``tasks(task, eligible, excluded, required)``: arrays that overlap, or together miss a required model."""
    both = F.arrays_overlap("eligible", "excluded")
    rest = F.size(F.array_except("required", F.concat("eligible", "excluded"))) > 0
    return tasks.select("task", F.when(both, "eligible_and_excluded").when(rest, "roster_not_covered").alias("error")).where("error is not null")


def withdrawn(assignments: DataFrame, changed: DataFrame) -> DataFrame:
    """Assignments with their model and a reason nulled or set where the live state of the model changed since."""
    c = changed.select("model", F.lit(True).alias("changed")).distinct()
    d = assignments.join(c, "model", "left")
    return d.select("task", F.when(F.col("changed").isNull(), F.col("model")).alias("model"), F.when(F.col("changed"), "local_runtime_changed").alias("reason"))
