"""Write hazards between agents: overlapping spans, stale hashes, missing gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.stages import computed


def overlaps(a: DataFrame, b: DataFrame, bucket: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (file, a_id, b_id, a_start, b_start) of half-open spans of one file that intersect; ``carry`` names more columns to bring along.

    Spans are cut into buckets of ``bucket`` positions; pairs meet in an equi join on file and bucket and are kept in
    the bucket where the later of the two starts, so each pair comes once, without a range or cross join.
    """
    cut = lambda t, p: t.where("start < stop").select("file", F.col("id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("stop").alias(f"{p}_stop"), *[F.col(c).alias(f"{p}_{c}") for c in carry], F.explode(F.sequence(F.expr(f"start div {bucket}"), F.expr(f"(stop - 1) div {bucket}"))).alias("bucket"))
    met = cut(a, "a").join(cut(b, "b"), ["file", "bucket"])
    first = F.expr(f"greatest(a_start, b_start) div {bucket}") == F.col("bucket")
    return met.where((F.col("a_start") < F.col("b_stop")) & (F.col("b_start") < F.col("a_stop")) & first).select("file", "a_id", "b_id", "a_start", "b_start", *[f"{p}_{c}" for c in carry for p in "ab"])


def write_after_read(writes: DataFrame, prefetched: DataFrame) -> DataFrame:
    """(file, write_id, read_id): another agent's unconsumed prefetch that a write invalidates."""
    pairs = overlaps(writes, prefetched.where("not consumed"), carry=("agent",))
    return pairs.where("a_agent <> b_agent").select("file", F.col("a_id").alias("write_id"), F.col("b_id").alias("read_id"))


def stale_sources(expected: DataFrame, world: DataFrame) -> DataFrame:
    """(intent_id, file, reason): expected hashes against the world's: missing_source or stale_hash."""
    w = world.select(F.col("file").alias("f"), F.col("hash").alias("now"))
    out = expected.join(w, expected.file == w.f, "left")
    reason = F.when(F.col("f").isNull(), "missing_source").when(F.col("hash") != F.col("now"), "stale_hash")
    return out.select("intent_id", "file", reason.alias("reason")).where("reason is not null")


def missing_gates(required: DataFrame, results: DataFrame) -> DataFrame:
    """Required gates (intent_id, gate) whose result isn't true."""
    return required.join(results.where("passed").select("intent_id", "gate"), ["intent_id", "gate"], "left_anti")


def dedup_stalls(stalls: DataFrame) -> DataFrame:
    """Neighbours that are equal in stage, reason, evidence and addresses are one, after sorting by the first three.

    Only neighbours count, so equal rows that others separate stay. Rows are compared within each sort key.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("stage", "reason", "evidence").orderBy("ord", "addresses")
    before = F.lag("addresses").over(w)
    return stalls.withColumn("first", F.row_number().over(w) == 1).withColumn("before", before).where("first or not (addresses <=> before)").drop("first", "before")


# Stalls of write intents. A stall is (intent_id, stage, reason, evidence).

# Reason codes, and what may clear them.
EPOCHS = {"decode": "stale_decode_epoch", "graph": "stale_graph_epoch", "truth": "stale_truth_epoch", "capability": "stale_capability_epoch", "verification": "stale_verification_epoch"}
DOC_REASONS = {"verified": "stale_docs", "stale": "stale_docs", "contradicted": "contradicted_docs", "unverified": "stale_docs"}
DOC_RECOVERY = {
    "verified": ("refresh_docs_truth", "rerun_truth_serum"), "stale": ("refresh_docs_truth", "rerun_truth_serum"),
    "contradicted": ("refresh_docs_truth", "rerun_truth_serum", "update_docs", "update_code"), "unverified": ("refresh_docs_truth", "rerun_truth_serum", "update_docs"),
}
LINK_REASONS = {"verified": "stale_repo_snapshot", "stale_repo_snapshot": "stale_repo_snapshot", "unverified_external_link": "unverified_external_link", "manifest_drift": "manifest_drift", "version_mismatch": "version_mismatch"}
LINK_RECOVERY = {
    "verified": ("refresh_repo_snapshot",), "stale_repo_snapshot": ("refresh_repo_snapshot",), "unverified_external_link": ("resolve_link", "refresh_repo_snapshot"),
    "manifest_drift": ("refresh_repo_snapshot", "update_code"), "version_mismatch": ("resolve_link", "update_code", "refresh_repo_snapshot"),
}
# End of fixed values.


def _stall(df: DataFrame, stage: str, reason: object, evidence: object) -> DataFrame:
    return df.select("intent_id", F.lit(stage).alias("stage"), reason.alias("reason"), evidence.alias("evidence"))


def base_stalls(intents: DataFrame, world: DataFrame) -> DataFrame:
    """Intents on another commit or worktree than ``world(repo, git_sha, worktree)`` has for their repo."""
    w = world.select("repo", F.col("git_sha").alias("w_sha"), F.col("worktree").alias("w_tree"))
    d = intents.join(w, "repo").where((F.col("git_sha") != F.col("w_sha")) | (F.col("worktree") != F.col("w_tree")))
    return _stall(d, "writeback", F.lit("raw_stale_source"), F.concat_ws("/", "git_sha", "worktree"))


def epoch_stalls(reads: DataFrame, world: DataFrame) -> DataFrame:
    """``reads(intent_id, repo, name, epoch)`` that differ from ``world(repo, name, epoch)``; names as in EPOCHS."""
    w = world.select("repo", "name", F.col("epoch").alias("now"))
    reason = F.lit(None).cast("string")
    for k, v in EPOCHS.items():
        reason = F.when(F.col("name") == k, v).otherwise(reason)
    return _stall(reads.join(w, ["repo", "name"]).where("epoch <> now"), "hazard", reason, F.concat(F.col("epoch"), F.lit(" is not "), F.col("now")))


def claim_conflicts(active: DataFrame, mine: DataFrame) -> DataFrame:
    """(intent_id, other_id) of claims(intent_id, agent, claim) of two agents that may write the same place.

    Path scopes overlap where one is a prefix of the other, so each scope meets the others in an equi join on its
    prefixes, and only the pair of a prefix with a whole scope counts. Repo-wide and unreadable claims are prefixes of
    all; unreadable ones also of other repositories'. No-write claims conflict with none.
    """
    from factloom.functions import scope

    def cut(t: DataFrame, p: str) -> DataFrame:
        s = scope.parse(F.col("claim"))
        d = t.select(F.col("intent_id").alias(f"{p}_id"), F.col("agent").alias(f"{p}_agent"), F.coalesce(s["kind"], F.lit("odd")).alias("kind"), F.coalesce(s["hops"], F.lit(0)).alias("hops"), F.coalesce(s["parts"], F.array().cast("array<string>")).alias("parts")).where("kind <> 'none'")
        sort = F.when(F.col("kind") == "cross", F.lit("cross")).otherwise("own")
        place = F.when(F.col("kind") == "odd", F.array(F.lit("own"), F.lit("cross"))).otherwise(F.array(sort))
        d = d.withColumn("side", F.explode(place))
        prefix = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda n: F.struct(F.array_join(F.slice("parts", 1, n), "/").alias("prefix"), (n == F.size("parts")).alias("whole")))
        return d.select(f"{p}_id", f"{p}_agent", "side", F.when(F.col("kind") == "cross", F.col("hops")).otherwise(-1).alias(f"{p}_hops"), F.explode(prefix).alias("x")).select(f"{p}_id", f"{p}_agent", "side", f"{p}_hops", "x.prefix", F.col("x.whole").alias(f"{p}_whole"))

    a, b = cut(mine, "a"), cut(active, "b")
    met = a.join(b, ["side", "prefix"]).where(F.col("a_agent") != F.col("b_agent"))
    level = (F.col("a_hops") == F.col("b_hops")) | (F.col("a_hops") < 0) | (F.col("b_hops") < 0)
    same = met.where(level & (F.col("a_whole") | F.col("b_whole")))
    other = met.where((F.col("side") == "cross") & (F.col("prefix") == "") & ~level)
    return same.unionByName(other).select(F.col("a_id").alias("intent_id"), F.col("b_id").alias("other_id")).distinct()


def unreadable_claims(claims: DataFrame) -> DataFrame:
    """One stall for each claim that can't be read."""
    from factloom.functions import scope

    return _stall(claims.where(scope.parse(F.col("claim")).isNull()), "writeback", F.lit("unparseable_write_scope"), F.col("claim"))


def precision_stalls(precision: DataFrame) -> DataFrame:
    """Of ``precision(intent_id, mode, ready, profile, blockers, tiers)`` those that aren't ready for autonomous writes.

    The evidence names the mode, readiness, and (where there are any) profile, sorted blockers and sorted tiers.
    """
    ready = (F.col("mode") == "autonomous_write") & F.col("ready") & (F.coalesce(F.size("blockers"), F.lit(0)) <= 0)
    tiers = F.array_join(F.transform(F.array_sort(F.map_entries("tiers")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    text = F.concat_ws(
        "; ", F.concat(F.lit("intent_mode="), "mode"), F.concat(F.lit("autonomous_write_ready="), F.col("ready").cast("string")), F.concat(F.lit("calibration_profile="), "profile"),
        F.when(F.size("blockers") > 0, F.concat(F.lit("precision_blockers="), F.array_join(F.array_sort(F.array_distinct("blockers")), ","))), F.when(F.size(F.map_keys("tiers")) > 0, F.concat(F.lit("evidence_tiers="), tiers)),
    )
    return _stall(precision.where(~F.coalesce(ready, F.lit(False))), "writeback", F.lit("precision_writeback_blocked"), text)


def affected(touches: DataFrame, evidence: DataFrame) -> DataFrame:
    """(intent_id, evidence_id, status, epoch): evidence(evidence_id, status, epoch, files) that isn't verified and whose files an intent touches."""
    e = evidence.where("status <> 'verified'").select("evidence_id", "status", "epoch", F.explode("files").alias("file"))
    return touches.select("intent_id", "file").distinct().join(e, "file").select("intent_id", "evidence_id", "status", "epoch").distinct()


def _by(status: object, table: dict) -> object:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def evidence_stalls(hit: DataFrame, acknowledged: DataFrame, reasons: dict) -> DataFrame:
    """Affected evidence that the intent didn't acknowledge with its present status and epoch. ``reasons``: DOC_REASONS or LINK_REASONS."""
    d = hit.join(acknowledged.select("intent_id", "evidence_id", "status", "epoch"), ["intent_id", "evidence_id", "status", "epoch"], "left_anti")
    return _stall(d, "hazard", _by(F.col("status"), reasons), F.col("evidence_id"))


def uncovered_updates(hit: DataFrame, acknowledged: DataFrame, updates: DataFrame, reasons: dict, recovery: dict) -> DataFrame:
    """Acknowledged affected evidence without an update that clears it.

    An update ``(intent_id, evidence_id, action, produced_epoch)`` clears if its action fits the status and it produced
    a new epoch: not blank, and another than the stale one.
    """
    known = hit.join(acknowledged.select("intent_id", "evidence_id", "status", "epoch"), ["intent_id", "evidence_id", "status", "epoch"], "left_semi")
    accepted = F.lit(False)
    for k, v in recovery.items():
        accepted = accepted | ((F.col("status") == k) & F.col("action").isin(*v))
    clear = known.join(updates, ["intent_id", "evidence_id"]).where(accepted & (F.trim("produced_epoch") != "") & (F.col("produced_epoch") != F.col("epoch")))
    d = known.join(clear.select("intent_id", "evidence_id"), ["intent_id", "evidence_id"], "left_anti")
    return _stall(d, "writeback", _by(F.col("status"), reasons), F.col("evidence_id"))


def scope_gaps(writes: DataFrame, claims: DataFrame, touches: DataFrame, hashes: DataFrame) -> DataFrame:
    """``writes(intent_id, file)`` that aren't claimed, touched and hashed; the evidence names what is missing.

    A claim grants a file if it is one of the file's own prefixes (or repo-wide), so claims meet files by equality.
    """
    from factloom.functions import scope

    prefixes = lambda p: F.transform(F.sequence(F.lit(0), F.coalesce(F.size(p), F.lit(0))), lambda n: F.array_join(F.slice(p, 1, n), "/"))
    w = writes.select("intent_id", "file", F.explode(scope.let(scope.from_file(F.col("file"))["parts"], prefixes)).alias("prefix"))
    c = computed(claims, s=scope.parse(F.col("claim"))).where(F.col("s.kind").isin("repo", "path")).select("intent_id", F.array_join("s.parts", "/").alias("prefix")).distinct()
    granted = w.join(c, ["intent_id", "prefix"]).select("intent_id", "file").distinct().withColumn("claimed", F.lit(True))
    t, h = touches.select("intent_id", "file").distinct().withColumn("touched", F.lit(True)), hashes.select("intent_id", "file").distinct().withColumn("hashed", F.lit(True))
    d = writes.select("intent_id", "file").join(granted, ["intent_id", "file"], "left").join(t, ["intent_id", "file"], "left").join(h, ["intent_id", "file"], "left")
    missing = F.concat_ws(", ", F.when(F.col("claimed").isNull(), "claimed_files"), F.when(F.col("touched").isNull(), "touched_addresses"), F.when(F.col("hashed").isNull(), "expected_source_hashes"))
    return _stall(d.where("claimed is null or touched is null or hashed is null"), "writeback", F.lit("unclaimed_write_scope"), F.concat("file", F.lit(" is not covered by "), missing))


def repeated_files(bundle: DataFrame) -> DataFrame:
    """(bundle_id, file, extra): files that a bundle names more than once."""
    return bundle.groupBy("bundle_id", "file").agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


def bundle_gaps(bundle: DataFrame) -> DataFrame:
    """(bundle_id, file, missing): what a bundle's operation lacks.

    ``bundle(bundle_id, file, operation, claimed, touched, hashed, base_hash, proposed, nonexistence, git_sha, worktree)``:
    a create must prove that the file wasn't there and propose bytes; a replace and a delete need the touched place and
    the base hash; a delete proposes nothing.
    """
    from factloom.functions.codes import absence_evidence

    op = F.col("operation")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    later = op.isin("replace", "delete")
    proof = F.coalesce(F.col("nonexistence") == absence_evidence(F.col("git_sha"), F.col("worktree"), F.col("file")), F.lit(False))
    missing = F.array_compact(F.array(
        F.when(no("claimed"), "claimed_files"), F.when((op == "create") & ~proof, "nonexistence_evidence"), F.when(later & no("touched"), "touched_addresses"), F.when(later & no("hashed"), "expected_source_hashes"),
        F.when(later & (F.coalesce("base_hash", F.lit("")) == ""), "bundle.expected_base_source_hash"), F.when(op.isin("create", "replace") & F.col("proposed").isNull(), "proposed_bytes"),
        F.when((op == "delete") & F.col("proposed").isNotNull(), "no_proposed_bytes_for_delete"),
    ))
    return bundle.select("bundle_id", "file", F.array_join(missing, ", ").alias("missing")).where("missing <> ''")


def bundle_hash_conflicts(bundle: DataFrame) -> DataFrame:
    """(bundle_id, file, problem): a base unlike the intent's expected hash, or a proposed hash unlike the bytes'."""
    from factloom.functions.codes import source_hash

    base = F.when(F.col("base_hash") != F.col("expected_hash"), "base_hash")
    made = F.when(source_hash(F.col("proposed")) != F.col("proposed_hash"), "proposed_hash")
    return bundle.select("bundle_id", "file", F.explode(F.array_compact(F.array(base, made))).alias("problem"))


def fold_bundles(world: DataFrame, operations: DataFrame) -> DataFrame:
    """(file, hash) of the world after ``operations(file, seq, operation, hash)``: the last operation on a file counts, deletes remove it."""
    every = world.select("file", F.lit(-1).cast("bigint").alias("seq"), F.lit("create").alias("operation"), "hash").unionByName(operations.select("file", F.col("seq").cast("bigint").alias("seq"), "operation", "hash"))
    last = every.groupBy("file").agg(F.max(F.struct("seq", "operation", "hash")).alias("x"))
    return last.where("x.operation <> 'delete'").select("file", "x.hash")
