"""Documented claims: what their references prove, and return contracts against sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.codes import freshness


def verify_claims(claims: DataFrame, references: DataFrame, observations: DataFrame) -> DataFrame:
    """(claim_id, status, checked, missing, reasons) of each claim.

    ``references(claim_id, reference_id, target)`` and ``observations(reference_id, section_change, reference_change,
    change_order)``. A claim without a reference that has a target is unverified; with one that wasn't observed,
    contradicted; else stale or unknown if one reference is so, and still unverified if all are fresh: references alone
    prove no meaning. Reasons are the distinct ones, sorted.
    """
    o = observations.select(F.col("reference_id"), F.lit(True).alias("seen"), freshness(F.col("section_change"), F.col("reference_change"), F.col("change_order")).alias("v"))
    r = references.where("target is not null").join(o, "reference_id", "left")
    each = r.groupBy("claim_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("seen").isNull()).alias("missing"), F.count_if(F.col("v.freshness") == "stale").alias("stale"), F.count_if(F.col("v.freshness") == "unknown").alias("unknown"), F.array_join(F.array_sort(F.collect_set("v.reason")), "; ").alias("reasons"))
    status = F.when(F.coalesce("checked", F.lit(0)) == 0, "unverified").when(F.col("missing") > 0, "contradicted").when(F.col("stale") > 0, "stale").when(F.col("unknown") > 0, "unknown").otherwise("unverified")
    return claims.select("claim_id").join(each, "claim_id", "left").select("claim_id", status.alias("status"), F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def check_contracts(contracts: DataFrame, returns: DataFrame) -> DataFrame:
    """(contract_id, outcome): contracts(contract_id, target, symbol, expected) against returns(path, symbol, literal, n).

    ``literal`` is null where the return isn't a literal; ``n`` counts the symbol's declarations.
    """
    files = returns.select(F.col("path").alias("p")).distinct()
    one = returns.groupBy("path", "symbol").agg(F.sum("n").alias("n"), F.min("literal").alias("literal"))
    out = contracts.join(files, contracts.target == files.p, "left").join(one, (contracts.target == one.path) & (contracts.symbol == one.symbol), "left")
    outcome = (
        F.when(~contracts.target.rlike(r"\.tsx?$"), "unsupported_contract_target").when(F.col("p").isNull(), "contract_source_read_failed").when(F.coalesce("n", F.lit(0)) != 1, "contract_source_return_unknown")
        .when(F.col("literal").isNull(), "contract_source_return_unknown").when(F.col("literal") == F.col("expected"), "verified").otherwise("return_contract_mismatch")
    )
    return out.select("contract_id", outcome.alias("outcome"))


def consumer_view(verifications: DataFrame) -> DataFrame:
    """(claim_id, status, evidence_ids): the last status by ordinal, and the distinct evidence, sorted."""
    return verifications.groupBy("claim_id").agg(F.max_by("status", "ordinal").alias("status"), F.array_sort(F.collect_set("evidence_id")).alias("evidence_ids"))


def unproven(verifications: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims other than API contracts whose status is unverified or unknown."""
    return verifications.where(F.col("status").isin("unverified", "unknown")).join(claims.where("kind <> 'api_contract'"), "claim_id", "left_semi")


def unlinked(subjects: DataFrame, links: DataFrame) -> DataFrame:
    """Subjects (file, start, stop) that no link of the same file overlaps."""
    l_ = links.select(F.col("file").alias("f"), F.col("start").alias("a"), F.col("stop").alias("b"))
    return subjects.join(l_, (subjects.file == l_.f) & (subjects.start < l_.b) & (l_.a < subjects.stop), "left_anti").dropDuplicates(["file", "start", "stop"])


def not_revoked(bundles: DataFrame, revoked: DataFrame) -> DataFrame:
    """``bundles(bundle_id, ...)`` but those in ``revoked(bundle_id)``; a null id is never revoked."""
    return bundles.join(revoked.select("bundle_id").distinct(), "bundle_id", "left_anti")
