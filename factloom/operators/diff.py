"""Expected against observed facts: the flagship comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.codes import NODE_LIKE

KEY = ["kind", "file", "graph_kind", "name", "owner", "source", "target", "span"]
IDENTITY = ["kind", "file", "name", "source"]
REST = ["graph_kind", "owner", "target", "span"]
VERSION = ["src_version", "src_name", "src_url", "src_role"]


def severity(kind: Column) -> Column:
    high = ("missing_edge", "missing_node", "stale_dynamic_evidence", "wrong_cross_file_dependent", "wrong_target")
    return F.when(kind.isin(*high), "high").when(kind.isin("semantic_limit", "truth_source_gap", "unsupported_construct"), "info").otherwise("medium")


def node_like(kind: Column) -> Column:
    return kind.isin(*NODE_LIKE)


def mismatch_kind(e: str = "e", a: str = "a") -> Column:
    """The first attribute in which two facts of one identity differ, from columns ``e_*`` and ``a_*``."""
    same = lambda c: F.col(f"{e}_{c}").eqNullSafe(F.col(f"{a}_{c}"))
    return (
        F.when(F.col("kind") == "cross_file_dependent", "wrong_cross_file_dependent").when(~same("graph_kind"), "wrong_kind").when(~same("owner"), "wrong_owner")
        .when(~same("target"), "wrong_target").when(~same("span"), "wrong_span").otherwise("wrong_target")
    )


def _null_safe(columns: list[str], left: DataFrame, right: DataFrame) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def representatives(actual: DataFrame) -> DataFrame:
    """One observed fact for each key: that of least version, name, url and role."""
    order = [F.col(c).asc_nulls_first() for c in VERSION]
    return actual.withColumn("n", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("n = 1").drop("n")


def _greedy(rows: DataFrame) -> DataFrame:
    """One-to-one matches inside each identity: expected facts in their order take the best free candidate.

    Identities are independent, so each is one small group (facts of one name in one file).
    """

    def run(g):  # noqa: ANN001, ANN202
        taken, out = set(), []
        for e in sorted(g["ord"].unique()):
            own = g[(g["ord"] == e) & ~g["aid"].isin(taken)].sort_values(["differences", "rank", "akey"])
            if len(own):
                taken.add(own.iloc[0]["aid"])
                out.append(own.iloc[0])
        import pandas as pd

        return pd.DataFrame(out, columns=g.columns)[["ord", "aid", "diff"]] if out else g.iloc[:0][["ord", "aid", "diff"]]

    return rows.groupBy("ident").applyInPandas(run, "ord bigint, aid bigint, diff string")


def classify(expected: DataFrame, actual: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    """(diff, classification, severity, ord, and the fact's key): every difference of two fact tables.

    ``expected(ord, KEY...)`` is judged row by row; ``actual(KEY..., VERSION...)`` counts once for each key. Equal keys
    (null-safe) agree. An expected fact without its equal takes the best free observed fact of the same identity, which
    gives one ``wrong_*`` row; else it is ``missing_*``. Observed keys that are neither expected nor taken are
    ``extra_*``. ``explanations(file, kind, graph_kind, name, code)`` turn an expected fact's difference into ``code``.

    All joins are hash joins on null-safe keys. Only identities with several candidates go through Python, one small
    group each; single ones, the common case, are joined natively.
    """
    a = representatives(actual).withColumn("aid", F.xxhash64(*KEY))
    keys = a.select(*KEY).withColumn("found", F.lit(True))
    judged = expected.join(keys, _null_safe(KEY, expected, keys), "left").select(*[expected[c] for c in expected.columns], "found")
    open_e = judged.where("found is null").drop("found")
    e_keys = expected.select(*KEY).distinct()
    open_a = a.join(e_keys, _null_safe(KEY, a, e_keys), "left_anti")
    left = open_e.select("ord", *IDENTITY, *[F.col(c).alias(f"e_{c}") for c in REST])
    right = open_a.select("aid", *[F.col(c).alias(f"i_{c}") for c in IDENTITY], *[F.col(c).alias(f"a_{c}") for c in REST])
    on = F.lit(True)
    for c in IDENTITY:
        on = on & left[c].eqNullSafe(right[f"i_{c}"])
    same = {c: F.col(f"e_{c}").eqNullSafe(F.col(f"a_{c}")) for c in REST}
    eligible = node_like(F.col("kind")) | (same["span"] & same["owner"]) | (same["target"] & same["owner"] & same["graph_kind"])
    pairs = left.join(right, on).where(eligible)
    differences = sum(((~same[c]).cast("int") for c in REST), F.lit(0))
    diff = mismatch_kind()
    order = {"wrong_cross_file_dependent": 0, "wrong_kind": 1, "wrong_owner": 2, "wrong_target": 3, "wrong_span": 4}
    rank = F.lit(5)
    for k, v in order.items():
        rank = F.when(F.col("diff") == k, v).otherwise(rank)
    pairs = pairs.select("ord", "aid", F.xxhash64(*IDENTITY).alias("ident"), differences.alias("differences"), diff.alias("diff"), F.to_json(F.struct(*[F.col(f"a_{c}") for c in REST])).alias("akey")).withColumn("rank", rank)
    sizes = pairs.groupBy("ident").agg(F.count(F.lit(1)).alias("candidates"))
    pairs = pairs.join(sizes, "ident")
    taken = pairs.where("candidates = 1").select("ord", "aid", "diff").unionByName(_greedy(pairs.where("candidates > 1")))
    wrong = open_e.join(taken, "ord", "left")
    missing = F.when(node_like(F.col("kind")), "missing_node").otherwise("missing_edge")
    of_expected = wrong.select("ord", *KEY, F.coalesce("diff", missing).alias("diff"))
    extra = open_a.join(taken.select("aid"), "aid", "left_anti").select(F.lit(None).cast("bigint").alias("ord"), *KEY, F.when(node_like(F.col("kind")), "extra_node").otherwise("extra_edge").alias("diff"))
    out = of_expected.unionByName(extra).withColumn("classification", F.lit("silent_divergence"))
    if explanations is not None:
        x = explanations.select(*[F.col(c).alias(f"x_{c}") for c in ("file", "kind", "graph_kind", "name", "code")])
        match = (out["file"] == x["x_file"]) & (out["kind"] == x["x_kind"]) & out["graph_kind"].eqNullSafe(x["x_graph_kind"]) & (out["name"] == x["x_name"]) & out["ord"].isNotNull()
        out = out.join(x.groupBy("x_file", "x_kind", "x_graph_kind", "x_name").agg(F.min("x_code").alias("x_code")), match, "left")
        out = out.withColumn("classification", F.coalesce("x_code", "classification")).withColumn("diff", F.coalesce("x_code", "diff")).select("ord", *KEY, "diff", "classification")
    return out.withColumn("severity", severity(F.col("diff"))).select("ord", *KEY, "diff", "classification", "severity")


def scorecard(expected_count: int, actual_count: int, diffs: DataFrame) -> DataFrame:
    """Counts by kind of difference and the share of expected facts that were found (1 if there are none)."""
    silent = F.count_if(F.col("classification") == "silent_divergence")
    lost = F.count_if(F.col("ord").isNotNull())
    return diffs.agg(F.count(F.lit(1)).alias("diffs"), silent.alias("silent"), F.count_if(F.col("classification") != "silent_divergence").alias("explained"), lost.alias("lost")).select(
        F.lit(expected_count).cast("bigint").alias("expected"), F.lit(actual_count).cast("bigint").alias("actual"), "diffs", "silent", "explained",
        F.when(F.lit(expected_count) == 0, 1.0).otherwise((F.lit(expected_count) - F.col("lost")) / F.greatest(F.lit(expected_count), F.lit(1))).alias("coverage"),
    )


CLUSTER = ("kind", "classification", "graph_surface", "truth_source", "diagnostic_code", "suspected_subsystem")


def cluster_cards(cards: DataFrame) -> DataFrame:
    """Cards by their six keys: occurrences summed, distinct paths and evidence counted, the first path, the gravest severity.

    Keys are a small vocabulary, so a cluster may have very many members; ``cluster_members`` has those as rows.
    """
    from factloom.functions.codes import severity_weight

    members = cluster_members(cards).groupBy(*CLUSTER).agg(F.count_if(F.col("member") == "path").alias("n_paths"), F.count_if(F.col("member") == "evidence").alias("n_evidence"))
    out = cards.groupBy(*CLUSTER).agg(F.sum("occurrence_count").alias("occurrence_count"), F.max_by("severity", severity_weight(F.col("severity"))).alias("severity"), F.min("path").alias("path"))
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"m.{k}")) for k in CLUSTER]
    return out.alias("o").join(members.alias("m"), same, "left").select("o.*", F.coalesce("n_paths", F.lit(0)).alias("n_paths"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def cluster_members(cards: DataFrame) -> DataFrame:
    """(the six keys, member, value): a cluster's affected paths and its evidence, each once. Duplicates go on the map side."""
    every = F.explode(F.array(F.struct(F.lit("path").alias("member"), F.col("path").alias("value")), F.struct(F.lit("evidence").alias("member"), F.col("evidence_id").cast("string").alias("value"))))
    return cards.select(*CLUSTER, every.alias("x")).select(*CLUSTER, "x.*").where("value is not null").distinct()


def role_completeness(roles: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, problem) of paths that only one of the two tables has: missing a role, or unexpected."""
    r, s = roles.select("path").distinct(), sources.select(F.col("path").alias("source_path")).distinct()
    return r.join(s, r.path == s.source_path, "full_outer").where("path is null or source_path is null").select(F.coalesce("path", "source_path").alias("path"), F.when(F.col("path").isNull(), "missing").otherwise("unexpected").alias("problem"))


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of two observations (path, sha256): added, removed or changed."""
    a, b = before.select("path", F.col("sha256").alias("old")), after.select(F.col("path").alias("p"), F.col("sha256").alias("new"))
    change = F.when(F.col("path").isNull(), "added").when(F.col("p").isNull(), "removed").otherwise("changed")
    return a.join(b, a.path == b.p, "full_outer").where("not (path <=> p and old <=> new)").select(F.coalesce("path", "p").alias("path"), change.alias("change"))
