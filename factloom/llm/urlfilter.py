"""Verdicts on URLs by rules, and by a tree of path templates where no rule fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import ascii_lower, shared

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def templates(paths: DataFrame, siblings: int = 20, support: int = 100) -> DataFrame:
    """``paths(host, path, n, ...)`` with ``parent`` and ``template``, level by level from the root.

    Digits in a segment are one ``#``. Where a parent has ``siblings`` different segments or more, those with less than
    that share of its pages become ``*``; so a parent keeps fewer than ``siblings`` other branches. Levels follow the
    paths to their ends, however deep, where a parent has ``support`` pages or more that go on. Below that nothing can be
    told about what varies: the rest of the path stands in the template as it is.
    """
    at = ["host", "template"]
    segments = F.transform(F.array_remove(F.split("path", "/"), ""), lambda x: F.regexp_replace(x, r"[0-9]+", "#"))
    t = paths.select("*", segments.alias("s"), F.lit("").alias("parent"), F.lit("/").alias("template"), F.lit(0).alias("depth"), F.lit(False).alias("closed"))
    while True:
        goes_on = ~F.col("closed") & (F.size("s") > F.col("depth"))
        ahead = t.where(goes_on).select(*at, "n", F.get("s", F.col("depth")).alias("seg"))
        wide = shared(ahead.groupBy(*at).agg(F.sum("n").alias("pages"), F.lit(True).alias("wide")).where(F.col("pages") >= support))
        if not wide.limit(1).count():
            break
        own = shared(ahead.groupBy(*at, "seg").agg(F.sum("n").alias("own")).join(wide, at))
        many = own.groupBy(*at).agg(F.count(F.lit(1)).alias("branches"))
        varies = (F.col("branches") >= siblings) & (F.col("own") * siblings < F.col("pages"))
        named = shared(own.join(many, at).select(*at, "seg", F.when(varies, "*").otherwise(F.col("seg")).alias("name")))
        met = t.withColumn("seg", F.when(goes_on, F.get("s", F.col("depth")))).join(named, [*at, "seg"], "left")
        named = F.col("name").isNotNull()
        t = shared(met.select(*paths.columns, "s", F.when(named, F.col("template")).otherwise(F.col("parent")).alias("parent"), F.when(named, F.concat("template", "name", F.lit("/"))).otherwise(F.col("template")).alias("template"),
                              (F.col("depth") + named.cast("int")).alias("depth"), (F.col("closed") | (F.col("seg").isNotNull() & ~named)).alias("closed")))
    rest = F.slice("s", F.col("depth") + 1, F.size("s"))
    ends = F.size("s") > F.col("depth")
    return t.select(*paths.columns, F.when(ends, F.col("template")).otherwise(F.col("parent")).alias("parent"), F.when(ends, F.concat("template", F.array_join(rest, "/"), F.lit("/"))).otherwise(F.col("template")).alias("template"))


def shares(branches: DataFrame, prior: float, weight: float) -> DataFrame:
    """``branches(host, parent, template, bad, marks)`` with ``share``, the smoothed share of bad labels.

    Siblings with labels are ordered by their shares; neighbours that don't differ by a two-proportion z-test (1.96) are one
    branch, which adds up their labels. A branch is smoothed by ``weight`` labels of the share that the same template has
    over all hosts of the domain (the host's last two names), that by as many of its share over all hosts, and that by as
    many of the overall share ``prior``. So a template without labels of its own has the share of its like on sibling hosts.
    """
    order = Window.partitionBy("host", "parent").orderBy(F.col("bad") / F.col("marks"), "template")
    a, b, m, n = F.lag("bad").over(order), F.col("bad"), F.lag("marks").over(order), F.col("marks")
    pooled = (a + b) / (m + n)
    differs = F.abs(b / n - a / m) > 1.96 * F.sqrt(pooled * (1 - pooled) * (1 / m + 1 / n))
    told = branches.where("marks > 0").withColumn("new", F.coalesce(differs, F.lit(True)).cast("int")).withColumn("branch", F.sum("new").over(order))
    both = Window.partitionBy("host", "parent", "branch")
    told = told.select("host", "parent", "template", F.sum("bad").over(both).alias("bad"), F.sum("marks").over(both).alias("marks"))
    domain = F.coalesce(F.nullif(F.regexp_extract("host", r"[^.]+\.[^.]+$", 0), F.lit("")), F.col("host"))
    smooth = lambda p: (F.coalesce("bad", F.lit(0)) + weight * p) / (F.coalesce("marks", F.lit(0)) + weight)
    sums = branches.withColumn("domain", domain).groupBy("domain", "template").agg(F.sum("bad").alias("bad"), F.sum("marks").alias("marks"))
    sums = shared(sums)
    # Written, so that the joins read both sides from exchanges and a template that very many hosts have can be split.
    everywhere = shared(sums.groupBy("template").agg(F.sum("bad").alias("bad"), F.sum("marks").alias("marks")).select("template", smooth(F.lit(prior)).alias("p_all")))
    near = shared(sums.join(everywhere, "template").select("domain", "template", smooth(F.col("p_all")).alias("p_domain")))
    own = branches.select("host", "parent", "template", domain.alias("domain")).join(near, ["domain", "template"]).join(told, ["host", "parent", "template"], "left")
    return own.select("host", "parent", "template", smooth(F.col("p_domain")).alias("share"))


def filter_urls(pages: DataFrame, rules: tuple = RULES, labels: DataFrame | None = None, purity: float = 0.8, weight: float = 5.0, siblings: int = 20, support: int = 100) -> DataFrame:
    """(page_id, host, path, rule, template, verdict) of each page.

    A rule that fits decides (the longest). Else the page's template does. Templates form a tree for each host: segments
    that vary become wildcards, statistically similar siblings are merged, and a template is rejected if its smoothed
    share of bad labels (see ``shares``) is at least ``purity``. Labels are the rules' own verdicts on the pages that they
    decide and, if given, ``labels(page_id, bad)``, which come before those.

    Pages are first counted by host and path with digits generalised; only these counts go through the tree, and each
    parent has a bounded number of branches. The verdicts are joined back by host and path; a host with a third of all
    pages is split by adaptive execution.

    A null url or one without ``://`` has an empty host and path, and no rule: its template is judged like any other.
    Repeated rows give a row each; rows with a null page_id stay. Other columns are ignored. Empty in, empty out.
    """
    host, path = split_url(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("bigint"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule(F.col("host"), F.col("path"), rules)).withColumn("shape", F.regexp_replace("path", r"[0-9]+", "#"))
    marked = rows.withColumn("bad", (F.col("fit.verdict") == "block").cast("int") if rules else F.lit(None).cast("int"))
    if labels is not None:
        known = labels.select(F.col("page_id").cast("bigint").alias("id"), F.col("bad").cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
        marked = marked.join(known, F.col("page_id") == F.col("id"), "left").withColumn("bad", F.coalesce("label", "bad"))
    counts = marked.groupBy("host", F.col("shape").alias("path")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("marks"))
    tree = shared(templates(shared(counts), siblings, support))  # a row for each host and generalised path
    branches = shared(tree.groupBy("host", "parent", "template").agg(F.sum("bad").alias("bad"), F.sum("marks").alias("marks")))
    total = branches.agg(F.sum("bad").alias("bad"), F.sum("marks").alias("marks")).first()
    judged = shares(branches, (total["bad"] or 0) / max(1, total["marks"] or 0), weight)
    verdicts = tree.join(judged.where(F.col("share") >= purity).select("host", "parent", "template", F.lit(True).alias("rejected")), ["host", "parent", "template"], "left")
    verdicts = shared(verdicts.select("host", F.col("path").alias("shape"), "template", "rejected"))
    out = rows.join(verdicts, ["host", "shape"], "left")
    fit = F.col("fit.verdict") if rules else F.lit(None).cast("string")
    verdict = F.coalesce(fit, F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", (F.col("fit.rule") if rules else fit).alias("rule"), "template", verdict.alias("verdict"))
