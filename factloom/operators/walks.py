"""Recursive walks over the code graph: reach, owners, scopes, ancestry, chains of configurations.

All walks are rounds of equi joins over what is still open; a round is written before the next one starts. Walks go on
until nothing is new, or pointers double until none moves; a depth is a bound only where it is the question. Circles end a
walk because what has been seen is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.stages import doubled, written


def reach(edges: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(root, node, steps): nodes that ``edges(src, dst)`` reach from ``roots(root)``, each at its least number of steps, ``depth`` at most."""
    e = edges.select("src", "dst").where("src <> dst").distinct()
    seen = front = written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("steps")).distinct())
    k = 0
    while depth is None or k < depth:
        k += 1
        met = front.join(e, front.node == e.src).select("root", F.col("dst").alias("node")).distinct()
        front = written(met.join(seen, ["root", "node"], "left_anti").withColumn("steps", F.lit(k)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front) if k % 16 else written(seen.unionByName(front))
    return seen


def first_arrivals(edges: DataFrame, roots: DataFrame, kinds: tuple[str, ...], depth: int = 4) -> DataFrame:
    """(root, node, steps, chain): as ``reach``, with the names of the edge kinds of the walk that arrives first.

    The queue order decides between walks of one length: the parent's place, then the kind's place in ``kinds``, then
    the edge's ``seq``. Places are numbered inside each root and round, so no window spans several roots.
    """
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    e = edges.where(F.col("kind").isin(*kinds) & (F.col("src") != F.col("dst"))).select("src", "dst", "kind", "seq", rank.alias("rank"))
    seen = front = written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("steps"), F.lit(1).alias("place"), F.array().cast("array<string>").alias("chain")).distinct())
    for k in range(1, depth + 1):
        met = front.join(e, front.node == e.src).select("root", F.col("dst").alias("node"), F.struct("place", "rank", "seq").alias("key"), F.concat("chain", F.array("kind")).alias("chain"))
        met = met.groupBy("root", "node").agg(F.min(F.struct("key", "chain")).alias("first")).join(seen.select("root", "node"), ["root", "node"], "left_anti")
        place = F.row_number().over(Window.partitionBy("root").orderBy("first.key", "node"))
        front = written(met.select("root", "node", F.lit(k).alias("steps"), place.alias("place"), F.col("first.chain").alias("chain")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.drop("place")


def owner_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, owner): names from below the file down to the node, dotted.

    Null for files, for what has several parents or none on the way, and for circles. Pointers are doubled: the round
    that maps a node to what lies 2^k above also joins the two halves of the name.
    """
    up = edges.where("kind = 'contains'").groupBy(F.col("dst").alias("child")).agg(F.when(F.min("src") == F.max("src"), F.min("src")).alias("up"))
    n = nodes.join(up, nodes.node_id == up.child, "left").select("node_id", "kind", F.col("name").alias("path"), "up")
    ends = F.col("kind").isin("file", "module_init")
    n = written(n.select("node_id", ends.alias("is_end"), F.when(~ends, F.col("path")).alias("path"), F.when(~ends, F.col("up")).alias("up"), (F.col("kind") == "file").alias("whole")))

    def jump(n: DataFrame) -> DataFrame:
        above = n.select(F.col("node_id").alias("x"), F.col("path").alias("x_path"), F.col("up").alias("x_up"), F.col("whole").alias("x_whole"))
        path = F.when(F.col("x_path").isNotNull(), F.concat("x_path", F.lit("."), "path")).otherwise(F.col("path"))
        whole = F.coalesce(F.when(F.col("up").isNotNull(), F.col("x_whole")), F.col("whole"))
        return n.join(above, n.up == above.x, "left").select("node_id", "is_end", path.alias("path"), F.when(~F.col("is_end"), F.col("x_up")).alias("up"), whole.alias("whole"))

    n = doubled(n, jump, "up")
    return n.select("node_id", F.when(F.col("whole") & F.col("up").isNull() & ~F.col("is_end"), F.col("path")).alias("owner"))


def nearest_in_scope(refs: DataFrame, decls: DataFrame, scopes: DataFrame) -> DataFrame:
    """(ref_id, node, steps): of ``refs(ref_id, scope, name)`` the declaration in the nearest enclosing scope.

    ``decls(scope, name, node)`` are looked up by scope and name; what isn't found climbs to ``scopes(scope, parent)``.
    References that no scope declares have no row. The last declaration of a name in a scope counts (greatest node). In
    a circle of scopes a reference climbs until it is back at the scope where it was when the steps last were a power of 2.
    """
    d = decls.groupBy("scope", "name").agg(F.max("node").alias("node"))
    up = scopes.select(F.col("scope").alias("s"), "parent").distinct()
    left, found, k, mark = written(refs.select("ref_id", "scope", "name", F.col("scope").alias("mark"))), [], 0, 1
    while True:
        met = written(left.join(d, ["scope", "name"], "left"))
        found.append(met.where("node is not null").select("ref_id", "node", F.lit(k).alias("steps")))
        if len(found) == 16:
            found = [written(reduce(DataFrame.unionByName, found))]
        open_ = met.where("node is null").drop("node")
        left = open_.join(up, open_.scope == up.s).where("parent is not null and parent <> scope and parent <> mark").select("ref_id", F.col("parent").alias("scope"), "name", "mark")
        k += 1
        if k == mark:
            mark, left = 2 * mark, left.withColumn("mark", F.col("scope"))
        left = written(left)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)


def change_order(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """(pair_id, change_order) of ``pairs(pair_id, section, reference)`` over ``commits(commit, parent)``.

    The same commit; the one before the other if it is among its ancestors; diverged if both are known but neither
    is; unknown if one isn't known or null.

    Of a history only the pairs' ends and the merges matter; between them, runs of commits with one parent are skipped
    by doubled pointers. So the walk up takes as many rounds as there are ends and merges in a row, not commits. It goes
    on until nothing is new, and an end stops as soon as all its pairs are told.
    """
    known = commits.select(F.col("commit").alias("c")).distinct()
    parents = commits.where("parent is not null and parent <> commit").select("commit", "parent").distinct()
    p = pairs.where("section is not null and reference is not null and section <> reference").select("section", "reference").distinct()
    p = written(p.join(known.withColumnRenamed("c", "section"), "section", "left_semi").join(known.withColumnRenamed("c", "reference"), "reference", "left_semi"))
    ends = p.select(F.explode(F.array("section", "reference")).alias("root")).distinct()
    merges = parents.groupBy("commit").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("only"))
    stops = ends.select(F.col("root").alias("stop"), F.lit(True).alias("stops"))
    # ``at``: the stop that a commit leads to; ``via``: where to look for it.
    lone = merges.join(stops, merges.commit == stops.stop, "left").select("commit", (F.coalesce("stops", F.lit(False)) | (F.col("n") > 1)).alias("stops"), "only")
    skip = written(lone.select("commit", F.when(F.col("stops"), F.col("commit")).alias("at"), F.when(~F.col("stops"), F.col("only")).alias("via")))

    def jump(t: DataFrame) -> DataFrame:
        above = t.select(F.col("commit").alias("x"), F.col("at").alias("x_at"), F.col("via").alias("x_via"))
        at = F.coalesce("at", "x_at", F.when(F.col("x").isNull(), F.col("via")))  # a commit without parents is a stop
        return t.join(above, t.via == above.x, "left").select("commit", at.alias("at"), F.when(at.isNull(), F.col("x_via")).alias("via"))

    skip = doubled(skip, jump, "via").where("at is not null").select(F.col("commit").alias("parent"), "at")
    e = lone.where("stops").select("commit").join(parents, "commit").join(skip, "parent", "left").select(F.col("commit").alias("src"), F.coalesce("at", "parent").alias("dst"))
    e = written(e.distinct())
    sides = p.unionByName(p.select(F.col("reference").alias("section"), F.col("section").alias("reference"))).select(F.col("section").alias("root"), F.col("reference").alias("node"))
    asked = written(sides.distinct())
    # What a walk has seen is left out, or circles wouldn't end. All of it is looked at in every eighth round only, else what
    # has come since: a place that is met again meanwhile costs some rows, where looking at all of it would cost a pass over it.
    front = recent = written(ends.select("root", F.col("root").alias("node")))
    seen, told, k = front.limit(0), asked.limit(0), 0
    while not front.isEmpty():
        k += 1
        met = front.join(e, front.node == e.src).select("root", F.col("dst").alias("node")).distinct()
        whole = k % 8 == 0
        new = met.join(seen.unionByName(recent) if whole else recent, ["root", "node"], "left_anti")
        front = written(new.join(asked.withColumn("hit", F.lit(True)), ["root", "node"], "left"))
        hits, front = front.where("hit").select("root", "node"), front.select("root", "node")
        if not hits.isEmpty():
            told = told.unionByName(hits)
            both = hits.unionByName(hits.select(F.col("node").alias("root"), F.col("root").alias("node")))
            asked = written(asked.join(both, ["root", "node"], "left_anti"))
            front = written(front.join(asked.select("root").distinct(), "root", "left_semi"))
        seen = written(seen.unionByName(recent)) if whole else seen
        recent = front if whole else recent.unionByName(front)
    a = told.select(F.col("root").alias("reference"), F.col("node").alias("section"), F.lit(True).alias("first"))
    b = told.select(F.col("root").alias("section"), F.col("node").alias("reference"), F.lit(True).alias("second"))
    d = pairs.join(a, ["section", "reference"], "left").join(b, ["section", "reference"], "left")
    d = d.join(known.select(F.col("c").alias("section"), F.lit(True).alias("k1")), "section", "left").join(known.select(F.col("c").alias("reference"), F.lit(True).alias("k2")), "reference", "left")
    order = F.when(F.col("section").isNull() | F.col("reference").isNull() | F.col("k1").isNull() | F.col("k2").isNull(), "unknown").when(F.col("section") == F.col("reference"), "same_change").when(F.col("first"), "section_before_reference").when(F.col("second"), "reference_before_section").otherwise("diverged")
    return d.select("pair_id", order.alias("change_order"))


def config_chain(configs: DataFrame, depth: int = 16) -> DataFrame:
    """(config, value, gap, too_deep): ``configs(config, base, value)`` with what their chain of bases gives them.

    The nearest non-null value counts. ``gap`` names the first base that isn't there; ``too_deep`` tells that the chain
    has over ``depth`` links or is a circle, so that the value may be another's beyond them.
    """
    base = configs.select(F.col("config").alias("b"), F.col("base").alias("next"), F.col("value").alias("inherited"))
    n = written(configs.select("config", F.col("base").alias("at"), "value", F.lit(None).cast("string").alias("gap")))
    for _ in range(depth):
        met = n.join(base, n["at"] == base.b, "left")
        lost = F.col("at").isNotNull() & F.col("b").isNull()
        n = written(met.select("config", F.when(~lost, F.col("next")).alias("at"), F.coalesce("value", "inherited").alias("value"), F.coalesce("gap", F.when(lost, F.col("at"))).alias("gap")))
    return n.select("config", "value", "gap", F.col("at").isNotNull().alias("too_deep"))


def effective_scopes(modules: DataFrame) -> DataFrame:
    """(module, visible): how far a module is visible: the narrowest of its own scope and those around it.

    ``modules(module, parent, scope)``; scopes are paths (a dotted prefix), the narrowest is the longest. Pointers double
    until neither a pointer nor a scope changes, which holds for circles too.
    """
    n = written(modules.select("module", F.col("parent").alias("up"), F.col("scope").alias("visible")))
    narrower = lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a)
    state = None
    while True:
        now = tuple(n.agg(F.count("up"), F.sum(F.length("visible"))).first())
        if now[0] == 0 or now == state:
            return n.select("module", "visible")
        state = now
        above = n.select(F.col("module").alias("x"), F.col("up").alias("x_up"), F.col("visible").alias("x_visible"))
        n = written(n.join(above, n.up == above.x, "left").select("module", F.col("x_up").alias("up"), narrower(F.col("visible"), F.coalesce("x_visible", F.lit(""))).alias("visible")))
