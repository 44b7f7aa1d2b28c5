"""Plans of side effects, observations of models, and assignments under capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.stages import written

# What of an earlier observation a later response may not overrule.
NEGATIVE = (("auth_observed", "unavailable"), ("runtime_capability", "unavailable"), ("billing_status", "conflict"), ("quota", "exhausted"), ("model_inference", "unavailable"))
# End of fixed values.


def planned_effects(bundle: DataFrame) -> DataFrame:
    """(bundle_id, effect, file, depends_on): the side effects of ``bundle(bundle_id, file, operation)``, each with those it needs.

    Outside evidence is invalidated first; a receipt, directories (once each) and file changes follow; a ledger line
    follows each change and the receipt; the evidence is kept when all else is done.
    """
    name = lambda kind, f=None: F.concat(F.lit(kind), F.lit(":"), F.coalesce(f, F.lit("")) if f is not None else F.lit(""))
    b = bundle.select("bundle_id", "file", F.when(F.col("operation") == "delete", "file_delete").otherwise("file_write").alias("kind"), F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).alias("parent"))
    row = lambda t, effect, file, needs: t.select("bundle_id", effect.alias("effect"), file.cast("string").alias("file"), F.array_sort(F.array_compact(F.array(*needs))).alias("depends_on"))
    first, receipt, none = name("federation_invalidation"), name("receipt_write"), F.lit(None)
    ids = b.select("bundle_id").distinct()
    directory = F.when(F.col("parent").isNotNull(), name("directory_create", F.col("parent")))
    change = F.concat("kind", F.lit(":"), "file")
    ledger = name("ledger_append", F.col("file"))
    out = row(ids, first, none, [F.lit(None).cast("string")]).unionByName(row(ids, receipt, none, [first])).unionByName(row(b.where("parent is not null").select("bundle_id", "parent").distinct(), name("directory_create", F.col("parent")), F.col("parent"), [first]))
    out = out.unionByName(row(b, change, F.col("file"), [first, directory])).unionByName(row(b, ledger, F.col("file"), [receipt, change]))
    ends = b.groupBy("bundle_id").agg(F.array_sort(F.array_union(F.array(first, receipt), F.array_union(F.collect_set(change), F.collect_set(ledger)))).alias("depends_on"))
    return out.unionByName(ends.select("bundle_id", name("evidence_persist").alias("effect"), F.lit(None).cast("string").alias("file"), "depends_on"))


def mark_executed(effects: DataFrame, done: DataFrame) -> DataFrame:
    """``effects`` with status executed where ``done(bundle_id, effect)`` says so, else planned."""
    d = done.select("bundle_id", "effect", F.lit("executed").alias("status")).distinct()
    return effects.drop("status").join(d, ["bundle_id", "effect"], "left").withColumn("status", F.coalesce("status", F.lit("planned")))


def readiness(models: DataFrame, observed: DataFrame) -> DataFrame:
    """(model, ready, reasons) of configured ``models(model)`` against ``observed(model, auth_observed, runtime_capability, billing_status, quota, model_inference)``.

    Ready if all five are; reasons are ``field:value`` of those that aren't, in this order. A model without an observation has ``unobserved``.
    """
    fields = [k for k, _ in NEGATIVE]
    d = models.select("model").join(observed.withColumn("seen", F.lit(True)), "model", "left")
    why = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f) == "ready", F.lit(False)), F.concat(F.lit(f + ":"), F.coalesce(f, F.lit("null")))) for f in fields]))
    reasons = F.when(F.col("seen").isNull(), F.array(F.lit("unobserved"))).otherwise(why)
    return d.select("model", (F.size(reasons) == 0).alias("ready"), F.array_join(reasons, ",").alias("reasons"))


def merge_responses(observed: DataFrame, responses: DataFrame) -> DataFrame:
    """(model, outcome, observed_at): what becomes of each model when newer responses are merged into an observation.

    A ready response is adopted unless the observation says no to it (conflict); others leave the row as it is. The
    older of the two times stands for the result.
    """
    fields = [k for k, _ in NEGATIVE]
    r = responses.select(F.col("model").alias("m"), *[F.col(f).alias("r_" + f) for f in fields], F.col("observed_at").alias("r_at"))
    d = observed.join(r, observed.model == r.m, "left")
    ready = F.lit(True)
    for f in fields:
        ready = ready & F.coalesce(F.col("r_" + f) == "ready", F.lit(False))
    no = F.lit(False)
    for f, v in NEGATIVE:
        no = no | F.coalesce(F.col(f) == v, F.lit(False))
    outcome = F.when(ready & no, "conflict").when(ready, "adopted").otherwise("kept")
    return d.select("model", outcome.alias("outcome"), F.when(outcome == "adopted", F.least("observed_at", "r_at")).otherwise(F.col("observed_at")).alias("observed_at"))


def compose(tasks: DataFrame, qualified: DataFrame, limits: DataFrame, total: int) -> DataFrame:
    """(task, model, pool, reason): tasks in their order take the first qualified model whose pool and the whole have room.

    ``tasks(task, place, ready)``, ``qualified(task, preference, model, pool)``, ``limits(pool, room)``. Each choice depends
    on all before it. But of the tasks that prefer the same pools in the same order the first ``total`` alone can start, so
    only those are told one after the other (in one task); all others find no room.
    """
    import pandas as pd

    rooms = limits.select(F.map_from_entries(F.array_agg(F.struct("pool", "room")))).scalar()  # a row for each pool
    wishes = qualified.groupBy("task").agg(F.transform(F.array_sort(F.collect_list(F.struct("preference", "model", "pool"))), lambda x: F.struct(x["model"].alias("model"), x["pool"].alias("pool"))).alias("wishes"))
    each = written(tasks.join(wishes, "task", "left"))
    able = F.col("ready") & F.col("wishes").isNotNull()
    order = Window.partitionBy("pools").orderBy("place", "task")
    first = each.where(able).withColumn("pools", F.transform("wishes", lambda x: x["pool"])).withColumn("n", F.row_number().over(order)).where(F.col("n") <= total)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        room, left, out = None, total, []
        for x in g.sort_values(["place", "task"]).itertuples(index=False):
            room = dict(x.rooms) if room is None else room
            for w in x.wishes:
                if left and room.get(w["pool"], 0) > 0:
                    room[w["pool"]] -= 1
                    left -= 1
                    out.append((x.task, w["model"], w["pool"]))
                    break
        return pd.DataFrame(out, columns=["task", "model", "pool"])

    kinds = {f.name: f.dataType.simpleString() for f in [*tasks.schema.fields, *qualified.schema.fields]}
    starts = first.select("task", "place", "wishes", rooms.alias("rooms"), F.lit(1).alias("round")).groupBy("round").applyInPandas(run, f"task {kinds['task']}, model {kinds['model']}, pool {kinds['pool']}")
    reason = F.when(~F.col("ready"), "task_not_dispatch_ready").when(F.col("wishes").isNull(), "no_supported_model").when(F.col("model").isNull(), "capacity")
    return each.join(starts, "task", "left").select("task", "model", "pool", reason.alias("reason"))


def addresses_for(intents: DataFrame, world: DataFrame, touches: DataFrame) -> DataFrame:
    """(intent_id, file, address): the world's address of a file, else the intent's own for it, else all that it touches.

    ``intents(intent_id, file)``, ``world(file, address)``, ``touches(intent_id, file, address)``. Only files that have
    neither of the first two are joined with all of their intent's touches.
    """
    ids = ["intent_id", "file"]
    asked = intents.select(*ids).distinct()
    w = asked.join(world, "file").select(*ids, "address")
    left = asked.join(world, "file", "left_anti")
    own = left.join(touches, ids).select(*ids, "address")
    every = left.join(touches, ids, "left_anti").join(touches.select("intent_id", "address").distinct(), "intent_id").select(*ids, "address")
    return w.unionByName(own).unionByName(every).distinct()
