"""Trajectories of agents: an ordered fold over a question's calls that emits steps, budgets and hashes.

A step holds the hash of the evidence before and after it, what it added, what budget is left
and why the run stopped there, if it did; later calls are not made.  Evidence is what was first
seen of each passage, in order; its snapshot is the hash of its canonical JSON.  A question's
calls are folded inside one row, as each step depends on the one before; the budget bounds how
many of them are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.operators import canonical

ITEM = T.StructType([T.StructField("passage_id", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("source_invocation_id", T.StringType())])
STEP = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("action", "arguments_sha256", "budget_logical", "budget_retries", "state_after_hash", "state_before_hash", "status", "stop_reason")] + [T.StructField("evidence_delta_count", T.IntegerType()), T.StructField("step_index", T.IntegerType())]
)
EVIDENCE = T.ArrayType(ITEM)
#: What ends a run at once, and what is no more than a failed call. Fixed values.
FATAL = ["LEAKAGE_DETECTED", "NON_CANONICAL_ID", "UNAUTHORIZED_TOOL"]


def written(items: Column) -> Column:
    """Canonical JSON of each item."""
    return F.transform(items, lambda x: canonical.json(x, ITEM))


def snapshot(texts: Column) -> Column:
    """Hash of the evidence in order, of its items' canonical JSON; an item is written once, however many snapshots hold it."""
    return F.sha2(F.concat(F.lit('{"evidence":['), F.array_join(texts, ","), F.lit("]}")).cast("binary"), 256)


def _empty(kind: T.DataType) -> Column:
    return F.array().cast(kind)


def fold(calls: DataFrame, logical: int = 3, retries: int = 2, idle: int = 2) -> DataFrame:
    """query_id, steps, evidence, stop, trajectory_sha256 of each question.

    calls: query_id, seq, tool_id, arguments (text), status (EXECUTED or an error), retry
    (boolean), found: array of (passage_id, rank, score).  Calls are made in order of seq (of
    equal ones by tool and arguments).  A call that is no retry takes one of the logical budget, a
    retry one of the retries; one beyond either is not made and ends the run as
    BUDGET_EXHAUSTED.  An error in FATAL ends it by its name, `idle` calls in a row without new
    evidence as REPEATED_CALL_NO_NEW_EVIDENCE, the last call as COMPLETED, or NO_EVIDENCE where
    nothing was found.  Rows without a query_id are left out.
    """
    most = logical + retries + 1  # no more calls can be made, and the last shows that the budget is gone
    call = F.struct("seq", "tool_id", "arguments", "status", "retry", "found")
    lists = calls.where("query_id is not null").groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(call)), 1, most).alias("calls"), F.count("*").alias("n_calls"))
    state = T.StructType([T.StructField("steps", T.ArrayType(STEP)), T.StructField("evidence", EVIDENCE), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("hash", T.StringType()), T.StructField("logical", T.IntegerType()), T.StructField("retries", T.IntegerType()), T.StructField("idle", T.IntegerType()), T.StructField("stop", T.StringType())])
    zero = F.struct(_empty(T.ArrayType(STEP)).alias("steps"), _empty(EVIDENCE).alias("evidence"), _empty(T.ArrayType(T.StringType())).alias("texts"), snapshot(_empty(T.ArrayType(T.StringType()))).alias("hash"), F.lit(logical).alias("logical"), F.lit(retries).alias("retries"), F.lit(0).alias("idle"), F.lit(None).cast("string").alias("stop"))

    def bound(value: Column, fn) -> Column:
        return F.get(F.transform(F.array(value), fn), F.lit(0))

    def step(s: Column, c: Column) -> Column:
        again = F.coalesce(c["retry"], F.lit(False))
        left_logical, left_retries = s["logical"] - F.when(again, 0).otherwise(1), s["retries"] - F.when(again, 1).otherwise(0)
        gone = (left_logical < 0) | (left_retries < 0)
        ok = c["status"] == "EXECUTED"
        invocation = F.concat(F.lit("inv_"), c["seq"].cast("string"))
        # of a passage that a call finds twice, and of one that is known, the first counts
        known = F.transform(s["evidence"], lambda e: e["passage_id"])
        named = F.filter(F.coalesce(c["found"], F.array().cast("array<struct<passage_id:string,rank:int,score:double>>")), lambda f: f["passage_id"].isNotNull())
        ids = F.transform(named, lambda f: f["passage_id"])
        first = F.filter(named, lambda f, i: (F.array_position(ids, f["passage_id"]) == i + 1) & ~F.array_contains(known, f["passage_id"]))
        fresh = F.when(ok & ~gone, F.transform(first, lambda f: F.struct(f["passage_id"].alias("passage_id"), f["rank"].alias("rank"), f["score"].alias("score"), invocation.alias("source_invocation_id")))).otherwise(_empty(EVIDENCE))

        def after(new: Column) -> Column:
            evidence = F.concat(s["evidence"], new)
            count = F.size(new)
            idle_now = F.when(count > 0, 0).otherwise(s["idle"] + 1)
            why = F.when(gone, "BUDGET_EXHAUSTED").when(c["status"].isin(FATAL), c["status"]).when(idle_now >= idle, "REPEATED_CALL_NO_NEW_EVIDENCE")

            def row(texts: Column, h: Column) -> Column:
                values = {
                    "action": F.concat(F.lit("retrieve:"), c["tool_id"]), "arguments_sha256": F.sha2(F.coalesce(c["arguments"], F.lit("")).cast("binary"), 256), "budget_logical": F.greatest(left_logical, F.lit(0)).cast("string"), "budget_retries": F.greatest(left_retries, F.lit(0)).cast("string"),
                    "state_after_hash": h, "state_before_hash": s["hash"], "status": F.when(gone, "NOT_MADE").otherwise(c["status"]), "stop_reason": why, "evidence_delta_count": count, "step_index": F.size(s["steps"]),
                }
                made = F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in STEP])
                return F.struct(F.concat(s["steps"], F.array(made)).alias("steps"), evidence.alias("evidence"), texts.alias("texts"), h.alias("hash"), F.greatest(left_logical, F.lit(0)).alias("logical"), F.greatest(left_retries, F.lit(0)).alias("retries"), idle_now.alias("idle"), why.alias("stop")).cast(state)

            return bound(F.concat(s["texts"], written(new)), lambda texts: bound(F.when(count > 0, snapshot(texts)).otherwise(s["hash"]), lambda h: row(texts, h)))

        return F.when(s["stop"].isNotNull(), s).otherwise(bound(fresh, after))

    folded = lists.select("query_id", F.aggregate("calls", zero.cast(state), step).alias("s"))
    stop = F.coalesce("s.stop", F.when(F.size("s.evidence") == 0, "NO_EVIDENCE").otherwise("COMPLETED"))
    out = folded.select("query_id", "s.steps", "s.evidence", stop.alias("stop"), F.col("s.hash").alias("evidence_sha256"))
    whole = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("steps", T.ArrayType(STEP)), T.StructField("stop", T.StringType())])
    one = F.struct(F.col("query_id").cast("string").alias("query_id"), "steps", "stop")
    return out.withColumn("trajectory_sha256", canonical.digest(one, whole))
