"""Trajectories against a plain replay of the same calls."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from rankwell.operators import trajectory
from rankwell.plans import agents, registry

CALLS = "query_id string, seq int, tool_id string, arguments string, status string, retry boolean, found array<struct<passage_id:string,rank:int,score:double>>, steps int"


def sha(value):
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":")).encode()).hexdigest()


def replay(query, calls, logical=3, retries=2, idle=2):
    """(stop, steps, evidence hash, trajectory hash)"""
    steps, evidence, quiet, stop = [], [], 0, None
    for seq, tool, arguments, status, retry, found in sorted(calls, key=lambda c: (c[0], c[1], c[2] is not None, c[2] or "")):
        before, new = sha({"evidence": evidence}), []
        logical, retries = (logical, retries - 1) if retry else (logical - 1, retries)
        gone = logical < 0 or retries < 0
        logical, retries = max(logical, 0), max(retries, 0)
        if status == "EXECUTED" and not gone:
            for p, rank, score in found or []:
                if p is not None and p not in {e["passage_id"] for e in evidence + new}:
                    new.append({"passage_id": p, "rank": rank, "score": score, "source_invocation_id": f"inv_{seq}"})
        evidence = evidence + new
        quiet = 0 if new else quiet + 1
        stop = "BUDGET_EXHAUSTED" if gone else status if status in trajectory.FATAL else "REPEATED_CALL_NO_NEW_EVIDENCE" if quiet >= idle else None
        steps.append(
            {
                "action": f"retrieve:{tool}", "arguments_sha256": hashlib.sha256((arguments or "").encode()).hexdigest(), "budget_logical": str(logical), "budget_retries": str(retries), "state_after_hash": sha({"evidence": evidence}), "state_before_hash": before,
                "status": "NOT_MADE" if gone else status, "stop_reason": stop, "evidence_delta_count": len(new), "step_index": len(steps),
            }
        )
        if stop:
            break
    stop = stop or ("COMPLETED" if evidence else "NO_EVIDENCE")
    return stop, steps, sha({"evidence": evidence}), sha({"query_id": query, "steps": steps, "stop": stop})


def test_trajectories_against_replay(spark):
    r = random.Random(11)
    runs = {}
    for q in range(120):
        calls = []
        for seq in range(r.randrange(1, 9)):
            found = None if r.random() < 0.1 else [(r.choice([f"ps_{r.randrange(6)}", f"ps_é{r.randrange(3)}", None]), i, r.choice([0.5, 0.1, 1e-7, None])) for i in range(r.randrange(0, 4))]
            calls.append((r.choice([seq, seq, 0]), r.choice(["baseline", "window"]), r.choice(["q", 'a "b"', None]), r.choice(["EXECUTED"] * 6 + ["TOOL_FAILURE", "LEAKAGE_DETECTED"]), r.choice([False, False, True, None]), found))
        if len({c[:3] for c in calls}) == len(calls):  # ties of all three have no order of their own here
            runs[f"q{q}"] = calls
    df = spark.createDataFrame([(q, *c, 1) for q, calls in runs.items() for c in calls] + [(None, 1, "t", "a", "EXECUTED", False, None, 1)], CALLS)
    got = {x.query_id: x for x in trajectory.fold(df).collect()}
    assert set(got) == set(runs) and len(runs) > 60
    for q, calls in runs.items():
        stop, steps, evidence, whole = replay(q, calls)
        assert (got[q].stop, [s.asDict() for s in got[q].steps], got[q].evidence_sha256, got[q].trajectory_sha256) == (stop, steps, evidence, whole), q
    assert {x.stop for x in got.values()} >= {"COMPLETED", "BUDGET_EXHAUSTED", "LEAKAGE_DETECTED", "REPEATED_CALL_NO_NEW_EVIDENCE"}
    assert trajectory.fold(df.limit(0)).count() == 0


def test_registered_trajectories(spark):
    sf = "/root/testdata/sf0.001"
    calls = {}
    for c in agents.agent_calls(spark, sf).collect():
        calls.setdefault(c.query_id, []).append((c.seq, c.tool_id, c.arguments, c.status, c.retry, [tuple(f) for f in c.found]))
    got = {x.query_id: x for x in registry.QUERIES["agt09_trajectories"](spark, sf).collect()}
    assert set(got) == set(calls) and got
    for q, own in calls.items():
        stop, steps, evidence, whole = replay(q, own)
        assert (got[q].stop, got[q].n_steps, got[q].evidence_sha256, got[q].trajectory_sha256) == (stop, len(steps), evidence, whole), q


def test_an_item_is_written_once(spark):
    """Snapshots are made of texts that are there, so canonical JSON of an item stands in the plan once and not in each snapshot's loop over the evidence."""
    plan = trajectory.snapshot(F.col("texts"))
    df = spark.createDataFrame([(['{"a":1}', '{"a":2}'],), ([],)], "texts array<string>")
    got = [r.h for r in df.select(plan.alias("h")).collect()]
    assert got == [hashlib.sha256(x.encode()).hexdigest() for x in ('{"evidence":[{"a":1},{"a":2}]}', '{"evidence":[]}')]
