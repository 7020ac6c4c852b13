"""Sessions from their log against a session that takes the events one by one."""

import random

from rankwell.operators import sessions

EVENTS = "annotator long, qid string, passage string, seq long, action string, version string, valid boolean, grade int"


def test_replay_equals_a_sequential_session(spark):
    r = random.Random(2)
    queue = [(a, q, p, f"v{a}") for a in (1, 2) for q in ("q1", "q2") for p in ("x", "y", "z")]
    events = [(r.choice([1, 2, 2, 3, None]), r.choice(["q1", "q2", "q3"]), r.choice("xyz"), i, r.choice(["SAVE", "SAVE", "UNLOCK", "DROP", None]), r.choice(["v1", "v2", None]), r.choice([True, True, False, None]), i) for i in range(800)]
    known, done, opened, want, first = {q[:3]: q[3] for q in queue}, {}, set(), {}, {}
    for a, q, p, seq, action, version, valid, _ in events:
        item = (a, q, p)
        if item not in known:
            want[seq] = "UNKNOWN_ITEM"
        elif version != known[item]:
            want[seq] = "STALE"
        elif action == "UNLOCK":
            want[seq] = "UNLOCKED"
            opened.add(item)
        elif action != "SAVE":
            want[seq] = "UNKNOWN_ACTION"
        elif not valid:
            want[seq] = "INVALID"
        elif item in done and item not in opened:
            want[seq] = "LOCKED"
        else:
            want[seq] = "SAVED"
            opened.discard(item)
            done[item] = (seq, done.get(item, (0, 0))[1] + 1)
            first.setdefault(item, seq)
    log, own = spark.createDataFrame(events, EVENTS), spark.createDataFrame([*queue, queue[0]], "annotator long, qid string, passage string, version string")
    judged = sessions.judge(log, own)
    assert {x.seq: x.status for x in judged.collect()} == want and set(want.values()) >= {"SAVED", "LOCKED", "STALE"}
    assert {(x.annotator, x.qid, x.passage): (x.seq, x.revision) for x in sessions.annotations(judged).collect()} == done
    steps = sorted((x.annotator, x.completed, x.seq, x.remaining, x.percent) for x in sessions.progress(judged, own).collect())
    want = []
    for a in (1, 2):
        order = sorted(s for i, s in first.items() if i[0] == a)
        want += [(a, n, s, 6 - n, round(n / 6 * 100, 1)) for n, s in enumerate(order, 1)]
    assert steps == want
    assert sessions.judge(log.limit(0), own).count() == 0
