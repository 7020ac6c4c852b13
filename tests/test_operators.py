"""Known answers and edge cases of the DataFrame operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from rankwell.functions import text as T
from rankwell.functions import vectors as V
from rankwell.operators import chunking, retrieval, trace
from rankwell.sources import checkpoints, files, sinks
from rankwell.streaming import quota


def test_sentences_keep_abbreviations(spark):
    df = spark.createDataFrame([("O Dr. Silva chegou. Ele viu a Fig. 2! Fim?",), ("",), ("Art.",)], "t string")
    got = [r[0] for r in df.select(T.sentences(F.col("t"))).collect()]
    assert got == [["O Dr. Silva chegou.", "Ele viu a Fig. 2!", "Fim?"], [], ["Art."]]


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_top_k_ties_and_empty(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id long, vector array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "id long, vector array<double>")
    assert [(r.item_id, r.rank) for r in retrieval.top_k(q, items, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert retrieval.top_k(q, items, 0).count() == 0
    assert retrieval.top_k(q.limit(0), items, 3).count() == 0


def test_window_dedup_is_greedy(spark):
    run = spark.createDataFrame([(1, 1, "a", 5), (1, 2, "a", 7), (1, 3, "a", 9), (1, 4, "b", 6)], "query_id long, rank int, page string, sentence int")
    assert [(r.page, r.sentence) for r in retrieval.window_dedup(run, 3, 3).orderBy("rank").collect()] == [("a", 5), ("a", 9), ("b", 6)]


def test_auto_merge_threshold(spark):
    tree = spark.createDataFrame([(f"l{i}", "p0" if i < 4 else "p1") for i in range(8)], "node_id string, parent_id string")
    run = spark.createDataFrame([(1, "l0", 0.9), (1, "l1", 0.7), (1, "l4", 0.5)], "query_id long, node_id string, score double")
    got = {r.node_id: round(r.score, 6) for r in retrieval.auto_merge(run, tree).collect()}
    assert got == {"p0": 0.8, "l4": 0.5}
    assert {r.node_id for r in retrieval.auto_merge(run, tree, 1.1).collect()} == {"l0", "l1", "l4"}


def test_anchors_are_those_of_windows(spark):
    pages = spark.createDataFrame([("d", 1, "A b. C d. E f.")], "document_id string, page_number int, text string")
    a = {(r.sentence_index, r.text) for r in chunking.sentence_anchors(pages).collect()}
    w = {(r.sentence_index, r.anchor_text) for r in chunking.sentence_windows(pages, 1).collect()}
    assert a == w and len(a) == 3


def test_admission_counts_admitted_only(spark):
    t0 = datetime.datetime(2024, 1, 1)
    e = spark.createDataFrame([(i, 1, t0 + datetime.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 9, 10, 11])], "event_id long, user_id long, ts timestamp")
    got = [r.admitted for r in quota.admitted(e, 2, 10).orderBy("event_id").collect()]
    assert got == [True, True, False, False, True, True]


def test_admission_of_a_hot_user(spark):
    """A user of half the events, with silences of just under, exactly and just over a window; null users and times are left out."""
    import random

    r, t0, rows, at = random.Random(3), datetime.datetime(2024, 1, 1), [], 0
    for i in range(3000):
        at += r.choice([0, 1, 2, 5, 9_999_999, 10_000_000, 10_000_001, 11_250_000, 12_500_000]) if i % 3 == 0 else r.randrange(900_000)
        rows.append((i, 1 if i % 2 else r.randrange(2, 40), t0 + datetime.timedelta(microseconds=at)))
    kind = "event_id long, user_id long, ts timestamp"
    df = spark.createDataFrame([*rows, (-1, None, t0), (-2, 1, None)], kind)
    got = {x.event_id: x.admitted for x in quota.admitted(df, 3, 10).collect()}
    want, held = {}, {}
    for i, u, t in sorted(rows, key=lambda x: (x[1], x[2], x[0])):
        own = held[u] = [h for h in held.get(u, []) if (t - h).total_seconds() < 10]
        want[i] = len(own) < 3
        if want[i]:
            own.append(t)
    assert got == want
    us = df.where("user_id = 1 and ts is not null").select("user_id", F.unix_micros("ts").alias("us"))
    parts = quota.stretches(us, 10_000_000).groupBy("stretch").count().collect()
    assert len(parts) > 50 and quota.admitted(df.limit(0), 3, 10).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"qid": "a", "question": "x?"}\n{"question_id": "b", "query": ""}\n{"qid": "a", "query": "y"}\n')
    q = {(r.qid, r.is_empty, r.is_duplicate) for r in files.read_questions(spark, str(tmp_path / "q.json")).collect()}
    assert q == {("a", False, True), ("b", True, False)}
    (tmp_path / "r.json").write_text('{"question_id": "q_holdout", "passage_id": "ps_1", "grade": 2}\n')
    with pytest.raises(ValueError):
        files.read_qrels(spark, str(tmp_path / "r.json"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    state = lambda frame: {r.status: r.n for r in sinks.append_ledger(frame, str(tmp_path / "ledger"), ["id"]).collect()}
    assert state(df) == {"APPENDED": 2}
    assert state(df) == {"CONFLICT_WITH_LEDGER": 2}
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 2


def test_sealed_state():
    text = checkpoints.seal({"b": 1, "a": "é"})
    assert checkpoints.unseal(text) == {"a": "é", "b": 1}
    for bad in ("{", "{}", text.replace(": 1", ": 2")):
        with pytest.raises(checkpoints.Corrupt):
            checkpoints.unseal(bad)
    with pytest.raises(ValueError):
        checkpoints.run_folder("/x", "../y")


def test_rows_resume(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "F0", 1), ("q2", "F0", 2)], "query_id string, strategy string, n int")
    path = str(tmp_path / "rows")
    checkpoints.append_rows(rows.where("n = 1"), path)
    done = checkpoints.finished(rows.schema, spark, path)
    assert [r.query_id for r in checkpoints.remaining(rows, done).collect()] == ["q2"]
    checkpoints.append_rows(rows, path)
    assert sorted(r.n for r in checkpoints.finished(rows.schema, spark, path).collect()) == [1, 2]


def test_ratios_of_nothing(spark):
    tree = spark.createDataFrame([("a", "p", 0, False), ("b", "p", 0, False), ("c", "p", 0, False)], "node_id string, parent_id string, tokens long, relevant boolean")
    run = spark.createDataFrame([(1, "a")], "query_id long, node_id string")
    r = trace.trace_ratios(trace.merge_decisions(run, tree)).first()
    assert (r.merges_performed, r.merges_refused, r.context_expansion_ratio, r.preservation, r.loss) == (0, 1, 1.0, 1.0, 0.0)
