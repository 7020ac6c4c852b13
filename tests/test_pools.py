"""Queues, exports and samples of pools: what they come to, and how often they go through the table."""

from rankwell.operators import evaluation as E
from rankwell.operators import pooling as P
from rankwell.plans import registry

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exports_are_held_against_the_queue(spark):
    rows = [(1, 10, None), (1, 10, "B"), (1, 11, None), (1, 12, "B"), (1, 13, None), (1, 13, "B"), (1, 13, "SUPPLEMENT")]
    got = {r.passage: (r.origin, r.status) for r in P.merge_exports(spark.createDataFrame(rows, "qid long, passage long, origin string")).collect()}
    assert got == {10: ("B", "OK"), 11: (None, "MISSING"), 12: ("B", "UNKNOWN"), 13: ("B", "NOT_DISJOINT")}


def test_exports_are_merged_in_one_pass(spark):
    """The pool is made once: a list is a scan of the strategies with one stage and one of those with two."""
    assert plan(registry.QUERIES["ann05_merge_exports"](spark, SF)).count("Relation [") == 2


def test_damage_and_summaries_count_nothing_as_distinct(spark):
    for name in ("evl13_reranker_damage", "map03_evidence_summary"):
        assert "Expand" not in plan(registry.QUERIES[name](spark, SF)), name


def test_damage_by_hand(spark):
    pre = spark.createDataFrame([("s", 1, 7, 1), ("s", 1, 8, 2), ("s", 1, 7, 3), ("s", 1, 9, 4), ("s", 2, 5, 1)], "strategy string, qid long, passage long, rank int")
    post = spark.createDataFrame([("s", 1, 9, 1), ("s", 1, 8, 2), ("s", 1, 7, 3), ("s", 1, 7, 4), ("s", 2, 5, 1)], "strategy string, qid long, passage long, rank int")
    qrels = spark.createDataFrame([(1, 7, 2), (1, 9, 1), (1, 8, 0), (1, 6, 3)], "qid long, passage long, grade int")
    got = {r.qid: tuple(r)[2:] for r in E.reranker_damage(pre, post, qrels, 2).collect()}
    # 7 twice and 9 are relevant; 7 is lost, 9 comes up; three passages of the question are relevant
    assert got == {1: (3, 1, 1 / 3, 0.0), 2: (0, 0, 0.0, None)}


def test_a_pooled_pair_without_a_passage_is_not_outside(spark):
    e = spark.createDataFrame([(1, 4, None), (1, 4, 7), (2, 4, 8)], "qid long, chapter long, passage long")
    pool = spark.createDataFrame([(1, None), (2, 8)], "qid long, passage long")
    got = sorted((r.qid, r.passage or 0) for r in P.outside(e, pool).collect())
    assert got == [(1, 7), (1, 8), (2, 0), (2, 7)]
