"""Evaluation queries; their twins use lists, correlated subqueries and other joins than the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.functions import text as T
from rankwell.operators import evaluation as E
from rankwell.plans import base as B
from rankwell.plans.base import ASKS_SQL, BASE_SQL, METRIC_SQL, QRELS_SQL, RATERS_SQL, RUN_SQL, read, register

#: Which passages have a canonical id.
KNOWN = "passage % 10 <> 9"


def metric(spark, d):
    return E.recall_at_k(B.run(spark, d), B.qrels(spark, d), 3)


def _round(df, *cols, to=6):
    return df.select(*[F.round(c, to).alias(c) if c in cols else c for c in df.columns])


@register("evl01_recall_at_k", f"WITH {METRIC_SQL} SELECT strategy, qid, round(recall, 6) AS recall, round(rr, 6) AS rr FROM metric")
def evl01(spark, d):
    return _round(metric(spark, d), "recall", "rr")


@register("evl02_reciprocal_rank", f"""WITH {BASE_SQL}, f AS (SELECT strategy, qid, passage, min(rank) AS rank FROM run GROUP BY ALL), p AS (SELECT *, rank() OVER (PARTITION BY strategy, qid ORDER BY rank) AS pos FROM f)
SELECT strategy, p.qid, round(coalesce(max(CASE WHEN grade >= 1 THEN 1.0::DOUBLE / pos END), 0), 6) AS rr FROM p LEFT JOIN qrels q ON q.qid = p.qid AND q.passage = p.passage GROUP BY ALL""")
def evl02(spark, d):
    whole = E.recall_at_k(B.run(spark, d), B.qrels(spark, d), 1 << 30)
    return _round(whole.select("strategy", "qid", "rr"), "rr")


@register("evl03_mrr", f"""WITH {METRIC_SQL}, skipped AS (SELECT strategy, round(avg(rr), 6) AS mrr, count(*) AS n FROM metric WHERE qid IN (SELECT qid FROM gold) GROUP BY strategy)
SELECT m.strategy, round(sum(rr) / count(rr), 6) AS mrr_zero, count(*) AS n_zero, any_value(s.mrr) AS mrr_skip, any_value(s.n) AS n_skip FROM metric m LEFT JOIN skipped s ON s.strategy = m.strategy GROUP BY m.strategy""")
def evl03(spark, d):
    # both policies for questions without relevant passages, in one pass
    own, some = metric(spark, d), F.when(F.col("recall").isNotNull(), F.col("rr"))
    return own.groupBy("strategy").agg(F.round(F.avg("rr"), 6).alias("mrr_zero"), F.count("*").alias("n_zero"), F.round(F.avg(some), 6).alias("mrr_skip"), F.count(some).alias("n_skip"))


@register("evl04_passage_recall", f"""WITH {BASE_SQL}, asked AS (SELECT DISTINCT strategy, qid FROM run)
SELECT strategy, qid, round((SELECT count(DISTINCT r.passage) FROM run r WHERE r.strategy = a.strategy AND r.qid = a.qid AND r.rank <= 5 AND EXISTS (SELECT 1 FROM qrels q WHERE q.qid = r.qid AND q.passage = r.passage AND q.grade > 0))::DOUBLE
  / nullif((SELECT count(*) FROM qrels q WHERE q.qid = a.qid AND q.grade > 0), 0), 6) AS recall,
  CASE WHEN EXISTS (SELECT 1 FROM qrels q WHERE q.qid = a.qid AND q.grade > 0) THEN 'COMPUTED' ELSE 'NOT_COMPUTABLE_NO_GOLD' END AS status FROM asked a""")
def evl04(spark, d):
    return _round(E.passage_recall(B.run(spark, d), B.qrels(spark, d), 5), "recall")


@register("evl05_mrr_no_cut", f"WITH {BASE_SQL}, h AS (SELECT strategy, qid, rank FROM run JOIN qrels USING (qid, passage) WHERE grade >= 1) SELECT a.strategy, a.qid, round(coalesce((SELECT max(1.0::DOUBLE / rank) FROM h WHERE h.strategy = a.strategy AND h.qid = a.qid), 0), 6) AS rr FROM (SELECT DISTINCT strategy, qid FROM run) a")
def evl05(spark, d):
    return _round(E.uncut_rr(B.run(spark, d), B.qrels(spark, d)), "rr")


IDEAL_SQL = "ideal AS (SELECT qid, list(grade ORDER BY grade DESC)[:3] AS g FROM qrels GROUP BY qid), idcg AS (SELECT qid, list_sum([(2 ** g[i] - 1) / log2(i + 1) for i in range(1, len(g) + 1)]) AS idcg FROM ideal)"


@register("evl06_ndcg", f"""WITH {BASE_SQL}, {IDEAL_SQL}, got AS (SELECT strategy, r.qid, list(coalesce(grade, 0) ORDER BY rank) AS g FROM run r LEFT JOIN qrels q ON q.qid = r.qid AND q.passage = r.passage WHERE rank <= 3 GROUP BY ALL)
SELECT strategy, qid, round(CASE WHEN idcg > 0 THEN list_sum([(2 ** g[i] - 1) / log2(i + 1) for i in range(1, len(g) + 1)]) / idcg ELSE 0 END, 4) AS ndcg FROM got LEFT JOIN idcg USING (qid)""")
def evl06(spark, d):
    return _round(E.ndcg(B.run(spark, d), B.qrels(spark, d), 3), "ndcg", to=4)


def _cited(spark, d):
    """Citations of the first and third result, and of one passage outside the list for every fifth question."""
    inside = B.run(spark, d).where("rank in (1, 3)").select("strategy", "qid", "passage")
    outside = B.run(spark, d).where("rank = 1 and qid % 5 = 0").select("strategy", "qid", (-F.col("passage")).alias("passage"))
    return inside.unionByName(outside)


CITED_SQL = "cited AS (SELECT strategy, qid, passage FROM run WHERE rank = 1 OR rank = 3 UNION ALL SELECT strategy, qid, -passage FROM run WHERE rank = 1 AND qid % 5 = 0)"


@register("evl07_citations", f"""WITH {BASE_SQL}, {CITED_SQL}, {B.GOLD_SQL}, h AS (SELECT c.*, EXISTS (SELECT 1 FROM qrels q WHERE q.qid = c.qid AND q.passage = c.passage AND q.grade >= 1) AS ok FROM cited c)
SELECT strategy, h.qid, round(count_if(ok)::DOUBLE / count(*), 6) AS precision_, round(count_if(ok)::DOUBLE / any_value(n_rel), 6) AS recall FROM h LEFT JOIN gold USING (qid) GROUP BY ALL""")
def evl07(spark, d):
    return _round(E.citation_scores(_cited(spark, d), B.run(spark, d), B.qrels(spark, d)), "precision", "recall").withColumnRenamed("precision", "precision_")


@register("evl08_not_computable", f"WITH {RUN_SQL} SELECT strategy, qid, m.metric, CAST(NULL AS DOUBLE) AS value, 'NOT_COMPUTABLE_' || m.why AS status FROM (SELECT strategy, qid FROM run GROUP BY ALL) a, (VALUES ('factual_correctness', 'MISSING_GOLD_ANSWER'), ('nugget_recall', 'MISSING_NUGGETS')) AS m(metric, why)")
def evl08(spark, d):
    # metrics whose inputs the data never has: a constant status, never a zero
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(s).alias("status")) for m, s in (("factual_correctness", "NOT_COMPUTABLE_MISSING_GOLD_ANSWER"), ("nugget_recall", "NOT_COMPUTABLE_MISSING_NUGGETS"))])).alias("m")
    return B.run(spark, d).select("strategy", "qid").distinct().select("strategy", "qid", kinds).select("strategy", "qid", "m.metric", F.lit(None).cast("double").alias("value"), "m.status")


@register("evl09_page_metrics", f"""WITH {BASE_SQL}, {CITED_SQL}, {B.GOLD_SQL}, o AS (SELECT strategy, qid, list(passage ORDER BY rank) AS p FROM run GROUP BY ALL), u AS (SELECT strategy, qid, list_filter(p, lambda x, i: list_position(p, x) = i) AS p FROM o),
g AS (SELECT qid, list(passage) AS ids FROM qrels WHERE grade >= 1 GROUP BY qid), c AS (SELECT strategy, qid, list(passage) AS c FROM cited GROUP BY ALL),
w AS (SELECT u.strategy, u.qid, p, coalesce(ids, []) AS ids, coalesce(c, []) AS c FROM u LEFT JOIN g USING (qid) LEFT JOIN c ON c.strategy = u.strategy AND c.qid = u.qid)
SELECT strategy, qid, len(list_intersect(p, ids)) > 0 AS hit, round(coalesce(1.0::DOUBLE / list_min(list_filter([list_position(p, x) for x in ids], lambda x: x IS NOT NULL)), 0), 6) AS page_mrr,
  round(CASE WHEN c = [] THEN 1 ELSE len(list_filter(c, lambda x: list_contains(ids, x)))::DOUBLE / len(c) END, 6) AS page_precision, round(CASE WHEN ids = [] THEN 1 ELSE len(list_distinct(list_intersect(c, ids)))::DOUBLE / len(ids) END, 6) AS page_recall FROM w""")
def evl09(spark, d):
    return _round(E.page_metrics(B.run(spark, d), _cited(spark, d), B.qrels(spark, d)), "page_mrr", "page_precision", "page_recall")


@register("evl10_abstention_matrix", "SELECT doc_id, CASE quality * 2 + toxic WHEN 2 THEN 'CORRECT_ANSWER' WHEN 3 THEN 'FALSE_ABSTENTION' WHEN 1 THEN 'CORRECT_ABSTENTION' WHEN 0 THEN 'FALSE_ANSWER' END AS category, quality <> toxic AS correct FROM labels")
def evl10(spark, d):
    # a label of good quality stands for an answerable question, a toxic one for an abstention
    c = E.abstention_category(F.col("quality") == 1, F.col("toxic") == 1)
    return read(spark, d, "labels").select("doc_id", c.alias("category")).withColumn("correct", F.col("category").startswith("CORRECT"))


HUMAN_SQL = f"""{BASE_SQL}, {IDEAL_SQL.replace("[:3]", "[:5]")}, {B.GOLD_SQL}, top AS (SELECT strategy, qid, list(passage ORDER BY rank) AS p FROM run WHERE rank <= 5 GROUP BY ALL),
v AS (SELECT strategy, qid, list_filter(p, lambda x: x % 10 <> 9) AS p, len(p) AS n FROM top), e AS (SELECT strategy, qid, n, len(p) AS live, unnest(p) AS passage, unnest(range(1, len(p) + 1)) AS pos FROM v),
j AS (SELECT e.*, grade FROM e LEFT JOIN qrels q ON q.qid = e.qid AND q.passage = e.passage),
s AS (SELECT strategy, qid, count_if(grade IS NULL) AS unjudged, count_if(grade >= 1) AS hits, count(grade) AS judged, count_if(grade = 0) AS fp, min(pos) FILTER (grade >= 1) AS best, sum((2 ** coalesce(grade, 0) - 1) / log2(pos + 1)) AS dcg FROM j GROUP BY ALL),
human AS (SELECT v.strategy, v.qid, CASE WHEN n_rel IS NULL THEN 'NOT_APPLICABLE' ELSE 'COMPUTED' END AS status, coalesce(hits, 0)::DOUBLE / n_rel AS recall, CASE WHEN n_rel IS NOT NULL THEN coalesce(1.0::DOUBLE / best, 0) END AS mrr,
  CASE WHEN n_rel IS NOT NULL AND idcg > 0 THEN coalesce(dcg, 0) / idcg END AS ndcg, coalesce(unjudged, 0) AS unjudged, n - len(p) AS unresolved, len(p) AS retrieved, coalesce(judged, 0) AS judged, coalesce(fp, 0) AS false_positives, coalesce(hits, 0) AS hits,
  CASE WHEN len(p) > 0 THEN coalesce(judged, 0)::DOUBLE / len(p) END AS coverage FROM v LEFT JOIN s ON s.strategy = v.strategy AND s.qid = v.qid LEFT JOIN gold ON gold.qid = v.qid LEFT JOIN idcg ON idcg.qid = v.qid)"""


def human(spark, d):
    return E.human_metrics(B.run(spark, d), B.qrels(spark, d), 5, F.expr(KNOWN))


@register("evl11_human_qrels", f"WITH {HUMAN_SQL} SELECT strategy, qid, status, round(recall, 4) AS recall, round(mrr, 4) AS mrr, round(ndcg, 4) AS ndcg, unjudged, unresolved FROM human")
def evl11(spark, d):
    return _round(human(spark, d).select("strategy", "qid", "status", "recall", "mrr", "ndcg", "unjudged", "unresolved"), "recall", "mrr", "ndcg", to=4)


@register("evl12_judged_coverage", f"WITH {HUMAN_SQL} SELECT strategy, qid, round(coverage, 4) AS coverage, false_positives FROM human")
def evl12(spark, d):
    return _round(human(spark, d).select("strategy", "qid", "coverage", "false_positives"), "coverage", to=4)


def reranked(run):
    """run in the order of a second stage: by passage number, ties by the old rank."""
    from pyspark.sql import Window

    by = Window.partitionBy("qid", "strategy").orderBy("passage", F.col("rank"))
    return run.withColumn("pre_rank", F.col("rank")).withColumn("rank", F.row_number().over(by))


POST_SQL = "post AS (SELECT strategy, qid, chapter, passage, score, rank AS pre_rank, row_number() OVER (PARTITION BY strategy, qid ORDER BY passage, rank) AS rank FROM run)"


@register("evl13_reranker_damage", f"""WITH {BASE_SQL}, {POST_SQL}, {B.GOLD_SQL}, good AS (SELECT strategy, r.qid, r.passage, r.rank FROM run r SEMI JOIN (SELECT * FROM qrels WHERE grade >= 1) q ON q.qid = r.qid AND q.passage = r.passage),
kept AS (SELECT DISTINCT strategy, qid, passage FROM post WHERE rank <= 3), lost AS (SELECT strategy, qid, count(*) AS n FROM (SELECT DISTINCT strategy, qid, passage FROM good EXCEPT SELECT * FROM kept) GROUP BY ALL),
a AS (SELECT strategy, qid, count(*) AS pre_relevant, count(DISTINCT passage) FILTER (rank <= 3) AS before FROM good GROUP BY ALL), h AS (SELECT strategy, k.qid, count(*) AS after FROM kept k SEMI JOIN good g ON g.strategy = k.strategy AND g.qid = k.qid AND g.passage = k.passage GROUP BY ALL)
SELECT s.strategy, s.qid, coalesce(pre_relevant, 0) AS pre_relevant, coalesce(lost.n, 0) AS dropped, round(coalesce(lost.n::DOUBLE / pre_relevant, 0), 4) AS dropped_rate, round((coalesce(after, 0) - coalesce(before, 0))::DOUBLE / n_rel, 4) AS delta_recall
FROM (SELECT DISTINCT strategy, qid FROM run) s LEFT JOIN a USING (strategy, qid) LEFT JOIN lost USING (strategy, qid) LEFT JOIN h USING (strategy, qid) LEFT JOIN gold USING (qid)""")
def evl13(spark, d):
    run = B.run(spark, d)
    return _round(E.reranker_damage(run, reranked(run), B.qrels(spark, d), 3), "dropped_rate", "delta_recall", to=4)


@register("evl14_page_damage", f"""WITH {BASE_SQL}, {POST_SQL}, l AS (SELECT strategy, qid, list(passage ORDER BY rank) AS pre FROM run GROUP BY ALL), t AS (SELECT strategy, qid, list(passage) AS post FROM post WHERE rank <= 3 GROUP BY ALL),
g AS (SELECT qid, list(passage) AS ids FROM qrels WHERE grade >= 1 GROUP BY qid),
w AS (SELECT l.strategy, l.qid, pre, post, coalesce(ids, []) AS ids, len(list_filter(pre[:3], lambda x: list_contains(ids, x))) AS a, len(list_filter(post, lambda x: list_contains(ids, x))) AS b, list_filter(pre, lambda x: NOT list_contains(post, x)) AS gone FROM l JOIN t USING (strategy, qid) LEFT JOIN g USING (qid)),
c AS (SELECT *, CASE WHEN ids = [] THEN 0 ELSE a::DOUBLE / len(ids) END AS rp, CASE WHEN ids = [] THEN 0 ELSE b::DOUBLE / len(ids) END AS ra, len(list_filter(gone, lambda x: list_contains(ids, x))) AS lost, len(list_filter(pre, lambda x: list_contains(ids, x))) AS rel FROM w)
SELECT strategy, qid, round(rp, 6) AS recall_pre, round(ra, 6) AS recall_post, round(ra - rp, 6) AS delta_recall, len(gone) AS dropped, lost, round(CASE WHEN rel > 0 THEN lost::DOUBLE / rel ELSE 0 END, 4) AS dropped_rate FROM c""")
def evl14(spark, d):
    run = B.run(spark, d)
    out = E.page_damage(run, reranked(run), B.qrels(spark, d), 3)
    return _round(_round(out, "recall_pre", "recall_post", "delta_recall"), "dropped_rate", to=4)


@register("evl15_capped_recall", f"""WITH {BASE_SQL}, {B.GOLD_SQL}, r3 AS (SELECT strategy, r.qid, r.rank, coalesce(q.grade, 0) >= 1 AS ok FROM run r LEFT JOIN qrels q USING (qid, passage) WHERE rank <= 3)
SELECT strategy, qid, round(least(1, coalesce(count_if(ok)::DOUBLE / any_value(n_rel), 0)), 6) AS recall, bool_or(ok) AS hit, round(coalesce(1.0::DOUBLE / min(rank) FILTER (ok), 0), 6) AS rr FROM r3 LEFT JOIN gold USING (qid) GROUP BY strategy, qid""")
def evl15(spark, d):
    return _round(E.capped_recall(B.run(spark, d), B.qrels(spark, d), 3), "recall", "rr")


@register("evl16_single_page", f"""WITH {BASE_SQL}, t AS (SELECT qid, min(passage) AS target FROM qrels WHERE grade = 3 GROUP BY qid), p AS (SELECT strategy, qid, list(passage ORDER BY rank) AS p FROM run WHERE rank <= 3 GROUP BY ALL)
SELECT strategy, qid, list_contains(p, target) AS hit, list_contains(p, target)::INT::DOUBLE AS recall, round(coalesce(1.0::DOUBLE / nullif(list_position(p, target), 0), 0), 6) AS rr, round(CASE WHEN list_contains(p, target) THEN 1.0::DOUBLE / 3 ELSE 0 END, 6) AS precision_ FROM p JOIN t USING (qid)""")
def evl16(spark, d):
    target = B.qrels(spark, d).where("grade = 3").groupBy("qid").agg(F.min("passage").alias("target"))
    return _round(E.single_page(B.run(spark, d), target, 3), "rr", "precision").withColumnRenamed("precision", "precision_")


@register("evl17_abstention_correct", """SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'NOT_APPLICABLE' ELSE 'COMPUTED' END AS status, CASE quality * 2 + toxic WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN NULL ELSE 0.0::DOUBLE END AS score,
CASE quality * 2 + toxic WHEN 0 THEN 'FAILED_TO_ABSTAIN_ON_UNANSWERABLE' WHEN 1 THEN 'CORRECT_ABSTENTION' WHEN 2 THEN 'SUBSTANTIVE_ANSWER_NOT_ABSTENTION_QUESTION' ELSE 'INCORRECT_ABSTENTION_ON_ANSWERABLE' END AS reason FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def evl17(spark, d):
    status, score, reason = E.abstention_correctness(F.col("quality") == 0, F.col("toxic") == 1)
    return read(spark, d, "labels").where("quality is not null and toxic is not null").select("doc_id", status.alias("status"), score.alias("score"), reason.alias("reason"))


_TOK = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda x: length(x) > 3))"
TRIAD_SQL = f"""{ASKS_SQL}, t AS (SELECT *, {_TOK.format('question')} AS qt, {_TOK.format('answer')} AS wt, length(answer) < 30 AS abstained, length(question) < 25 AS bare, conv_id % 17 = 0 AS broken FROM asks),
e AS (SELECT conv_id, turn, 'context_relevance' AS metric, bare AS na, 'NO_EVIDENCE' AS why, broken, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(qt, wt))::DOUBLE / len(qt) END AS s FROM t
 UNION ALL SELECT conv_id, turn, 'groundedness', abstained OR bare, CASE WHEN abstained THEN 'ANSWER_ABSTAINED' ELSE 'NO_EVIDENCE' END, broken, CASE WHEN len(wt) = 0 THEN 0 ELSE len(list_intersect(qt, wt))::DOUBLE / len(wt) END FROM t
 UNION ALL SELECT conv_id, turn, 'answer_relevance', abstained, 'ANSWER_ABSTAINED', broken, CASE WHEN len(qt) = 0 THEN 0 ELSE len(list_filter(qt, lambda x: contains(lower(answer), x)))::DOUBLE / len(qt) END FROM t)"""


@register("evl19_typed_triad", f"WITH {TRIAD_SQL} SELECT conv_id, turn, metric, CASE WHEN na THEN 'NOT_APPLICABLE' WHEN broken THEN 'FAILED' ELSE 'COMPUTED' END AS status, CASE WHEN NOT na AND NOT broken THEN round(s, 4) END AS score, CASE WHEN na THEN why WHEN broken THEN repeat('judge failed ', 15) || 'judge' ELSE '' END AS reason FROM e")
def evl19(spark, d):
    """Typed entries of three metrics; every 17th conversation's judge fails with a long message."""
    q, a = T.tokens(F.col("question")), T.tokens(F.col("answer"))
    t = B.asks(spark, d).select("conv_id", "turn", q.alias("qt"), a.alias("at"), F.lower("answer").alias("low"), (F.length("answer") < 30).alias("abstained"), (F.length("question") < 25).alias("bare"))
    error = F.when(F.col("conv_id") % 17 == 0, F.repeat(F.lit("judge failed "), F.lit(40)))
    both = F.size(F.array_intersect("qt", "at"))
    zero = lambda n, of: F.when(F.size(of) == 0, 0.0).otherwise(n / F.size(of))
    no_answer, no_evidence = F.when(F.col("abstained"), "ANSWER_ABSTAINED"), F.when(F.col("bare"), "NO_EVIDENCE")
    entries = [
        ("context_relevance", no_evidence, zero(both, "qt")), ("groundedness", F.coalesce(no_answer, no_evidence), zero(both, "at")),
        ("answer_relevance", no_answer, zero(F.size(F.filter("qt", lambda x: F.contains(F.col("low"), x))), "qt")),
    ]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), typed(why, error, s).alias("e")) for m, why, s in entries])
    return t.select("conv_id", "turn", F.explode(rows).alias("r")).select("conv_id", "turn", "r.metric", "r.e.status", F.round("r.e.score", 4).alias("score"), "r.e.reason")


def typed(na, error, score):
    """status, score, reason of a metric: not applicable for a reason, failed with (200 characters of) a message, or computed."""
    status = F.when(na.isNotNull(), "NOT_APPLICABLE").when(error.isNotNull(), "FAILED").otherwise("COMPUTED")
    return F.struct(status.alias("status"), F.when(status == "COMPUTED", score).alias("score"), F.coalesce(na, F.substring(error, 1, 200), F.lit("")).alias("reason"))


@register("evl20_call_ledger", """WITH c AS (SELECT user_id, event_type = 'error' AS retry, value < 60 AS ok, CASE WHEN value < 10 THEN 'QUOTA' WHEN value < 30 THEN 'SERVER' ELSE 'TIMEOUT' END AS cause FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL)
SELECT user_id, count(*) AS physical, sum(CASE WHEN retry THEN 0 ELSE 1 END)::BIGINT AS logical, sum(retry::INT)::BIGINT AS retries, sum(ok::INT)::BIGINT AS success, sum((NOT ok)::INT)::BIGINT AS failed, sum((retry AND cause = 'QUOTA')::INT)::BIGINT AS quota, sum((retry AND cause = 'SERVER')::INT)::BIGINT AS server,
sum((retry AND cause = 'TIMEOUT')::INT)::BIGINT AS timeout, true AS balanced FROM c GROUP BY user_id""")
def evl20(spark, d):
    """Calls of each user: an error event is a retry, its value tells the cause; the invariants are recomputed."""
    retry, v = F.col("event_type") == "error", F.col("value")
    e = read(spark, d, "events").where("value is not null and event_type is not null")
    c = e.groupBy("user_id").agg(
        F.count("*").alias("physical"), F.count_if(~retry).alias("logical"), F.count_if(retry).alias("retries"), F.count_if(v < 60).alias("success"), F.count_if(v >= 60).alias("failed"),
        F.count_if(retry & (v < 10)).alias("quota"), F.count_if(retry & (v >= 10) & (v < 30)).alias("server"), F.count_if(retry & (v >= 30)).alias("timeout"),
    )
    balanced = (F.col("physical") == F.col("logical") + F.col("retries")) & (F.col("physical") == F.col("success") + F.col("failed")) & (F.col("quota") + F.col("server") + F.col("timeout") == F.col("retries"))
    return c.withColumn("balanced", balanced)


@register("evl21_grade_distribution", f"WITH {QRELS_SQL} SELECT g AS grade, (SELECT count(*) FROM qrels WHERE grade = g) AS n, (SELECT count(DISTINCT qid) FROM qrels WHERE grade = g) AS queries, (2 ** g - 1)::DOUBLE AS gain, g >= 1 AS relevant FROM range(0, 4) AS r(g)")
def evl21(spark, d):
    # grades nobody gave have a row too
    n = B.qrels(spark, d).groupBy("grade").agg(F.count("*").alias("n"), F.count_distinct("qid").alias("queries"))
    g = spark.range(4).select(F.col("id").cast("int").alias("grade"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return g.join(n, "grade", "left").select(F.col("grade").cast("long").alias("grade"), zero("n"), zero("queries"), (F.pow(F.lit(2.0), "grade") - 1).alias("gain"), (F.col("grade") >= 1).alias("relevant"))


@register("evl22_abstention_question", f"WITH {BASE_SQL} SELECT qid, NOT EXISTS (SELECT 1 FROM qrels q WHERE q.qid = a.qid AND q.grade <> 0) AND EXISTS (SELECT 1 FROM qrels q WHERE q.qid = a.qid) AS is_abstention FROM (SELECT DISTINCT qid FROM run) a")
def evl22(spark, d):
    all_zero = B.qrels(spark, d).groupBy("qid").agg(F.every(F.col("grade") == 0).alias("zero"))
    return B.run(spark, d).select("qid").distinct().join(all_zero, "qid", "left").select("qid", F.coalesce("zero", F.lit(False)).alias("is_abstention"))


@register("evl23_split_means", f"WITH {METRIC_SQL} SELECT strategy, s AS split, round(sum(recall) / count(recall), 4) AS mean_recall, count(recall) AS n FROM metric, (VALUES ('development', 0, 0), ('test', 1, 3)) AS v(s, lo, hi) WHERE qid % 4 BETWEEN lo AND hi GROUP BY ALL")
def evl23(spark, d):
    return metric(spark, d).groupBy("strategy", F.when(F.col("qid") % 4 == 0, "development").otherwise("test").alias("split")).agg(F.round(F.avg("recall"), 4).alias("mean_recall"), F.count("recall").alias("n"))


@register("evl24_summary", f"WITH {METRIC_SQL} SELECT strategy, round(avg(coalesce(recall, 0)), 4) AS recall, round(avg(rr), 4) AS mrr, round(count_if(rr > 0)::DOUBLE / count(*), 4) AS hit_rate, count(*) AS n FROM metric GROUP BY strategy")
def evl24(spark, d):
    m = E.recall_at_k(B.run(spark, d), B.qrels(spark, d), 3, empty_is_zero=True)
    return m.groupBy("strategy").agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("mrr"), F.round(F.avg((F.col("rr") > 0).cast("double")), 4).alias("hit_rate"), F.count("*").alias("n"))


@register("evl25_describe", f"""WITH {METRIC_SQL}, l AS (SELECT strategy, list(recall ORDER BY recall) FILTER (recall IS NOT NULL) AS v FROM metric GROUP BY strategy)
SELECT strategy, round(list_avg(v), 4) AS mean, round((v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2, 4) AS median, round(CASE WHEN len(v) = 1 THEN 0 ELSE sqrt(list_sum([power(x - list_avg(v), 2) for x in v]) / (len(v) - 1)) END, 4) AS std, round(v[1], 4) AS least, round(v[-1], 4) AS most, len(v) AS n FROM l""")
def evl25(spark, d):
    return _round(E.describe(metric(spark, d), ["strategy"], "recall"), "mean", "median", "std", "least", "most", to=4)


MOST = ["ndcg", "recall", "mrr", "coverage"]


def answered(spark, d):
    """human metrics of each list with answerable, abstained and groundedness (null for abstentions)."""
    best = B.run(spark, d).groupBy("strategy", "qid").agg(((F.count("*") < 2) | (F.max("score") < 60000)).alias("abstained"))
    h = human(spark, d).join(best, ["strategy", "qid"])
    return h.withColumn("answerable", F.col("status") == "COMPUTED").withColumn("groundedness", F.when(~F.col("abstained") & (F.col("retrieved") > 0), F.col("hits") / F.col("retrieved")))


ANSWERED_SQL = f"""{HUMAN_SQL}, ab AS (SELECT strategy, qid, count(*) < 2 OR max(score) < 60000 AS abstained FROM run GROUP BY ALL),
answered AS (SELECT h.*, abstained, status = 'COMPUTED' AS answerable, CASE WHEN NOT abstained AND retrieved > 0 THEN hits::DOUBLE / retrieved END AS groundedness FROM human h JOIN ab ON ab.strategy = h.strategy AND ab.qid = h.qid)"""


@register("evl26_strategy_summary", f"""WITH {ANSWERED_SQL}, a AS (SELECT * FROM answered WHERE answerable), neg AS (SELECT strategy, count(*) AS n, count_if(abstained) AS ab FROM answered WHERE NOT answerable GROUP BY strategy),
every AS (SELECT strategy, count(*) AS total, count_if(NOT abstained) AS produced, count_if(abstained) AS abstentions, round(avg(groundedness), 4) AS g, count(groundedness) AS gn FROM answered GROUP BY strategy)
SELECT a.strategy, any_value(total) AS total, count(*) AS answerable, {', '.join(f"round(avg({m}), 4) AS {m}_mean, round(median({m}), 4) AS {m}_median, round(CASE WHEN count({m}) = 1 THEN 0 ELSE stddev_samp({m}) END, 4) AS {m}_std, count({m}) AS {m}_n" for m in MOST)},
sum(retrieved)::BIGINT AS retrieved, sum(judged)::BIGINT AS judged, sum(unresolved)::BIGINT AS unresolved, round(count_if(hits > 0)::DOUBLE / count(*), 4) AS with_relevant, any_value(produced) AS produced, any_value(abstentions) AS abstentions,
any_value(g) AS groundedness, any_value(gn) AS groundedness_n, count_if(NOT abstained) AS answers_on_answerable, round(count_if(NOT abstained)::DOUBLE / count(*), 4) AS answer_coverage, round(count_if(abstained)::DOUBLE / count(*), 4) AS abstention_rate,
coalesce(any_value(neg.ab), 0) AS correct_abstentions, coalesce(any_value(neg.n - neg.ab), 0) AS wrong_answers, round(coalesce(any_value(neg.ab), 0)::DOUBLE / nullif(count_if(abstained) + coalesce(any_value(neg.n), 0), 0), 4) AS correctness_mean,
count_if(abstained) + coalesce(any_value(neg.n), 0) AS n_valid, count_if(NOT abstained) AS n_not_applicable FROM a JOIN every USING (strategy) LEFT JOIN neg USING (strategy) GROUP BY a.strategy""")
def evl26(spark, d):
    """All aggregates of a strategy in one pass: ranking over answerable questions, abstention over all."""
    a, ab = F.col("answerable"), F.col("abstained")
    n_a = F.count_if(a)
    own = lambda c: F.when(a, F.col(c))
    stats = []
    for m in MOST:
        v = own(m)
        std = F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v))
        stats += [F.round(F.avg(v), 4).alias(f"{m}_mean"), F.round(F.median(v), 4).alias(f"{m}_median"), F.round(std, 4).alias(f"{m}_std"), F.count(v).alias(f"{m}_n")]
    right, valid = F.count_if(~a & ab), F.count_if(~a | ab)
    return answered(spark, d).groupBy("strategy").agg(
        F.count("*").alias("total"), n_a.alias("answerable"), *stats, *[F.sum(own(c)).alias(c) for c in ("retrieved", "judged", "unresolved")], F.round(B.share(F.count_if(a & (F.col("hits") > 0)), n_a), 4).alias("with_relevant"),
        F.count_if(~ab).alias("produced"), F.count_if(ab).alias("abstentions"), F.round(F.avg("groundedness"), 4).alias("groundedness"), F.count("groundedness").alias("groundedness_n"),
        F.count_if(a & ~ab).alias("answers_on_answerable"), F.round(B.share(F.count_if(a & ~ab), n_a), 4).alias("answer_coverage"), F.round(B.share(F.count_if(a & ab), n_a), 4).alias("abstention_rate"),
        right.alias("correct_abstentions"), F.count_if(~a & ~ab).alias("wrong_answers"), F.round(B.share(right, valid), 4).alias("correctness_mean"), valid.alias("n_valid"), F.count_if(a & ~ab).alias("n_not_applicable"),
    )


@register("evl27_leaderboard", f"WITH {METRIC_SQL}, m AS (SELECT strategy, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS rr FROM metric GROUP BY strategy) SELECT strategy, recall, rr, (SELECT count(*) FROM m o WHERE o.recall > m.recall OR o.recall = m.recall AND o.strategy < m.strategy) + 1 AS place FROM m")
def evl27(spark, d):
    from pyspark.sql import Window

    m = metric(spark, d).groupBy("strategy").agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("rr"), 4).alias("rr"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("recall"), "strategy")).cast("long"))  # a row for each strategy


@register("evl28_feedback_validation", """WITH f AS (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST(value / 100 AS VARCHAR) END AS raw FROM events)
SELECT event_type, count(*) AS n, count(*) - count(raw) AS n_null, count(raw) - count(TRY_CAST(raw AS DOUBLE)) AS not_numeric, count_if(TRY_CAST(raw AS DOUBLE) NOT BETWEEN 0 AND 1) AS out_of_range FROM f GROUP BY event_type""")
def evl28(spark, d):
    """Feedback as text: missing, not a number, outside 0 to 1."""
    raw = F.when(F.col("event_id") % 9 == 0, None).when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("value") / 100).cast("string"))
    f = read(spark, d, "events").select("event_type", raw.alias("raw")).withColumn("x", F.expr("try_cast(raw AS double)"))
    missing, x = F.col("raw").isNull(), F.col("x")
    return f.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(missing).alias("n_null"), F.count_if(~missing & x.isNull()).alias("not_numeric"), F.count_if((x < 0) | (x > 1)).alias("out_of_range"))


#: name, kind, unit, least, most, higher is better, counted over. Fixed values.
METRICS = [
    ("recall_at_k", "retrieval", "ratio", 0.0, None, True, "relevant passages of the question"), ("mrr_at_k", "retrieval", "ratio", 0.0, 1.0, True, "questions"),
    ("ndcg_at_k", "retrieval", "ratio", 0.0, None, True, "ideal gain of the question"), ("judged_coverage", "retrieval", "ratio", 0.0, 1.0, True, "retrieved passages"),
    ("dropped_rate", "reranking", "ratio", 0.0, 1.0, False, "relevant candidates"), ("delta_recall", "reranking", "difference", -1.0, 1.0, True, "relevant passages of the question"),
    ("context_relevance", "generation", "ratio", 0.0, 1.0, True, "question tokens"), ("groundedness", "generation", "ratio", 0.0, 1.0, True, "answer tokens"),
    ("answer_relevance", "generation", "ratio", 0.0, 1.0, True, "question tokens"), ("abstention_correctness", "abstention", "ratio", 0.0, 1.0, True, "abstentions and unanswerable questions"),
    ("cohen_kappa", "agreement", "coefficient", -1.0, 1.0, True, "judged pairs"), ("exact_agreement", "agreement", "ratio", 0.0, 1.0, True, "judged pairs"),
]


_DICTIONARY_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE, {up}, '{o}')" for a, b, c, lo, hi, up, o in METRICS) + ") AS t(name, kind, unit, least, most, higher_is_better, counted_over)"


@register("evl29_metric_dictionary", f"""WITH {METRIC_SQL}, {RATERS_SQL}, seen AS (SELECT 'recall_at_k' AS name, count(recall) AS n, round(min(recall), 4) AS low, round(max(recall), 4) AS high FROM metric UNION ALL SELECT 'mrr_at_k', count(rr), round(min(rr), 4), round(max(rr), 4) FROM metric
  UNION ALL SELECT 'exact_agreement', count(*), min((a = b)::INT)::DOUBLE, max((a = b)::INT)::DOUBLE FROM raters)
SELECT t.*, coalesce(n, 0) AS n, low, high, coalesce(low >= least AND (most IS NULL OR high <= most), true) AS in_bounds FROM {_DICTIONARY_SQL} LEFT JOIN seen USING (name)""")
def evl29(spark, d):
    """The dictionary of metrics, with how often the run has values of them, and whether these keep the bounds that it states."""
    book = spark.createDataFrame(METRICS, "name string, kind string, unit string, least double, most double, higher_is_better boolean, counted_over string")
    m = metric(spark, d)
    same = (F.col("a") == F.col("b")).cast("double")
    of = lambda df, name, c: df.agg(F.count(c).alias("n"), F.round(F.min(c), 4).alias("low"), F.round(F.max(c), 4).alias("high")).select(F.lit(name).alias("name"), "n", "low", "high")
    seen = of(m, "recall_at_k", F.col("recall")).unionByName(of(m, "mrr_at_k", F.col("rr"))).unionByName(of(B.raters(spark, d), "exact_agreement", same))
    fine = (F.col("low") >= F.col("least")) & (F.col("most").isNull() | (F.col("high") <= F.col("most")))
    return book.join(F.broadcast(seen), "name", "left").withColumn("in_bounds", F.coalesce(fine, F.lit(True))).withColumn("n", F.coalesce("n", F.lit(0)))  # a row for each metric
