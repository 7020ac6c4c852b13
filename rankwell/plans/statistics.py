"""Paired comparison, intervals and agreement statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import agreement as A
from rankwell.operators import bootstrap
from rankwell.plans import base as B
from rankwell.plans.base import METRIC_SQL, RATERS_SQL, read, register
from rankwell.plans.evaluation import ANSWERED_SQL, HUMAN_SQL, answered, human, metric
from rankwell.sources.folders import scratch

#: Compared pairs of strategies: the later stage first.
PAIRS = [(4, 3), (7, 6)]
PAIRS_SQL = "(VALUES (4, 3), (7, 6)) AS p(sb, sa)"
_SCORES = ["ndcg", "recall", "mrr", "groundedness"]


def scores(spark, d):
    """strategy, metric, qid, score of the answerable questions."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in _SCORES])).alias("x")
    return answered(spark, d).where("answerable").select("strategy", "qid", rows).select("strategy", "x.metric", "qid", "x.score")


SCORES_SQL = f"{ANSWERED_SQL}, scores AS ({' UNION ALL '.join(f'''SELECT strategy, '{m}' AS metric, qid, {m} AS score FROM answered WHERE answerable''' for m in _SCORES)})"
DELTA_SQL = f"""{SCORES_SQL}, delta AS (SELECT sb, sa, metric, qid, (SELECT max(score) FROM scores s WHERE s.strategy = sb AND s.metric = u.metric AND s.qid = u.qid) - (SELECT max(score) FROM scores s WHERE s.strategy = sa AND s.metric = u.metric AND s.qid = u.qid) AS raw
  FROM (SELECT DISTINCT sb, sa, metric, qid FROM scores, {PAIRS_SQL} WHERE strategy IN (sa, sb)) u)"""
D4 = "round(raw, 4)"


def _deltas(spark, d):
    return A.deltas(scores(spark, d), PAIRS)


@register("sta01_paired", f"""WITH {DELTA_SQL} SELECT sb::VARCHAR AS sb, sa::VARCHAR AS sa, metric, count(*) FILTER ({D4} > 0) AS wins, count(*) FILTER ({D4} = 0) AS ties, count(*) FILTER ({D4} < 0) AS losses, count(*) - count(raw) AS missing, count(*) AS n,
round(avg({D4}), 4) AS mean_delta, round(median({D4}), 4) AS median_delta, round(CASE WHEN count(raw) = 1 THEN 0 ELSE stddev_samp({D4}) END, 4) AS std_delta FROM delta GROUP BY ALL""")
def sta01(spark, d):
    return A.paired(_deltas(spark, d), ["sb", "sa", "metric"])


@register("sta01_outcomes", f"WITH {DELTA_SQL} SELECT sb::VARCHAR AS sb, sa::VARCHAR AS sa, metric, qid, CASE sign({D4}) WHEN 1 THEN 'BENEFITED' WHEN -1 THEN 'HARMED' WHEN 0 THEN 'TIED' ELSE 'MISSING' END AS outcome FROM delta")
def sta01_outcomes(spark, d):
    """The questions that a comparison benefited, harmed, left or could not judge, a row each: their number grows."""
    return _deltas(spark, d).select("sb", "sa", "metric", "qid", A.outcome(F.col("delta")).alias("outcome"))


@register("sta02_transitions", f"""WITH {ANSWERED_SQL}, {'m' } AS (SELECT sb, sa, a.qid, a.answerable, a.abstained AS ab_a, b.abstained AS ab_b FROM {PAIRS_SQL} JOIN answered a ON a.strategy = sa JOIN answered b ON b.strategy = sb AND b.qid = a.qid)
SELECT sb, sa, count_if(answerable AND NOT ab_a AND ab_b) AS to_abstain, count_if(answerable AND ab_a AND NOT ab_b) AS to_answer, count_if(answerable AND NOT ab_a AND NOT ab_b) AS both_answered, count_if(NOT answerable AND ab_a AND ab_b) AS control_kept, count_if(NOT answerable) AS controls,
CASE WHEN count_if(answerable AND NOT ab_a AND ab_b) > count_if(answerable AND ab_a AND NOT ab_b) THEN 'DEGRADED' ELSE 'STABLE' END AS coverage, CASE WHEN count_if(answerable AND NOT ab_a AND NOT ab_b) > 0 THEN 'STABLE' ELSE 'NOT_COMPARABLE' END AS generation FROM m GROUP BY ALL""")
def sta02(spark, d):
    """Who stopped or began to answer from one strategy to the next, and the negative controls."""
    rows = answered(spark, d).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("strategy", "abstained"))).alias("m"), F.first("answerable").alias("answerable"))
    p = F.explode(F.array(*[F.struct(F.lit(b).alias("sb"), F.lit(a).alias("sa")) for b, a in PAIRS])).alias("p")
    j = rows.select("answerable", "m", p).select("answerable", "p.*", F.try_element_at("m", F.col("p.sa")).alias("a"), F.try_element_at("m", F.col("p.sb")).alias("b")).where("a is not null and b is not null")
    ok, a, b = F.col("answerable"), F.col("a"), F.col("b")
    worse, better, both = F.count_if(ok & ~a & b), F.count_if(ok & a & ~b), F.count_if(ok & ~a & ~b)
    return j.groupBy("sb", "sa").agg(worse.alias("to_abstain"), better.alias("to_answer"), both.alias("both_answered"), F.count_if(~ok & a & b).alias("control_kept"), F.count_if(~ok).alias("controls"),
        F.when(worse > better, "DEGRADED").otherwise("STABLE").alias("coverage"), F.when(both > 0, "STABLE").otherwise("NOT_COMPARABLE").alias("generation"))


def _draws_sql(source: str, by: str, resamples: int, lo: int, hi: int) -> str:
    """Interval of the mean of v over source({by}, key, v), with the draws made explicit."""
    g = f"{by}, " if by else ""
    on = f"x.{by} = d.{by} AND " if by else ""
    return f"""x AS (SELECT {g}row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY sha256(key::VARCHAR), key) - 1 AS i, count(*) OVER ({f'PARTITION BY {by}' if by else ''}) AS n, v FROM {source} WHERE v IS NOT NULL),
draws AS (SELECT {g}b, ('0x' || substr(sha256(concat('42:', b, ':', i)), 1, 8))::BIGINT % n AS j FROM x, range(0, {resamples}) AS r(b)),
means AS (SELECT {f'd.{by}, ' if by else ''}b, avg(x.v) AS m FROM draws d JOIN x ON {on}x.i = d.j GROUP BY ALL),
ordered AS (SELECT {g}list(m ORDER BY m, b) AS l FROM means {f'GROUP BY {by}' if by else ''}), ci AS (SELECT {g}round(l[{lo + 1}], 4) AS low, round(l[{hi + 1}], 4) AS high FROM ordered)"""


@register("sta03_compare", f"""WITH {METRIC_SQL}, dl AS (SELECT b.strategy * 10 + a.strategy AS pair, b.qid AS key, round(b.recall - a.recall, 4) AS v FROM metric a JOIN metric b ON b.qid = a.qid AND (b.strategy, a.strategy) IN ((4, 3), (7, 6))),
{_draws_sql('dl', 'pair', 1000, 25, 975)},
s AS (SELECT pair, count_if(v > 0) AS wins, count_if(v = 0) AS ties, count_if(v < 0) AS losses, avg(v) AS m, stddev_samp(v) AS sd FROM dl WHERE v IS NOT NULL GROUP BY pair)
SELECT pair // 10 AS sb, pair % 10 AS sa, wins, ties, losses, round(m, 4) AS mean_diff, low, high, round(CASE WHEN coalesce(sd, 0) = 0 THEN 0 ELSE m / sd END, 4) AS d, CASE WHEN low > 0 THEN 'IMPROVED' WHEN high < 0 THEN 'WORSE' ELSE 'INCONCLUSIVE' END AS conclusion FROM s JOIN ci USING (pair)""")
def sta03(spark, d):
    """Wins, ties, losses, mean difference with its interval, effect size and what follows."""
    m = metric(spark, d).select("strategy", F.lit("recall").alias("metric"), "qid", F.col("recall").alias("score"))
    path = scratch(spark, "deltas")  # made once for the interval and the counts
    A.deltas(m, PAIRS).where("delta is not null").write.parquet(path)
    rows = spark.read.parquet(path)
    ci = bootstrap.interval(rows, ["sb", "sa"], "qid", "delta")
    x = F.col("delta")
    s = rows.groupBy("sb", "sa").agg(F.count_if(x > 0).alias("wins"), F.count_if(x == 0).alias("ties"), F.count_if(x < 0).alias("losses"), F.round(F.avg(x), 4).alias("mean_diff"), F.round(A.cohens_d(x), 4).alias("d"))
    label = F.when(F.col("low") > 0, "IMPROVED").when(F.col("high") < 0, "WORSE").otherwise("INCONCLUSIVE")
    return s.join(ci, ["sb", "sa"]).withColumn("conclusion", label).withColumn("sb", F.col("sb").cast("int")).withColumn("sa", F.col("sa").cast("int"))


@register("sta04_bootstrap", f"WITH src AS (SELECT doc_id AS key, (quality - toxic)::DOUBLE AS v FROM labels), {_draws_sql('src', '', 1000, 25, 975)} SELECT low, high FROM ci")
def sta04(spark, d):
    return bootstrap.overall(read(spark, d, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).cast("double").alias("v")), "doc_id", "v")


@register("sta05_cohens_d", f"""WITH {METRIC_SQL}, l AS (SELECT b.strategy AS sb, a.strategy AS sa, list(round(b.recall - a.recall, 4)) AS v FROM metric a JOIN metric b ON b.qid = a.qid AND (b.strategy, a.strategy) IN ((4, 3), (7, 6)) WHERE a.recall IS NOT NULL AND b.recall IS NOT NULL GROUP BY ALL),
s AS (SELECT sb, sa, list_avg(v) AS m, sqrt(list_sum([power(x - list_avg(v), 2) for x in v]) / nullif(len(v) - 1, 0)) AS sd FROM l) SELECT sb::VARCHAR AS sb, sa::VARCHAR AS sa, round(CASE WHEN coalesce(sd, 0) = 0 THEN 0 ELSE m / sd END, 4) AS d FROM s""")
def sta05(spark, d):
    m = metric(spark, d).select("strategy", F.lit("recall").alias("metric"), "qid", F.col("recall").alias("score"))
    return A.deltas(m, PAIRS).groupBy("sb", "sa").agg(F.round(A.cohens_d(F.col("delta")), 4).alias("d"))


_LABELS_SQL = "raters AS (SELECT quality AS a, CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"


def _pairs(spark, d):
    """Ratings of three samples: labels, none at all, and one class only."""
    l = read(spark, d, "labels").where("quality is not null and toxic is not null").select(F.col("quality").alias("a"), F.when(F.col("toxic") == 1, 1 - F.col("quality")).otherwise(F.col("quality")).alias("b"))
    return [("labels", l), ("none", l.where("false")), ("one class", l.where("a = 1 and b = 1"))]


@register("sta06_kappa", f"""WITH {_LABELS_SQL}, n AS (SELECT count(*)::DOUBLE AS n, count_if(a = b)::DOUBLE AS same, sum(a)::DOUBLE AS a1, sum(b)::DOUBLE AS b1 FROM raters), p AS (SELECT same / n AS po, (a1 * b1 + (n - a1) * (n - b1)) / (n * n) AS pe FROM n)
SELECT 'labels' AS sample, round((po - pe) / (1 - pe), 6) AS kappa, 'COMPUTED' AS status FROM p UNION ALL SELECT 'none', NULL, 'EMPTY_SAMPLE' UNION ALL SELECT 'one class', NULL, 'SINGLE_CLASS'""")
def sta06(spark, d):
    out = None
    for name, pairs in _pairs(spark, d):
        one = A.kappa(pairs, sentinels=True).select(F.lit(name).alias("sample"), F.round("kappa", 6).alias("kappa"), "status")
        out = one if out is None else out.unionByName(one)
    return out


@register("sta07_linear_kappa", f"""WITH {RATERS_SQL}, seen AS (SELECT avg(abs(a - b) / 3.0::DOUBLE) AS v FROM raters), expected AS (SELECT sum(abs(x.a - y.b) / 3.0::DOUBLE * x.n * y.n) / any_value(t.n * t.n) AS v FROM (SELECT a, count(*)::DOUBLE AS n FROM raters GROUP BY a) x, (SELECT b, count(*)::DOUBLE AS n FROM raters GROUP BY b) y, (SELECT count(*)::DOUBLE AS n FROM raters) t)
SELECT round(1 - seen.v / expected.v, 6) AS kappa FROM seen, expected""")
def sta07(spark, d):
    return A.weighted_kappa(B.raters(spark, d), 1).select(F.round("kappa", 6).alias("kappa"))


@register("sta08_quadratic_kappa", f"""WITH {RATERS_SQL}, m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c, count(*)::DOUBLE AS n, count_if(a = b)::DOUBLE AS same FROM raters),
pe AS (SELECT sum(x.n * y.n) AS v FROM (SELECT a, count(*)::DOUBLE AS n FROM raters GROUP BY a) x JOIN (SELECT b, count(*)::DOUBLE AS n FROM raters GROUP BY b) y ON x.a = y.b)
SELECT round(2 * c / (va + vb + (ma - mb) ** 2), 6) AS quadratic, round((same / n - v / n / n) / (1 - v / n / n), 6) AS unweighted FROM m, pe""")
def sta08(spark, d):
    # the twin uses the closed form of the quadratic coefficient
    r = B.raters(spark, d)
    q, u = A.weighted_kappa(r, 2).select(F.round("kappa", 6).alias("quadratic")), A.kappa(r).select(F.round("kappa", 6).alias("unweighted"))
    return q.crossJoin(u)  # one row each


@register("sta09_agreement_report", f"""WITH {RATERS_SQL}, g AS (SELECT abs(a - b) AS gap, least(a, 1) AS ra, least(b, 1) AS rb FROM raters), h AS (SELECT histogram(gap) AS g, histogram(ra * 2 + rb) AS t, count(*) AS n FROM g)
SELECT n AS pairs, g[0] AS exact, round(g[0]::DOUBLE / n, 4) AS exact_rate, n - g[0] AS disagreements, g[1] AS adjacent, n - g[0] - g[1] AS severe, coalesce(g[2], 0) AS distance_2, coalesce(g[3], 0) AS distance_3,
round((coalesce(t[0], 0) + coalesce(t[3], 0))::DOUBLE / n, 4) AS binary_rate, coalesce(t[0], 0) AS neither, coalesce(t[1], 0) AS only_b, coalesce(t[2], 0) AS only_a, coalesce(t[3], 0) AS both FROM h""")
def sta09(spark, d):
    return A.report(B.raters(spark, d))


@register("sta09_confusion", f"WITH {RATERS_SQL} SELECT i::INT AS a, j::INT AS b, (SELECT count(*) FROM raters WHERE a = i AND b = j) AS n, abs(i - j)::INT AS distance FROM range(0, 4) x(i), range(0, 4) y(j)")
def sta09_confusion(spark, d):
    return A.confusion(B.raters(spark, d))


@register("sta09_disagreements", f"WITH {RATERS_SQL} SELECT qid, item, a, b, greatest(a, b) - least(a, b) AS gap, CASE WHEN greatest(a, b) - least(a, b) > 1 THEN 'SEVERE' ELSE 'ADJACENT' END AS severity, count(*) OVER (PARTITION BY qid) AS of_question FROM raters WHERE a <> b")
def sta09_disagreements(spark, d):
    from pyspark.sql import Window

    return A.disagreements(B.raters(spark, d)).withColumn("of_question", F.count("*").over(Window.partitionBy("qid")))


@register("sta10_confusion", f"""WITH {RATERS_SQL}, p AS (SELECT item, CASE WHEN item % 10 = 0 THEN NULL ELSE a > 0 END AS x, CASE WHEN item % 15 = 0 THEN NULL ELSE b > 0 END AS y, a, b FROM raters),
c AS (SELECT 'answerability' AS what, x::INT AS u, y::INT AS v, x IS NULL OR y IS NULL AS pending FROM p UNION ALL SELECT 'relevance', a, b, item % 10 = 0 OR item % 15 = 0 FROM p)
SELECT what, count(*) AS n, count_if(pending) AS pending, count_if(NOT pending AND u = v) AS agreed, round(count_if(NOT pending AND u = v)::DOUBLE / nullif(count_if(NOT pending), 0), 4) AS rate, CASE WHEN count_if(NOT pending) = 0 THEN 'PENDING_HUMAN_ANNOTATION' ELSE 'COMPUTED' END AS status FROM c GROUP BY what""")
def sta10(spark, d):
    """Agreement on answerability and on relevance; items that a rater has not done yet are pending."""
    i = F.col("item")
    r = B.raters(spark, d).withColumn("x", F.when(i % 10 != 0, F.col("a"))).withColumn("y", F.when(i % 15 != 0, F.col("b")))
    what = F.explode(F.array(*[F.struct(F.lit(n).alias("what"), u.alias("u"), v.alias("v")) for n, u, v in (("answerability", F.least("x", F.lit(1)) + 0 * F.col("x"), F.least("y", F.lit(1)) + 0 * F.col("y")), ("relevance", F.col("x"), F.col("y")))])).alias("r")
    done = F.col("u").isNotNull() & F.col("v").isNotNull()
    n, same = F.count_if(done), F.count_if(done & (F.col("u") == F.col("v")))
    return r.select(what).select("r.*").groupBy("what").agg(F.count("*").alias("n"), F.count_if(~done).alias("pending"), same.alias("agreed"), F.round(B.share(same, n), 4).alias("rate"), F.when(n == 0, "PENDING_HUMAN_ANNOTATION").otherwise("COMPUTED").alias("status"))


@register("sta11_calibration", f"""WITH {RATERS_SQL}, h AS (SELECT 'all' AS sample, a AS human, CASE WHEN item % 7 = 0 THEN 0 ELSE b END AS silver FROM raters UNION ALL SELECT 'few', a, b FROM raters WHERE item < 20),
c AS (SELECT sample, count(*) AS n, avg((human = silver)::INT) AS acc, count_if(human >= 1 AND silver = 0)::DOUBLE / greatest(1, count_if(human >= 1)) AS f FROM h GROUP BY sample)
SELECT sample, CASE WHEN n < 30 THEN 'NOT_COMPUTABLE_INSUFFICIENT_SAMPLE' WHEN f <= 0.05 AND 1 - f >= 0.95 THEN 'CALIBRATION_PASSED' ELSE 'CALIBRATION_FAILED' END AS status, n, CASE WHEN n >= 30 THEN round(acc, 4) END AS agreement, CASE WHEN n >= 30 THEN round(f, 4) END AS fnr, CASE WHEN n >= 30 THEN round(1 - f, 4) END AS relevant_recall FROM c""")
def sta11(spark, d):
    r = B.raters(spark, d)
    whole = r.select(F.col("a").alias("human"), F.when(F.col("item") % 7 != 0, F.col("b")).alias("silver"))
    few = r.where("item < 20").select(F.col("a").alias("human"), F.col("b").alias("silver"))
    return A.calibration(whole).withColumn("sample", F.lit("all")).unionByName(A.calibration(few).withColumn("sample", F.lit("few")))


@register("sta12_classification", f"""WITH {DELTA_SQL}, z AS (SELECT sb, sa, metric, count(raw) AS n, min({D4}) AS lo, max({D4}) AS hi, avg({D4}) AS m FROM delta GROUP BY ALL)
SELECT sb::VARCHAR AS sb, sa::VARCHAR AS sa, metric, CASE WHEN n = 0 THEN 'NOT_COMPARABLE' WHEN lo >= 0 AND hi > 0 THEN 'DOMINANT' WHEN hi <= 0 AND lo < 0 THEN 'DOMINATED' WHEN m > 0 THEN 'LOCALIZED_IMPROVEMENT' WHEN m < 0 THEN 'MIXED' ELSE 'STABLE' END AS label FROM z""")
def sta12(spark, d):
    x = F.col("delta")
    lo, hi, m = F.min(x), F.max(x), F.avg(x)
    label = F.when(F.count(x) == 0, "NOT_COMPARABLE").when((lo >= 0) & (hi > 0), "DOMINANT").when((hi <= 0) & (lo < 0), "DOMINATED").when(m > 0, "LOCALIZED_IMPROVEMENT").when(m < 0, "MIXED").otherwise("STABLE")
    return _deltas(spark, d).groupBy("sb", "sa", "metric").agg(label.alias("label"))


@register("sta13_abstention_diagnosis", f"""WITH {ANSWERED_SQL}, ab2 AS (SELECT strategy, qid FROM answered WHERE answerable AND abstained), top3 AS (SELECT strategy, qid, list(passage) AS p FROM run WHERE rank <= 3 GROUP BY ALL),
g AS (SELECT qid, list({{'p': passage, 'g': grade}}) AS l, histogram(grade) AS h FROM qrels GROUP BY qid),
r AS (SELECT ab2.strategy, ab2.qid, [coalesce(list_filter(l, lambda x: x.p = y)[1].g, 0) for y in p] AS rels, h FROM ab2 JOIN top3 USING (strategy, qid) LEFT JOIN g ON g.qid = ab2.qid)
SELECT strategy, qid, list_max(rels) AS best, len(list_filter(rels, lambda x: x > 0)) AS relevant, len(list_filter(rels, lambda x: x > 1)) AS strong, CASE list_max(rels) WHEN 0 THEN 'RETRIEVAL_FAILURE' WHEN 1 THEN 'INSUFFICIENT_RETRIEVED_SUPPORT' ELSE 'QREL_OR_QUESTION_AMBIGUITY' END AS category,
concat_ws(',', coalesce(h[0], 0), coalesce(h[1], 0), coalesce(h[2], 0), coalesce(h[3], 0)) AS grades FROM r""")
def sta13(spark, d):
    """Why an answerable question was not answered: the best grade among the first three, and the grades it has at all."""
    who = answered(spark, d).where("answerable and abstained").select("strategy", "qid")
    q = B.qrels(spark, d)
    top = B.run(spark, d).where("rank <= 3").join(q, ["qid", "passage"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    best = F.max("grade")
    kind = F.when(best < 1, "RETRIEVAL_FAILURE").when(best == 1, "INSUFFICIENT_RETRIEVED_SUPPORT").otherwise("QREL_OR_QUESTION_AMBIGUITY")
    per = top.groupBy("strategy", "qid").agg(best.alias("best"), F.count_if(F.col("grade") >= 1).alias("relevant"), F.count_if(F.col("grade") >= 2).alias("strong"), kind.alias("category"))
    grades = q.groupBy("qid").agg(F.concat_ws(",", *[F.count_if(F.col("grade") == g).cast("string") for g in range(4)]).alias("grades"))
    return who.join(per, ["strategy", "qid"]).join(grades, "qid", "left").select("strategy", "qid", "best", "relevant", "strong", "category", F.coalesce("grades", F.lit("0,0,0,0")).alias("grades"))


_E4 = "coalesce(CAST(CAST(round({0} * 10000) AS BIGINT) AS VARCHAR), 'NA')"


@register("sta14_metric_matrix", f"WITH {HUMAN_SQL} SELECT strategy, qid, status, {', '.join(f'{_E4.format(m)} AS {m}_e4' for m in ('recall', 'mrr', 'ndcg', 'coverage'))} FROM human")
def sta14(spark, d):
    cell = lambda m: F.coalesce(F.round(F.col(m) * 10000).cast("long").cast("string"), F.lit("NA")).alias(f"{m}_e4")
    return human(spark, d).select("strategy", "qid", "status", *map(cell, ("recall", "mrr", "ndcg", "coverage")))
