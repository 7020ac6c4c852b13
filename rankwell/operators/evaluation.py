"""Evaluation of ranked lists against graded judgements.

run is (strategy, qid, passage, rank, ...), rank from 1 without gaps in each list; qrels is
(qid, passage, grade), a pair at most once.  A passage is relevant from grade 1 on.  Three
recalls coexist on purpose: they differ in when a list is cut and whether repeats count.
Absent is not zero: without relevant passages a metric is null and its status says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["strategy", "qid"]


def relevant(qrels: DataFrame, least: int = 1) -> DataFrame:
    return qrels.where(F.col("grade") >= least).select("qid", "passage", "grade")


def gold_size(qrels: DataFrame) -> DataFrame:
    return relevant(qrels).groupBy("qid").agg(F.count("*").alias("n_rel"))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """run with grade; null where the pair was not judged."""
    return run.join(qrels.select("qid", "passage", "grade"), ["qid", "passage"], "left")


def deduplicated(run: DataFrame) -> DataFrame:
    """First place of each passage in a list, and its position among first places."""
    first = run.groupBy(*KEYS, "passage").agg(F.min("rank").alias("rank"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(*KEYS).orderBy("rank")))


def _first(hit: Column, place: str) -> Column:
    """Reciprocal of the least place of a hit, 0 without one."""
    return F.coalesce(1.0 / F.min(F.when(hit, F.col(place))).cast("double"), F.lit(0.0))


def recall_at_k(run: DataFrame, qrels: DataFrame, k: int, empty_is_zero: bool = False) -> DataFrame:
    """recall and rr of each list: repeats go first, then the list is cut.  A list without relevant
    passages has a null recall, or 0."""
    hit = F.col("grade") >= 1
    per = judged(deduplicated(run).where(F.col("pos") <= k), qrels).groupBy(*KEYS).agg(F.count_if(hit).alias("hits"), _first(hit, "pos").alias("rr"))
    recall = F.col("hits").cast("double") / F.col("n_rel")
    return per.join(gold_size(qrels), "qid", "left").select(*KEYS, (F.coalesce(recall, F.lit(0.0)) if empty_is_zero else recall).alias("recall"), "rr")


def mean_reciprocal_rank(metric: DataFrame, by: str = "strategy", skip_empty: bool = False) -> DataFrame:
    """Mean of rr and the number of questions; questions without relevant passages may be left out."""
    return (metric.where("recall is not null") if skip_empty else metric).groupBy(by).agg(F.avg("rr").alias("mrr"), F.count("*").alias("n"))


def passage_recall(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """recall, status: the list is cut, then taken as a set."""
    found = F.count_distinct(F.when(F.col("grade") >= 1, F.col("passage")))
    per = judged(run.where(F.col("rank") <= k), qrels).groupBy(*KEYS).agg(found.alias("hits"))
    status = F.when(F.col("n_rel").isNull(), "NOT_COMPUTABLE_NO_GOLD").otherwise("COMPUTED")
    return per.join(gold_size(qrels), "qid", "left").select(*KEYS, (F.col("hits").cast("double") / F.col("n_rel")).alias("recall"), status.alias("status"))


def uncut_rr(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """rr over the whole list, repeats and all."""
    return judged(run, qrels).groupBy(*KEYS).agg(_first(F.col("grade") >= 1, "rank").alias("rr"))


def gain(grade: Column, place: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(place.cast("double") + 1)


def ideal_gain(qrels: DataFrame, k: int) -> DataFrame:
    """idcg of each question: its best k grades in order."""
    best = qrels.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("grade"), "passage"))).where(F.col("place") <= k)
    return best.groupBy("qid").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("idcg"))


def ndcg(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """ndcg of each list cut at k; unjudged passages gain nothing; 0 where nothing could be gained."""
    per = judged(run.where(F.col("rank") <= k), qrels).groupBy(*KEYS).agg(F.sum(gain(F.coalesce("grade", F.lit(0)), F.col("rank"))).alias("dcg"))
    return per.join(ideal_gain(qrels, k), "qid", "left").select(*KEYS, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def citation_scores(cited: DataFrame, run: DataFrame, qrels: DataFrame) -> DataFrame:
    """precision, recall of citations (strategy, qid, passage); one outside the list counts as wrong.

    Recall counts each citation, so repeats can lift it.
    """
    known = run.select(*KEYS, "passage").distinct().withColumn("known", F.lit(True))
    hit = (F.col("grade") >= 1) & F.col("known").isNotNull()
    per = judged(cited, qrels).join(known, [*KEYS, "passage"], "left").groupBy(*KEYS).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))
    hits = F.col("hits").cast("double")
    return per.join(gold_size(qrels), "qid", "left").select(*KEYS, (hits / F.col("n")).alias("precision"), (hits / F.col("n_rel")).alias("recall"))


def page_metrics(run: DataFrame, cited: DataFrame, qrels: DataFrame) -> DataFrame:
    """hit, page_mrr of a list, and precision (1 without citations) and recall (1 without relevant pages) of its citations."""
    good = F.col("grade") >= 1
    lists = judged(deduplicated(run), qrels).groupBy(*KEYS).agg((F.count_if(good) > 0).alias("hit"), _first(good, "pos").alias("page_mrr"))
    c = judged(cited, qrels).groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_distinct(F.when(good, F.col("passage"))).alias("pages"))
    j = lists.join(c, KEYS, "left").join(gold_size(qrels), "qid", "left")
    precision = F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(F.col("good").cast("double") / F.col("n"))
    recall = F.when(F.col("n_rel").isNull(), 1.0).otherwise(F.coalesce("pages", F.lit(0)).cast("double") / F.col("n_rel"))
    return j.select(*KEYS, "hit", "page_mrr", precision.alias("page_precision"), recall.alias("page_recall"))


def human_metrics(run: DataFrame, qrels: DataFrame, k: int, known: Column) -> DataFrame:
    """Metrics against human judgements of each list.

    The list is cut at k first; of the rest, passages that are not known count as
    unresolved and leave, and places close up.  Unjudged passages have grade 0 but are
    counted.  Recall counts repeats and can exceed 1.
    """
    cut = run.where(F.col("rank") <= k).withColumn("known", known)
    by = Window.partitionBy(*KEYS).orderBy("rank")
    placed = cut.withColumn("pos", F.when(F.col("known"), F.sum(F.col("known").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    good, live = F.col("known") & (F.col("grade") >= 1), F.col("known")
    per = judged(placed, qrels).groupBy(*KEYS).agg(
        F.count_if(~live).alias("unresolved"), F.count_if(live & F.col("grade").isNull()).alias("unjudged"), F.count_if(live).alias("retrieved"), F.count_if(live & F.col("grade").isNotNull()).alias("judged"),
        F.count_if(live & (F.col("grade") == 0)).alias("false_positives"), F.count_if(good).alias("hits"), _first(good, "pos").alias("rr"), F.sum(F.when(live, gain(F.coalesce("grade", F.lit(0)), F.col("pos")))).alias("dcg"),
    )
    j = per.join(gold_size(qrels), "qid", "left").join(ideal_gain(qrels, k), "qid", "left")
    has = F.col("n_rel").isNotNull()
    return j.select(
        *KEYS, F.when(has, "COMPUTED").otherwise("NOT_APPLICABLE").alias("status"), (F.col("hits").cast("double") / F.col("n_rel")).alias("recall"), F.when(has, F.col("rr")).alias("mrr"),
        F.when(has & (F.col("idcg") > 0), F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"), "unjudged", "unresolved", "retrieved", "judged", "false_positives", "hits",
        F.when(F.col("retrieved") > 0, F.col("judged").cast("double") / F.col("retrieved")).alias("coverage"),
    )


def reranker_damage(pre: DataFrame, post: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """What reranking lost: relevant entries of the uncut list before, those of them not among the k after, recall both ways.

    A passage of a list becomes one row first, so that judgements are joined once and nothing is counted as distinct.
    """
    after = post.where(F.col("rank") <= k).select(*KEYS, "passage", F.lit(None).cast("int").alias("rank"))
    entries = pre.select(*KEYS, "passage", F.col("rank").cast("int").alias("rank")).unionByName(after)
    one = entries.groupBy(*KEYS, "passage").agg(F.count("rank").alias("n"), F.coalesce(F.min("rank") <= k, F.lit(False)).alias("before"), (F.count("*") > F.count("rank")).alias("kept"))
    good = F.col("grade") >= 1
    per = judged(one, relevant(qrels)).where(F.col("n") > 0).groupBy(*KEYS).agg(F.sum(F.when(good, F.col("n")).otherwise(0)).alias("pre_relevant"), F.count_if(good & ~F.col("kept")).alias("dropped"), F.count_if(good & F.col("before")).alias("pre_hits"), F.count_if(good & F.col("kept")).alias("post_hits"))
    rate = F.when(F.col("pre_relevant") > 0, F.col("dropped").cast("double") / F.col("pre_relevant")).otherwise(0.0)
    delta = (F.col("post_hits") - F.col("pre_hits")).cast("double") / F.col("n_rel")
    return per.join(gold_size(qrels), "qid", "left").select(*KEYS, "pre_relevant", "dropped", rate.alias("dropped_rate"), delta.alias("delta_recall"))


def page_damage(pre: DataFrame, post: DataFrame, qrels: DataFrame, n: int) -> DataFrame:
    """The same with both lists cut at n: recalls, their difference, dropped candidates and the relevant ones among them."""
    after = post.where(F.col("rank") <= n).groupBy(*KEYS, "passage").agg(F.count("*").alias("times"))
    good = F.col("grade") >= 1
    gone = F.col("times").isNull()
    per = judged(pre, qrels).join(after, [*KEYS, "passage"], "left").groupBy(*KEYS).agg(
        F.count_if(good & (F.col("rank") <= n)).alias("pre"), F.count_if(gone).alias("dropped"), F.count_if(gone & good).alias("lost"), F.count_if(good).alias("relevant"),
    )
    hits = judged(after, qrels).groupBy(*KEYS).agg(F.sum(F.when(good, F.col("times"))).alias("post"))
    j = per.join(hits, KEYS, "left").join(gold_size(qrels), "qid", "left")
    of = lambda c: F.coalesce(c.cast("double") / F.col("n_rel"), F.lit(0.0))
    pre_recall, post_recall = of(F.col("pre")), of(F.col("post"))
    rate = F.when(F.col("relevant") > 0, F.col("lost").cast("double") / F.col("relevant")).otherwise(0.0)
    return j.select(*KEYS, pre_recall.alias("recall_pre"), post_recall.alias("recall_post"), (post_recall - pre_recall).alias("delta_recall"), "dropped", "lost", rate.alias("dropped_rate"))


def capped_recall(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """recall counts each hit of a list cut at k, at most 1; hit; rr of the stored rank."""
    good = F.col("grade") >= 1
    per = judged(run.where(F.col("rank") <= k), qrels).groupBy(*KEYS).agg(F.count_if(good).alias("hits"), _first(good, "rank").alias("rr"))
    return per.join(gold_size(qrels), "qid", "left").select(*KEYS, F.least(F.lit(1.0), F.coalesce(F.col("hits").cast("double") / F.col("n_rel"), F.lit(0.0))).alias("recall"), (F.col("hits") > 0).alias("hit"), "rr")


def single_page(run: DataFrame, target: DataFrame, k: int) -> DataFrame:
    """One relevant page for each question (qid, target): hit, recall, rr and precision 1 / k of a hit."""
    found = F.col("passage") == F.col("target")
    per = run.where(F.col("rank") <= k).join(target, "qid").groupBy(*KEYS).agg((F.count_if(found) > 0).alias("hit"), _first(found, "rank").alias("rr"))
    one = F.col("hit").cast("double")
    return per.select(*KEYS, "hit", one.alias("recall"), "rr", (one / k).alias("precision"))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, median, std (of a sample; 0 for one value), least, most and n of the values that are not null."""
    v = F.col(value)
    std = F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), std.alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.count(v).alias("n"))


def abstention_category(answerable: Column, abstained: Column) -> Column:
    return F.when(answerable, F.when(abstained, "FALSE_ABSTENTION").otherwise("CORRECT_ANSWER")).otherwise(F.when(abstained, "CORRECT_ABSTENTION").otherwise("FALSE_ANSWER"))


def abstention_correctness(is_abstention: Column, abstained: Column) -> tuple[Column, Column, Column]:
    """(status, score, reason); a substantive answer to an answerable question is not judged here."""
    na = ~is_abstention & ~abstained
    right = is_abstention & abstained
    score = F.when(na, None).when(right, 1.0).otherwise(0.0)
    reason = F.when(na, "SUBSTANTIVE_ANSWER_NOT_ABSTENTION_QUESTION").when(right, "CORRECT_ABSTENTION").when(abstained, "INCORRECT_ABSTENTION_ON_ANSWERABLE").otherwise("FAILED_TO_ABSTAIN_ON_UNANSWERABLE")
    return F.when(na, "NOT_APPLICABLE").otherwise("COMPUTED"), score.cast("double"), reason
