"""Queries drawn by a seeded Mersenne twister.  SQL has none, so tests hold them against Python's random module."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import draws as D
from rankwell.operators import pooling as P
from rankwell.plans import base as B
from rankwell.plans.base import read, register
from rankwell.plans.pooling import evidence, pooled

#: Part of the seed of an audit sample, beside the question.
PROTOCOL = "v7_slice4_v3"


@register("sta04_seeded_bootstrap")
def sta04(spark, d):
    """The interval of a mean by 1000 resamples of seed 42."""
    return D.interval(read(spark, d, "labels").select("doc_id", (F.col("quality") - F.col("toxic")).alias("v")), "doc_id", "v")


@register("pol04_seeded_sample")
def pol04(spark, d):
    """A tenth, at least one, of what lies outside each question's pool, by a seed of the question."""
    lists = D.gathered(P.outside(evidence(spark, d), pooled(spark, d)), ["qid"], "passage")
    return D.sample(lists, ["qid"], "passage", D.seed_of(F.col("qid"), f":{PROTOCOL}"), F.ceil(F.col("n") * 0.1).cast("int")).select("qid", "passage")


@register("pol08_seeded_package")
def pol08(spark, d):
    """Relevant passages and two to five drawn negatives of each question, in a drawn order."""
    q = B.qrels(spark, d)
    negatives = D.gathered(q.where("grade < 2"), ["qid"], "passage")
    drawn = D.sample(negatives, ["qid"], "passage", D.seed_of("neg_control:", F.col("qid")), F.greatest(F.lit(2), F.least(F.lit(5), F.col("n"))))
    package = q.where("grade >= 2").select("qid", "passage").unionByName(drawn.select("qid", "passage"))
    return D.shuffle(D.gathered(package, ["qid"], "passage"), ["qid"], "passage", D.seed_of("blind_order:", F.col("qid")))


@register("ann01_seeded_queues")
def ann01(spark, d):
    """The second annotator's queue: risky pairs, and a drawn fifth of each question's pool from the others."""
    p = pooled(spark, d).withColumn("risky", F.col("n_strategies") > 1)
    size = p.groupBy("qid").agg(F.count("*").alias("n_all"))
    calm = D.gathered(p.where(~F.col("risky")), ["qid"], "passage").join(size, "qid")
    # halves round to even, as Python rounds
    drawn = D.sample(calm, ["qid"], "passage", D.seed_of(F.col("qid"), ":random_negative_control_seed"), F.greatest(F.lit(1), F.bround(F.col("n_all") * 0.2).cast("int")))
    return p.where("risky").select("qid", "passage", "risky").unionByName(drawn.select("qid", "passage", F.lit(False).alias("risky")))


@register("ann02_seeded_order")
def ann02(spark, d):
    """Each question's pool in an annotator's own order."""
    return D.shuffle(D.gathered(pooled(spark, d), ["qid"], "passage"), ["qid"], "passage", D.seed_of(F.col("qid"), ":annotator_a")).withColumnRenamed("position", "priority_rank")
