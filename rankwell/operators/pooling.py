"""Candidate pools for annotation: what systems found, what they left out, and blinded packages.

evidence is (qid, chapter, strategy, passage, rank, post_rank): post_rank is null for what a
second stage dropped.  Samples are drawn by the order of a keyed hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(*parts) -> Column:
    return F.sha2(F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)


def together(rows: DataFrame) -> DataFrame:
    """rows dealt by question over all of the session's shuffle partitions.

    Pairs of numbers shrink so much in a shuffle that partitions merged by their bytes would be tasks of many millions of rows.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "qid")


def record_kind(strategies: list) -> Column:
    """FINAL or DROPPED: only strategies with a second stage can drop."""
    return F.when(F.col("strategy").isin(strategies) & F.col("post_rank").isNull(), "DROPPED").otherwise("FINAL")


def pool(final: DataFrame) -> DataFrame:
    """qid, passage, n_strategies, best_rank of the final records."""
    return final.groupBy("qid", "passage").agg(F.count_distinct("strategy").alias("n_strategies"), F.min("rank").alias("best_rank"))


def duplicates(final: DataFrame) -> DataFrame:
    """Of each pooled pair: records, repeats within a strategy and across strategies, in order of strategy and rank."""
    within = Window.partitionBy("qid", "passage", "strategy").orderBy("rank")
    across = Window.partitionBy("qid", "passage").orderBy("strategy", "rank")
    seen = final.withColumn("j", F.row_number().over(within)).withColumn("k", F.row_number().over(across))
    return seen.groupBy("qid", "passage").agg(F.count("*").alias("n"), F.count_if(F.col("j") > 1).alias("dup_within"), F.count_if((F.col("k") > 1) & (F.col("j") == 1)).alias("dup_across"))


def outside(evidence: DataFrame, pooled: DataFrame) -> DataFrame:
    """qid, passage of every passage of a question's chapter that is not in its pool.  Questions meet passages by chapter, never all.

    Pairs and pool meet in one aggregate, of a question's rows together, so that pairs, the most rows by far, are shuffled once.
    """
    asked = evidence.select("qid", "chapter").distinct()
    known = evidence.select("chapter", "passage").distinct()
    pairs = asked.join(known, "chapter").select("qid", "passage", F.lit(False).alias("in_pool"))
    both = pairs.unionByName(pooled.select("qid", "passage", F.lit(True).alias("in_pool")))
    return together(both).groupBy("qid", "passage").agg(F.max("in_pool").alias("in_pool")).where(~F.col("in_pool")).select("qid", "passage")


def audit_sample(rows: DataFrame, rate: float = 0.1, seed: str = "42") -> DataFrame:
    """At least one and about rate of each question's rows.  Hashes are made where a question's rows are together, so none is shuffled."""
    by = Window.partitionBy("qid")
    order = by.orderBy(F.unhex(keyed(f"{seed}:", F.col("qid"), ":", F.col("passage"))))
    n = F.count("*").over(by)
    return together(rows).withColumn("r", F.row_number().over(order)).withColumn("n", n).where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * rate))).select("qid", "passage")


def blinded(qrels: DataFrame, negatives: int = 5) -> DataFrame:
    """qid, passage, position: relevant passages and some negatives of each question in an order that tells nothing."""
    draw = Window.partitionBy("qid", F.col("grade") >= 2).orderBy(keyed("neg:", F.col("qid"), ":", F.col("passage")))
    some = qrels.where("grade >= 2 or grade = 0").withColumn("r", F.row_number().over(draw)).where((F.col("grade") >= 2) | (F.col("r") <= negatives))
    shuffle = Window.partitionBy("qid").orderBy(keyed("shuffle:", F.col("qid"), ":", F.col("passage")))
    return some.select("qid", "passage", F.row_number().over(shuffle).alias("position"))


def routed(pooled: DataFrame, risky: Column, rate: float = 0.2) -> DataFrame:
    """qid, passage, risky, second: whether a pair is in the second queue, which has the risky pairs and at least one and about rate of each question's others, drawn by hash."""
    flagged = pooled.select("qid", "passage", risky.alias("risky")).repartition("qid")
    by = Window.partitionBy("qid", "risky")
    drawn = flagged.withColumn("r", F.row_number().over(by.orderBy(F.unhex(keyed("b:", F.col("qid"), ":", F.col("passage")))))).withColumn("n", F.count("*").over(by))
    return drawn.select("qid", "passage", "risky", (F.col("risky") | (F.col("r") <= F.greatest(F.lit(1), F.round(F.col("n") * rate)))).alias("second"))


def review_queue(pooled: DataFrame, risky: Column, rate: float = 0.2) -> DataFrame:
    """Second queue: the risky pairs, and at least one and about rate of each question's others."""
    return routed(pooled, risky, rate).where("second").select("qid", "passage", "risky")


def merge_exports(rows: DataFrame) -> DataFrame:
    """origin and status of each pair that a queue or an export has.

    rows (qid, passage, origin): an export's rows have its name, those of the queue that was asked a null.
    """
    asked = F.col("origin").isNull()
    one = rows.groupBy("qid", "passage").agg(F.min("origin").alias("origin"), F.count_if(~asked).alias("n"), F.some(asked).alias("asked"))
    status = F.when(F.col("n") > 1, "NOT_DISJOINT").when(F.col("n") == 0, "MISSING").when(~F.col("asked"), "UNKNOWN").otherwise("OK")
    return one.select("qid", "passage", "origin", status.alias("status"))


def prioritised(rows: DataFrame, annotator: str) -> DataFrame:
    """rows with priority_rank: an order of each question's own for an annotator."""
    by = Window.partitionBy("qid").orderBy(keyed(F.col("qid"), f":{annotator}:", F.col("passage")))
    return rows.withColumn("priority_rank", F.row_number().over(by))
