"""Annotation sessions from a log of their events: what was saved, what was refused, and progress at any time.

An item that was saved is locked; an unlock opens it for one more save.  So a valid save is
accepted if it is the item's first, or if the item was unlocked after the valid save before
it: a refused save changes nothing, and what was unlocked before it would have let it
through.  This takes windows over an item's events only, no fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What identifies an item of an annotator's queue.
ITEM = ["annotator", "qid", "passage"]


def judge(events: DataFrame, queue: DataFrame) -> DataFrame:
    """events (annotator, qid, passage, seq, action, version, valid) with status.

    queue: annotator, qid, passage, version of every item; an item is in a queue once.  In this order:
    UNKNOWN_ITEM for what is not in the annotator's queue, STALE for another version of the
    queue than the item's, UNLOCKED for unlocks, UNKNOWN_ACTION, INVALID for a save whose content is not valid,
    then SAVED or LOCKED.  Events of an item go by seq; nulls in an item or a version match nothing.
    """
    own = queue.select(*ITEM, F.col("version").alias("_version")).dropDuplicates(ITEM)
    j = events.join(own, ITEM, "left")
    early = (
        F.when(F.col("_version").isNull(), "UNKNOWN_ITEM").when(~F.coalesce(F.col("version") == F.col("_version"), F.lit(False)), "STALE").when(F.col("action") == "UNLOCK", "UNLOCKED")
        .when(~F.coalesce(F.col("action") == "SAVE", F.lit(False)), "UNKNOWN_ACTION").when(~F.coalesce("valid", F.lit(False)), "INVALID")
    )
    j = j.withColumn("_early", early)
    before = Window.partitionBy(*ITEM).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    saved = F.max(F.when(F.col("_early").isNull(), F.col("seq"))).over(before)
    opened = F.max(F.when(F.col("_early") == "UNLOCKED", F.col("seq"))).over(before)
    late = F.when(saved.isNull() | (opened > saved), "SAVED").otherwise("LOCKED")
    return j.withColumn("status", F.coalesce("_early", late)).drop("_version", "_early")


def annotations(judged: DataFrame) -> DataFrame:
    """The save that stands for each item, with its number among the item's accepted ones."""
    saved = judged.where("status = 'SAVED'")
    last = Window.partitionBy(*ITEM)
    n = F.row_number().over(last.orderBy("seq"))
    return saved.withColumn("revision", n).withColumn("_n", F.count("*").over(last)).where("revision = _n").drop("_n")


def progress(judged: DataFrame, queue: DataFrame) -> DataFrame:
    """annotator, seq, completed, remaining, percent after each save that completed an item; percent to one place."""
    total = queue.dropDuplicates(ITEM).groupBy("annotator").agg(F.count("*").alias("total"))
    first = judged.where("status = 'SAVED'").groupBy(*ITEM).agg(F.min("seq").alias("seq"))
    done = F.row_number().over(Window.partitionBy("annotator").orderBy("seq", "qid", "passage"))
    out = first.withColumn("completed", done).join(total, "annotator")
    return out.select("annotator", "seq", "completed", (F.col("total") - F.col("completed")).alias("remaining"), F.round(F.col("completed") / F.col("total") * 100, 1).alias("percent"))
