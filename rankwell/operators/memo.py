"""Embedding that computes each distinct text once, in a run and across runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed_once(docs: DataFrame, embed: Callable[[Column], Column], dim: int, text: str = "text", cache: str | None = None) -> DataFrame:
    """docs with embedding; copies of a text share one computation, found by its hash.

    Null and blank texts have the zero vector.  cache names a table of the shared folder
    with vectors of earlier runs: only texts that it lacks are embedded, and it grows by
    them.  Pays where embed is dear: texts and vectors are shuffled by hash.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn("text_sha", F.when(F.trim(body) != "", F.sha2(body, 256)))
    once = keyed.where("text_sha is not null").groupBy("text_sha").agg(F.first(body).alias("body"))
    if cache is None:
        known = once.select("text_sha", embed(F.col("body")).alias("embedding"))
    else:
        # each run's additions have a folder of their own: plans tell tables apart by their folders
        try:
            old = spark.read.parquet(f"{cache}/*")
        except AnalysisException:  # no run before
            old = spark.createDataFrame([], "text_sha string, embedding array<double>")
        new = once.join(old.select("text_sha"), "text_sha", "left_anti").select("text_sha", embed(F.col("body")).alias("embedding"))
        new.write.parquet(f"{cache}/{uuid.uuid4().hex}")
        known = spark.read.parquet(f"{cache}/*")
    zero = F.array_repeat(F.lit(0.0), dim)
    return keyed.join(known, "text_sha", "left").withColumn("embedding", F.coalesce("embedding", zero)).drop("text_sha")
