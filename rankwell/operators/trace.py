"""Traces of auto-merging, and joins that tie chunks, parents and citations together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_decisions(run: DataFrame, tree: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per query and candidate parent, counted from the leaves before merging.

    run (query_id, node_id); tree (node_id, parent_id, tokens, relevant boolean).  A parent
    is merged where the share of its children retrieved reaches the threshold.
    """
    whole = tree.groupBy("parent_id").agg(F.count("*").alias("children_total"), F.sum("tokens").alias("all_tokens"), F.count_if("relevant").alias("all_relevant"))
    got = run.join(tree, "node_id").groupBy("query_id", "parent_id").agg(F.count("*").alias("children_retrieved"), F.sum("tokens").alias("tokens_before"), F.count_if("relevant").alias("relevant_before"))
    ratio = F.col("children_retrieved") / F.col("children_total")
    both = got.join(whole, "parent_id").withColumn("coverage_ratio", F.round(ratio, 6)).withColumn("merged", ratio >= threshold)
    after = lambda big, own: F.when(F.col("merged"), F.col(big)).otherwise(F.col(own))
    return both.select("query_id", "parent_id", "children_retrieved", "children_total", "coverage_ratio", "merged", "tokens_before", after("all_tokens", "tokens_before").alias("tokens_after"), "relevant_before", after("all_relevant", "relevant_before").alias("relevant_after"))


def trace_ratios(decisions: DataFrame) -> DataFrame:
    """Ratios of each query's decisions; a ratio over nothing is 0, or 1 for expansion and preservation."""
    of = lambda a, b, none: F.round(F.when(b == 0, F.lit(none)).otherwise(a / b), 6)
    total = decisions.groupBy("query_id").agg(
        F.count_if("merged").alias("merges_performed"),
        F.count_if(~F.col("merged")).alias("merges_refused"),
        F.sum("children_retrieved").alias("leaves"),
        F.coalesce(F.sum(F.when(F.col("merged"), F.col("children_retrieved"))), F.lit(0)).alias("promoted"),
        *[F.sum(c).alias(c) for c in ("tokens_before", "tokens_after", "relevant_before", "relevant_after")],
    )
    c = F.col
    kept = F.least(F.lit(1.0), of(c("relevant_after"), c("relevant_before"), 1.0))
    return total.select(
        "query_id", "merges_performed", "merges_refused", of(c("merges_performed"), c("merges_performed") + c("merges_refused"), 0.0).alias("merge_rate"),
        of(c("promoted"), c("leaves"), 0.0).alias("parent_promotion_rate"), of(c("tokens_after"), c("tokens_before"), 1.0).alias("context_expansion_ratio"), kept.alias("preservation"), F.round(1 - kept, 6).alias("loss"),
    )


def prioritised_passages(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """Passage of each chunk by its id, else by document and offsets, else by text hash.

    chunks (chunk_id, passage_id, document_id, start, end, sha); passages (passage_id,
    document_id, start, end, sha).  Of several passages the smallest id counts.
    """
    first = lambda *keys: passages.groupBy(*keys).agg(F.min("passage_id").alias("hit"))
    ids, place, text = passages.select(F.col("passage_id").alias("by_id")).distinct(), first("document_id", "start", "end").withColumnRenamed("hit", "by_place"), first("sha").withColumnRenamed("hit", "by_text")
    j = chunks.join(ids, chunks.passage_id == ids.by_id, "left").join(place, ["document_id", "start", "end"], "left").join(text, "sha", "left")
    rule = F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_place").isNotNull(), "offsets").when(F.col("by_text").isNotNull(), "sha")
    return j.select("chunk_id", F.coalesce("by_id", "by_place", "by_text").alias("passage_id"), rule.alias("rule"))


def citation_audit(citations: DataFrame, candidates: DataFrame) -> DataFrame:
    """citations (qid, marker, chunk_id, page_number, text_sha256) with their violations.

    candidates (chunk_id once each, page_number, text_sha256).
    """
    known = candidates.select("chunk_id", F.col("page_number").alias("page"), F.col("text_sha256").alias("sha"), F.lit(True).alias("known"))
    j = citations.join(known, "chunk_id", "left")
    invalid, unknown = F.coalesce(F.col("page_number") < 1, F.lit(True)), F.col("known").isNull()
    flags = F.when(invalid, F.lit("CITATION_PAGE_INVALID")).when(unknown, "CITATION_CHUNK_NOT_IN_EVIDENCE")
    differ = F.concat_ws(",", F.when(~F.col("text_sha256").eqNullSafe(F.col("sha")), "CITATION_SHA_MISMATCH"), F.when(~F.col("page_number").eqNullSafe(F.col("page")), "CITATION_PAGE_MISMATCH"))
    return j.select("qid", "marker", F.coalesce(flags, differ).alias("violations"))
