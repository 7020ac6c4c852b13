"""Queries on merge traces and lineage joins, with SQL twins written on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import chunking as C
from rankwell.operators import trace
from rankwell.plans import base
from rankwell.plans.frames import _TREE, _docs, _pages, _run, _topk_sql, _vectors
from rankwell.sources import checkpoints
from rankwell.sources.folders import scratch

_DECISIONS = f"""WITH {_topk_sql(12)}, leaf AS (SELECT vec_id AS id, vec_id // 3 AS p, 10 + vec_id % 7 AS tok, vec_id % 4 = 0 AS rel FROM embeddings),
dec AS (SELECT query_id, concat('parent_', l.p) AS parent_id, count(*) AS children_retrieved, any_value(w.n) AS children_total, count(*) * 2 >= any_value(w.n) AS merged,
  CAST(sum(l.tok) AS BIGINT) AS tb, CAST(any_value(w.tok) AS BIGINT) AS wt, count_if(l.rel) AS rb, any_value(w.rel) AS wr
  FROM topk JOIN leaf l ON l.id = topk.item_id JOIN (SELECT p, count(*) AS n, sum(tok) AS tok, count_if(rel) AS rel FROM leaf GROUP BY p) w ON w.p = l.p GROUP BY query_id, l.p),
t AS (SELECT *, CASE WHEN merged THEN wt ELSE tb END AS ta, CAST(CASE WHEN merged THEN wr ELSE rb END AS BIGINT) AS ra FROM dec)"""


def _decisions(spark, d):
    i = F.col("id")
    tree = _vectors(spark, d).select(F.concat(F.lit("leaf_"), i).alias("node_id"), F.concat(F.lit("parent_"), F.floor(i / 3)).alias("parent_id"), (10 + i % 7).alias("tokens"), (i % 4 == 0).alias("relevant"))
    return trace.merge_decisions(_run(spark, d, 12).select("query_id", F.concat(F.lit("leaf_"), "item_id").alias("node_id")), tree)


def rtv11(spark, d):
    return trace.trace_ratios(_decisions(spark, d))


def jon03(spark, d):
    docs = _docs(spark, d).where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    p = docs.select(F.concat(F.lit("p"), "doc_id").alias("passage_id"), F.col("doc_id").alias("document_id"), F.lit(0).alias("start"), F.length("text").alias("end"), F.sha2("text", 256).alias("sha"))
    third = F.col("document_id") % 3
    chunks = p.select(F.concat(F.lit("c"), "document_id").alias("chunk_id"), F.when(third == 0, F.col("passage_id")).alias("passage_id"), "document_id", F.when(third == 1, 0).otherwise(-1).alias("start"), "end", "sha")
    return trace.prioritised_passages(chunks, p)


def jon12(spark, d):
    n = C.hierarchy(_pages(spark, d))
    up = n.select(F.col("node_id").alias("parent_id"), F.col("level").alias("parent_level"), F.length("text").alias("parent_chars"))
    return n.join(up, "parent_id").select("node_id", "parent_id", "parent_level", "parent_chars")


def jon14(spark, d):
    labels = spark.read.parquet(f"{d}/labels.parquet").where("doc_id is not null and quality is not null and toxic is not null")
    sha = F.sha2(F.col("doc_id").cast("string"), 256)
    cited = labels.select((F.col("doc_id") % 50).alias("qid"), F.concat(F.lit("E"), "doc_id").alias("marker"), F.when(F.col("toxic") == 1, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("chunk_id"), (F.col("doc_id") % 10 + F.col("quality")).alias("page_number"), sha.alias("text_sha256"))
    kept = _docs(spark, d).select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 10 + 1).alias("page_number"), F.when(F.col("doc_id") % 13 == 0, F.sha2(F.lit("other"), 256)).otherwise(sha).alias("text_sha256"))
    return trace.citation_audit(cited, kept)


def snk04(spark, d):
    """Pairs of query and strategy that a resumed run still has to do: odd queries were finished, in two runs of which the second repeats some."""
    work = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("strategy")).distinct()
    path = scratch(spark, "checkpoint")
    checkpoints.append_rows(work.where("query_id % 4 = 1"), path)
    checkpoints.append_rows(work.where("query_id % 2 = 1"), path)
    return checkpoints.row_keys(checkpoints.remaining(work, checkpoints.finished(work.schema, spark, path)))


base.QUERIES |= {"snk04_resume": snk04, "rtv10_merge_trace": _decisions, "rtv11_trace_ratios": rtv11, "jon03_prioritised_passages": jon03, "jon12_tree_join": jon12, "jon14_citation_audit": jon14}
base.ORACLE_SQL |= {
    "snk04_resume": "SELECT DISTINCT l_orderkey AS query_id, l_linenumber AS strategy, concat(l_orderkey, '::', l_linenumber) AS row_key FROM lineitem WHERE l_orderkey % 2 = 0",
    "rtv10_merge_trace": f"""{_DECISIONS} SELECT query_id, parent_id, children_retrieved, children_total, round(CAST(children_retrieved AS DOUBLE) / children_total, 6) AS coverage_ratio, merged, tb AS tokens_before, ta AS tokens_after, rb AS relevant_before, ra AS relevant_after FROM t""",
    "rtv11_trace_ratios": f"""{_DECISIONS} SELECT query_id, count_if(merged) AS merges_performed, count_if(NOT merged) AS merges_refused, round(CAST(count_if(merged) AS DOUBLE) / count(*), 6) AS merge_rate,
round(CAST(coalesce(sum(children_retrieved) FILTER (merged), 0) AS DOUBLE) / sum(children_retrieved), 6) AS parent_promotion_rate, round(CAST(sum(ta) AS DOUBLE) / sum(tb), 6) AS context_expansion_ratio,
CASE WHEN sum(rb) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, round(CAST(sum(ra) AS DOUBLE) / sum(rb), 6)) END AS preservation,
round(1 - CASE WHEN sum(rb) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, round(CAST(sum(ra) AS DOUBLE) / sum(rb), 6)) END, 6) AS loss FROM t GROUP BY query_id""",
    "jon03_prioritised_passages": """WITH s AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents WHERE doc_id IS NOT NULL)
SELECT concat('c', doc_id) AS chunk_id, CASE WHEN doc_id % 3 = 2 THEN min(concat('p', doc_id)) OVER (PARTITION BY sha) ELSE concat('p', doc_id) END AS passage_id, CASE doc_id % 3 WHEN 0 THEN 'id' WHEN 1 THEN 'offsets' ELSE 'sha' END AS rule FROM s""",
    "jon12_tree_join": f"""WITH {_TREE} SELECT c.node_id, c.parent_id, CAST(p.level AS INTEGER) AS parent_level, CAST(length(p.text) AS INTEGER) AS parent_chars FROM nodes c JOIN nodes p ON p.node_id = c.parent_id""",
    "jon14_citation_audit": """SELECT l.doc_id % 50 AS qid, concat('E', l.doc_id) AS marker, CASE WHEN l.doc_id % 10 + quality < 1 THEN 'CITATION_PAGE_INVALID' WHEN toxic = 1 OR d.doc_id IS NULL THEN 'CITATION_CHUNK_NOT_IN_EVIDENCE'
ELSE concat_ws(',', CASE WHEN l.doc_id % 13 = 0 THEN 'CITATION_SHA_MISMATCH' END, CASE WHEN quality <> 1 THEN 'CITATION_PAGE_MISMATCH' END) END AS violations
FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE l.doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL""",
}
