"""Scans, sinks, ingest and the filters that guard them."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankwell.functions import text as T
from rankwell.operators import evaluation as E
from rankwell.operators import filters as G
from rankwell.operators.mapping import redacted
from rankwell.plans import base as B
from rankwell.plans.base import ASKS_SQL, QRELS_SQL, RATERS_SQL, RUN_SQL, read, register
from rankwell.plans.evaluation import ANSWERED_SQL, HUMAN_SQL, METRICS, answered, human
from rankwell.plans.pooling import POOL_SQL, evidence, pooled
from rankwell.sources import files, ledger, sinks
from rankwell.sources.folders import scratch


def page_scan(pages, first: int | None = None, last: int | None = None):
    """Pages of an inclusive range, which reaches the scan: text (empty where it could not be read), size, hash, warning."""
    if first is not None:
        pages = pages.where(F.col("page_id") >= first)
    if last is not None:
        pages = pages.where(F.col("page_id") <= last)
    text, n = F.coalesce("html", F.lit("")), F.length(F.coalesce("html", F.lit("")))
    warning = F.when(F.col("html").isNull(), "EXTRACTION_ERROR").when(n < 10, "EMPTY_OR_NEAR_EMPTY").when(n < 100, "LOW_CHARACTER_COUNT")
    return pages.select("page_id", "url", n.alias("n_chars"), F.sha2(text, 256).alias("content_sha256"), warning.alias("warning"))


@register("src01_page_scan", "SELECT page_id, url, CASE WHEN html IS NULL THEN 0 ELSE length(html) END AS n_chars, sha256(ifnull(html, '')) AS content_sha256, CASE WHEN html IS NULL THEN 'EXTRACTION_ERROR' WHEN length(html) BETWEEN 0 AND 9 THEN 'EMPTY_OR_NEAR_EMPTY' WHEN length(html) BETWEEN 10 AND 99 THEN 'LOW_CHARACTER_COUNT' END AS warning FROM pages")
def src01(spark, d):
    return page_scan(read(spark, d, "pages"))


@register("src02_thin_reader", "SELECT page_id AS page_number, ifnull(html, '') AS text FROM pages")
def src02(spark, d):
    return read(spark, d, "pages").select(F.col("page_id").alias("page_number"), F.coalesce("html", F.lit("")).alias("text"))


@register("src03_tiny_corpus", "SELECT 'doc_' || doc_id AS document_id, 1 AS page_number, 'doc_' || doc_id || '_p1' AS chunk_id, text FROM documents WHERE length(trim(text)) > 0")
def src03(spark, d):
    """A corpus of nested documents and pages as one chunk a page."""
    page = F.array(F.struct(F.lit(1).alias("page_number"), "text"))
    nested = read(spark, d, "documents").select(F.array(F.struct(F.concat(F.lit("doc_"), "doc_id").alias("document_id"), page.alias("pages"))).alias("documents"))
    return files.corpus_chunks(nested).where(F.trim("text") != "")


def _raw_questions(spark, d):
    """Questions under either spelling of their keys; each tenth twice, each seventh blank."""
    i, even = F.col("item_id"), F.col("item_id") % 2 == 0
    qid, text = F.concat(F.lit("q"), i), F.when(i % 7 == 0, "  ").otherwise(F.col("text"))
    q = read(spark, d, "benchmark").select(F.when(even, qid).alias("qid"), F.when(~even, qid).alias("question_id"), F.when(even, text).alias("question"), F.when(~even, text).alias("query"), F.lit(None).cast("string").alias("split"), F.explode(F.sequence(F.lit(1), F.when(i % 10 == 0, 2).otherwise(1))).alias("copy"))
    return q.drop("copy")


@register("src04_questions", "SELECT 'q' || item_id AS qid, CASE WHEN item_id % 7 = 0 THEN '  ' ELSE text END AS question, item_id % 10 = 0 AS is_duplicate, item_id % 7 = 0 OR trim(text) = '' AS is_empty, NOT (item_id % 10 = 0 OR item_id % 7 = 0 OR trim(text) = '') AS accepted FROM benchmark, range(0, 2) AS r(copy) WHERE copy = 0 OR item_id % 10 = 0")
def src04(spark, d):
    q = files.questions_of(_raw_questions(spark, d))
    return q.select("qid", "question", "is_duplicate", "is_empty", (~F.col("is_duplicate") & ~F.col("is_empty")).alias("accepted"))


@register("src05_split_filter", "SELECT 'q' || item_id AS qid, ['development', 'test'][item_id % 2 + 1] AS split FROM benchmark WHERE item_id % 5 <> 4")
def src05(spark, d):
    i = F.col("item_id")
    split = F.when(i % 5 == 4, "query_holdout").when(i % 2 == 0, "development").otherwise("test")
    return G.HoldoutPolicy(["development", "test"]).read(read(spark, d, "benchmark").select(F.concat(F.lit("q"), i).alias("qid"), split.alias("split")))


@register("src06_passage_registry", "SELECT 'ps_' || substr(sha256('b' || item_id || ':1:0:' || length(text) || ':' || sha256(text)), 1, 16) AS passage_id, item_id, length(text) AS end_char, sha256(text) AS content_sha256 FROM benchmark WHERE text IS NOT NULL")
def src06(spark, d):
    sha = F.sha2("text", 256)
    ident = T.passage_id(F.concat(F.lit("b"), "item_id"), F.lit(1), F.lit(0), F.length("text"), sha)
    return read(spark, d, "benchmark").where("text is not null").select(ident.alias("passage_id"), "item_id", F.length("text").alias("end_char"), sha.alias("content_sha256"))


@register("src07_qrels_contract", f"""WITH {QRELS_SQL}, f AS (SELECT concat(CASE WHEN qid % 101 = 0 THEN 'Holdout_' ELSE 'q' END, qid) AS q, concat('ps_', passage) AS p, CASE WHEN passage % 97 = 0 THEN 7 ELSE grade END AS g, CASE WHEN passage % 89 = 0 THEN 'OTHER' ELSE ['NEGATIVE_CONTROL', 'CONTEXTUAL', 'SUPPORTING', 'PRIMARY'][grade + 1] END AS r FROM qrels UNION ALL SELECT 'q1', 'ps_1', 0, 'NEGATIVE_CONTROL' FROM range(0, 2))
SELECT count(*) AS n, count(*) - count(DISTINCT (q, p)) AS duplicate_pairs, count(*) FILTER (g NOT IN (0, 1, 2, 3)) AS bad_grade, count(*) FILTER (q ILIKE '%holdout%') AS holdout, count(*) FILTER (r = 'OTHER') AS bad_role, count(*) FILTER (g <> 7 AND r <> 'OTHER' AND r <> ['NEGATIVE_CONTROL', 'CONTEXTUAL', 'SUPPORTING', 'PRIMARY'][g + 1]) AS role_differs,
count(*) FILTER (g = 0) AS g0, count(*) FILTER (g = 1) AS g1, count(*) FILTER (g = 2) AS g2, count(*) FILTER (g = 3) AS g3, 'REJECTED' AS status FROM f""")
def src07(spark, d):
    """A set of judgements with faults of every kind: one row of counts, and the verdict."""
    q = B.qrels(spark, d)
    i, p = F.col("qid"), F.col("passage")
    own = q.select(F.concat(F.when(i % 101 == 0, "Holdout_").otherwise("q"), i).alias("question_id"), F.concat(F.lit("ps_"), p).alias("passage_id"), F.when(p % 97 == 0, 7).otherwise(F.col("grade")).alias("grade"), F.when(p % 89 == 0, "OTHER").otherwise(G.role_of(F.col("grade"))).alias("role"))
    twice = spark.range(2).select(F.lit("q1").alias("question_id"), F.lit("ps_1").alias("passage_id"), F.lit(0).alias("grade"), F.lit("NEGATIVE_CONTROL").alias("role"))
    return files.qrels_report(own.unionByName(twice))


@register("src08_annotation_export", """WITH e AS (SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 20 = 0), x AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS k, quality FROM e)
SELECT v AS violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN doc_id % 17 = 0 THEN 'WRONG_ANNOTATOR' END, CASE WHEN k > 1 THEN 'DUPLICATE_PAIR' END, CASE WHEN doc_id % 13 = 0 THEN 'HOLDOUT' END, CASE WHEN quality IS NULL OR doc_id % 11 = 0 THEN 'BAD_GRADE' END, CASE WHEN doc_id % 19 = 0 THEN 'NOT_BLIND' END], lambda x: x IS NOT NULL)) AS v FROM x) GROUP BY v""")
def src08(spark, d):
    """An annotator's export with faults: how many rows each check refuses."""
    l = read(spark, d, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    rows = l.unionByName(l.where("doc_id % 20 = 0")).select(
        F.when(i % 17 == 0, "annotator_b").otherwise("annotator_a").alias("annotator_id"), F.concat(F.when(i % 13 == 0, "HOLDOUT_").otherwise("q"), i).alias("question_id"), F.concat(F.lit("ps_"), i).alias("passage_id"),
        F.when(i % 11 == 0, 9).otherwise(F.col("quality")).alias("grade"), F.when(i % 19 == 0, "ranked first by the strategy").otherwise("").alias("notes"),
    )
    return files.export_violations(rows, "annotator_a").select(F.explode(F.split("violations", ",")).alias("violation")).where("violation <> ''").groupBy("violation").agg(F.count("*").alias("n"))


@register("src09_adjudication_scan", f"""WITH {RATERS_SQL} SELECT item, concat_ws(',', CASE WHEN item % 4 = 1 THEN 'NOT_COMPLETED' END, CASE WHEN item % 9 = 0 THEN 'BAD_GRADE' END, CASE WHEN item % 5 = 0 THEN 'NO_REASONING' END) AS violations FROM raters WHERE a <> b""")
def src09(spark, d):
    i = F.col("item")
    rows = B.raters(spark, d).where("a <> b").select("item", F.when(i % 4 == 1, "PENDING").otherwise("COMPLETED").alias("status"), F.when(i % 9 == 0, None).otherwise(F.greatest("a", "b")).alias("grade"), F.when(i % 5 == 0, " \n").otherwise("seen again").alias("reasoning"))
    return files.adjudication_violations(rows).select("item", "violations")


@register("src10_result_matrix", f"""WITH {RUN_SQL}, m AS (SELECT strategy, qid, concat('[E', CASE WHEN qid % 50 = 0 THEN 'x' ELSE '1' END, ']') AS c FROM run WHERE rank = 1 AND NOT (strategy = 2 AND qid % 40 = 0) UNION ALL SELECT strategy, qid, '[E1]' FROM run WHERE rank = 1 AND strategy = 5 AND qid % 30 = 0),
q AS (SELECT count(DISTINCT qid) AS n FROM run) SELECT strategy, count(*) AS n_rows, count(DISTINCT qid) AS n_questions, count(*) - count(DISTINCT qid) AS duplicates, (SELECT n FROM q) - count(DISTINCT qid) AS missing, count_if(NOT regexp_matches(c, '^\\[E[0-9]+\\]$')) AS bad_citations,
count(*) = count(DISTINCT qid) AND (SELECT n FROM q) = count(DISTINCT qid) AND count_if(NOT regexp_matches(c, '^\\[E[0-9]+\\]$')) = 0 AS valid FROM m GROUP BY strategy""")
def src10(spark, d):
    """A matrix of results by strategy and question with gaps, repeats and bad citation ids."""
    top = B.run(spark, d).where("rank = 1").select("strategy", "qid")
    marker = F.when(F.col("qid") % 50 == 0, "[Ex]").otherwise("[E1]")
    rows = top.where("not (strategy = 2 and qid % 40 = 0)").withColumn("citation", marker).unionByName(top.where("strategy = 5 and qid % 30 = 0").withColumn("citation", F.lit("[E1]")))
    asked = B.run(spark, d).agg(F.count_distinct("qid").alias("asked"))
    c = rows.groupBy("strategy").agg(F.count("*").alias("n_rows"), F.count_distinct("qid").alias("n_questions"), F.count_if(~F.col("citation").rlike(r"^\[E[0-9]+\]$")).alias("bad_citations")).crossJoin(F.broadcast(asked))  # one row
    dup, missing = F.col("n_rows") - F.col("n_questions"), F.col("asked") - F.col("n_questions")
    return c.select("strategy", "n_rows", "n_questions", dup.alias("duplicates"), missing.alias("missing"), "bad_citations", ((dup == 0) & (missing == 0) & (F.col("bad_citations") == 0)).alias("valid"))


@register("src11_evidence_errors", f"""WITH {RUN_SQL}, e AS (SELECT strategy, qid, rank, list_filter([CASE WHEN passage % 50 = 0 THEN 'SCORE_MISSING' WHEN passage % 60 = 0 THEN 'SCORE_NEGATIVE' END, CASE WHEN passage % 70 = 0 THEN 'PASSAGE_NOT_CANONICAL' END, CASE WHEN passage % 80 = 0 THEN 'BAD_SHA' END, CASE WHEN passage % 90 = 0 THEN 'NO_PAGES' END, CASE WHEN passage % 55 = 0 THEN 'POST_RANK_OF_UNRANKED' END], lambda x: x IS NOT NULL) AS l FROM run)
SELECT strategy, qid, rank, unnest(l) AS error FROM e""")
def src11(spark, d):
    """Every fault of every evidence row, a row for each."""
    p = F.col("passage")
    rows = B.run(spark, d).select(
        "strategy", "qid", "rank", F.when(p % 50 == 0, None).when(p % 60 == 0, -1.0).otherwise(F.col("score")).alias("score"), F.concat(F.when(p % 70 == 0, "x_").otherwise("ps_"), p).alias("passage_id"),
        F.when(p % 80 == 0, "12ab").otherwise(F.sha2(p.cast("string"), 256)).alias("sha"), F.when(p % 90 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1))).alias("pages"), F.lit(False).alias("reranked"), F.when(p % 55 == 0, 1).alias("post_rank"),
    )
    return files.evidence_errors(rows).select("strategy", "qid", "rank", "error")


@register("src12_silver_equality", f"""WITH {POOL_SQL}, silver AS (SELECT qid, passage FROM pool WHERE passage % 31 <> 0 UNION ALL SELECT qid, 0 FROM pool WHERE passage % 37 = 0 UNION ALL SELECT qid, passage FROM pool WHERE passage % 41 = 0 AND passage % 31 <> 0), s AS (SELECT DISTINCT * FROM silver)
SELECT (SELECT count(*) FROM (SELECT qid, passage FROM pool EXCEPT SELECT * FROM s)) AS only_pool, (SELECT count(*) FROM (SELECT * FROM s EXCEPT SELECT qid, passage FROM pool)) AS only_silver, (SELECT count(*) FROM (SELECT * FROM s INTERSECT SELECT qid, passage FROM pool)) AS both, (SELECT count(*) FROM silver) - (SELECT count(*) FROM s) AS repeated, 'REJECTED' AS status""")
def src12(spark, d):
    """A silver run against the pool that it should cover pair by pair."""
    p = pooled(spark, d).select("qid", "passage")
    silver = p.where("passage % 31 <> 0").unionByName(p.where("passage % 37 = 0").select("qid", F.lit(0).cast("long").alias("passage"))).unionByName(p.where("passage % 41 = 0 and passage % 31 <> 0"))
    s = silver.groupBy("qid", "passage").agg(F.count("*").alias("n"))
    j = p.withColumn("asked", F.lit(True)).join(s, ["qid", "passage"], "full_outer")
    a, b = F.col("asked").isNotNull(), F.col("n").isNotNull()
    c = j.agg(F.count_if(a & ~b).alias("only_pool"), F.count_if(b & ~a).alias("only_silver"), F.count_if(a & b).alias("both"), F.sum(F.col("n") - 1).alias("repeated"))
    return c.withColumn("status", F.when(F.col("only_pool") + F.col("only_silver") + F.col("repeated") == 0, "ACCEPTED").otherwise("REJECTED"))


def _envelopes(spark, d):
    """Sealed states of users; some lost their hash, some were changed."""
    u = F.col("user_id")
    data = F.concat(F.lit('{"n": '), F.count("*"), F.lit(', "user_id": '), u, F.lit("}"))
    e = read(spark, d, "events").where("user_id is not null").groupBy("user_id").agg(data.alias("state"))
    seal = sinks.sealed(F.col("state"))
    return e.select("user_id", F.when(u % 7 == 0, F.col("state")).when(u % 5 == 0, F.replace(seal, F.lit('"n": '), F.lit('"n": 1'))).otherwise(seal).alias("envelope"))


@register("src13_checkpoint_scan", """SELECT user_id, CASE WHEN user_id % 7 = 0 THEN 'NO_ENVELOPE' WHEN user_id % 5 = 0 THEN 'CORRUPT' ELSE 'VALID' END AS status, CASE WHEN user_id % 7 <> 0 AND user_id % 5 <> 0 THEN count(*) END AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id""")
def src13(spark, d):
    data, status = sinks.unsealed(F.col("envelope"))
    return _envelopes(spark, d).select("user_id", status.alias("status"), F.get_json_object(data, "$.n").cast("long").alias("n"))


@register("src14_ledger_scan", """SELECT user_id, count(*) AS n, count_if(event_type = 'error') AS other_policy, count_if(event_type <> 'error' AND event_id % 9 = 0) AS other_config, count_if(event_type <> 'error' AND event_id % 9 <> 0) AS compatible, max(CASE WHEN event_type <> 'error' AND event_id % 9 <> 0 THEN event_id END) AS last_event FROM events WHERE event_type IS NOT NULL GROUP BY user_id""")
def src14(spark, d):
    """Ledger lines of each run that its policy and configuration may continue."""
    i, policy = F.col("event_id"), F.col("event_type") != "error"
    status = F.when(~policy, "POLICY").when(i % 9 == 0, "CONFIG").otherwise("OK")
    e = read(spark, d, "events").where("event_type is not null").withColumn("s", status)
    is_ = lambda x: F.col("s") == x
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(is_("POLICY")).alias("other_policy"), F.count_if(is_("CONFIG")).alias("other_config"), F.count_if(is_("OK")).alias("compatible"), F.max(F.when(is_("OK"), i)).alias("last_event"))


@register("src15_replay_input", f"WITH {HUMAN_SQL} SELECT qid, strategy::VARCHAR AS strategy, metric, round(value, 6) AS value FROM (SELECT qid, strategy, recall, mrr, ndcg FROM human) UNPIVOT (value FOR metric IN (recall, mrr, ndcg))")
def src15(spark, d):
    """Nested results of each question, a map of strategies to a map of metrics, as long rows."""
    scores = F.map_from_arrays(F.array(*map(F.lit, ("recall", "mrr", "ndcg"))), F.array("recall", "mrr", "ndcg"))
    nested = human(spark, d).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("strategy").cast("string").alias("k"), scores.alias("v")))).alias("results"))
    return files.replay_rows(nested).withColumn("value", F.round("value", 6))


@register("src16_inventory")
def src16(spark, d):
    """name, bytes and hash of the files of two small tables."""
    both = [files.inventory(spark, f"{d}/{t}.parquet") for t in ("region", "nation")]
    return both[0].unionByName(both[1]).withColumn("path", F.substring_index("path", "/", -1))


@register("src17_directory_reader", "SELECT 'doc_' || doc_id AS document_id, 1 AS page_number, length(text) AS n_chars FROM documents WHERE length(trim(text)) > 0 AND length(text) > 499")
def src17(spark, d):
    """Pages of documents with enough text in all; blank pages go, provenance stays."""
    p = read(spark, d, "documents").where(F.trim("text") != "").select(F.concat(F.lit("doc_"), "doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.length("text").alias("n_chars"))
    return p.withColumn("total", F.sum("n_chars").over(Window.partitionBy("document_id"))).where("total >= 500").drop("total")


@register("snk01_json_lines", f"WITH {QRELS_SQL} SELECT qid, passage, grade FROM qrels")
def snk01(spark, d):
    return sinks.write_json(B.qrels(spark, d), scratch(spark, "qrels-json"))


@register("snk02_csv", f"WITH {HUMAN_SQL} SELECT strategy::VARCHAR AS strategy, qid::VARCHAR AS qid, status, CASE WHEN recall IS NULL THEN 'NA' ELSE 'value' END AS recall, (strategy || ';' || qid) AS keys FROM human")
def snk02(spark, d):
    """CSV with NA for null and lists joined by semicolons, read back as text."""
    path = scratch(spark, "metrics-csv")
    files.write_csv(human(spark, d).select("strategy", "qid", "status", "recall", F.array(F.col("strategy").cast("string"), F.col("qid").cast("string")).alias("keys")), path)
    back = spark.read.option("header", True).csv(path)
    return back.withColumn("recall", F.when(F.col("recall") == "NA", "NA").otherwise("value"))


@register("snk03_sealed_state", "SELECT user_id, '{\"n\": ' || count(*) || ', \"user_id\": ' || user_id || '}' AS state, 'VALID' AS status FROM events WHERE user_id IS NOT NULL GROUP BY user_id")
def snk03(spark, d):
    """States written in sealed envelopes, read back and verified."""
    path = scratch(spark, "states")
    u = F.col("user_id")
    state = F.concat(F.lit('{"n": '), F.count("*"), F.lit(', "user_id": '), u, F.lit("}"))
    read(spark, d, "events").where("user_id is not null").groupBy("user_id").agg(state.alias("state")).select("user_id", sinks.sealed(F.col("state")).alias("envelope")).write.parquet(path)
    data, status = sinks.unsealed(F.col("envelope"))
    return spark.read.parquet(path).select("user_id", data.alias("state"), status.alias("status"))


@register("snk05_ledger", "WITH a AS (SELECT event_id FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id FROM events WHERE event_id % 2 = 0) SELECT 1 AS batch, 'APPENDED' AS status, (SELECT count(*) FROM a) AS n UNION ALL SELECT 2, 'APPENDED', (SELECT count(*) FROM b WHERE event_id % 3 = 0) UNION ALL SELECT 2, 'CONFLICT_WITH_LEDGER', (SELECT count(*) FROM b WHERE event_id % 3 <> 0) UNION ALL SELECT 2, 'CONFLICT_IN_BATCH', (SELECT count(*) FROM b WHERE event_id % 30 = 0)")
def snk05(spark, d):
    """Two batches into an append-only ledger; the second overlaps the first and repeats itself."""
    path = scratch(spark, "ledger")
    e = read(spark, d, "events").select("event_id", "user_id", "event_type")
    second = e.where("event_id % 2 = 0").unionByName(e.where("event_id % 30 = 0").withColumn("event_type", F.lit("zz")))
    one, two = sinks.append_ledger(e.where("event_id % 3 <> 0"), path, ["event_id"]), sinks.append_ledger(second, path, ["event_id"])
    return one.select(F.lit(1).alias("batch"), "status", "n").unionByName(two.select(F.lit(2).alias("batch"), "status", "n"))


def _matrix(spark, d):
    """Results of all strategies for all questions, whole and in order; ids are canonical, answers cite."""
    qs, strategies = B.run(spark, d).select("qid").distinct(), spark.range(1, 8).select(F.col("id").alias("strategy"))
    top = B.run(spark, d).where("rank <= 2").groupBy("qid", F.col("strategy").cast("long").alias("strategy")).agg(F.array_sort(F.collect_list(F.concat(F.lit("ps_"), "passage"))).alias("passage_ids"))
    j = qs.crossJoin(F.broadcast(strategies)).join(top, ["qid", "strategy"], "left")  # seven labels
    none = F.array().cast("array<string>")
    abstained = F.col("passage_ids").isNull()
    return j.select("strategy", F.concat(F.lit("q"), "qid").alias("qid"), F.when(abstained, "").otherwise(F.concat(F.lit("see "), F.array_join("passage_ids", " and "))).alias("answer"), abstained.alias("abstained"), F.when(abstained, none).otherwise(F.array(F.lit("E1"))).alias("citations"), F.coalesce("passage_ids", none).alias("passage_ids"))


_MATRIX_SQL = f"""{RUN_SQL}, m AS (SELECT s AS strategy, 'q' || q.qid AS qid, (SELECT list('ps_' || passage ORDER BY 'ps_' || passage) FROM run r WHERE r.qid = q.qid AND r.strategy = s AND rank <= 2) AS p FROM (SELECT DISTINCT qid FROM run) q, range(1, 8) AS t(s))"""


@register("snk06_artefact", f"WITH {_MATRIX_SQL} SELECT strategy, qid, CASE WHEN p IS NULL THEN '' ELSE 'see ' || array_to_string(p, ' and ') END AS answer, p IS NULL AS abstained, coalesce(len(p), 0) AS n_passages FROM m")
def snk06(spark, d):
    """The result matrix, audited, written and read back."""
    rows = _matrix(spark, d)
    n = rows.select("qid").distinct().count()
    return sinks.write_artefact(rows, scratch(spark, "artefact"), 7, n).select("strategy", "qid", "answer", "abstained", F.size("passage_ids").alias("n_passages"))


@register("snk06_audit", f"WITH {_MATRIX_SQL}, x AS (SELECT count(*) AS n FROM m WHERE strategy = 2 AND qid LIKE '%7') SELECT 'row_count' AS gate, n AS violations FROM x UNION ALL SELECT 'duplicate_pairs', n FROM x UNION ALL SELECT 'holdout', 0 UNION ALL SELECT 'answers_without_citation', 0 UNION ALL SELECT 'non_canonical_ids', 0 UNION ALL SELECT 'secrets', n FROM x")
def snk06_audit(spark, d):
    """What the audit says of a matrix with repeated rows that hold a secret."""
    rows = _matrix(spark, d)
    bad = rows.where("strategy = 2 and qid like '%7'").withColumn("answer", F.lit("api_key: abc"))
    n = rows.select("qid").distinct().count()
    return sinks.audit(rows.unionByName(bad), 7, n)


@register("snk07_report", f"WITH {ANSWERED_SQL}, tbl AS (SELECT strategy, count(*) AS questions, count_if(abstained) AS abstained, round(avg(recall), 4) AS r FROM answered GROUP BY strategy) SELECT 1 AS line, '# Strategies' AS text UNION ALL SELECT 2, '| strategy | questions | abstained |' UNION ALL SELECT 3, '|---|---|---|' UNION ALL SELECT 3 + row_number() OVER (ORDER BY strategy), format('| {{}} | {{}} | {{}} |', strategy, questions, abstained) FROM tbl")
def snk07(spark, d):
    s = answered(spark, d).groupBy("strategy").agg(F.count("*").alias("questions"), F.count_if("abstained").alias("abstained"))
    return sinks.markdown(s, "Strategies", ["strategy"])


@register("ing02_page_audit", "SELECT source, doc_id, length(text) AS char_count, sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sha256(text) AS content_sha256, CASE WHEN length(text) < 10 THEN 'EMPTY_OR_NEAR_EMPTY' WHEN length(text) < 100 THEN 'LOW_CHARACTER_COUNT' END AS warning FROM documents WHERE text IS NOT NULL".replace("sum(length(text) + 1)", "coalesce(sum(length(text) + 1)").replace(" AS before", ", 0)::BIGINT AS char_start"))
def ing02(spark, d):
    """Sizes, running offsets within a source, hashes and warnings.

    A source may hold a third of all rows: offsets are summed within ranges of ids first,
    and the ranges' totals, which are few, make up the rest.
    """
    p = read(spark, d, "documents").where("text is not null").select("source", "doc_id", "text", F.length("text").alias("char_count"))
    return running_offsets(p, "source", "doc_id", F.col("char_count") + 1, 100_000).select("source", "doc_id", "char_count", F.col("offset").alias("char_start"), F.sha2("text", 256).alias("content_sha256"), F.when(F.col("char_count") < 10, "EMPTY_OR_NEAR_EMPTY").when(F.col("char_count") < 100, "LOW_CHARACTER_COUNT").alias("warning"))


def running_offsets(df, group: str, key: str, size, span: int):
    """df with offset: the sum of size over rows of the group before this one by key.

    Rows are summed within ranges of span keys (key is a whole number), and the totals of
    a group's ranges, some millions of times fewer than rows at scale, before them.
    """
    rows = df.withColumn("size", size).withColumn("part", F.floor(F.col(key) / span))
    total = rows.groupBy(group, "part").agg(F.sum("size").alias("total"))
    before = total.select(group, "part", (F.sum("total").over(Window.partitionBy(group).orderBy("part")) - F.col("total")).alias("before"))
    own = F.sum("size").over(Window.partitionBy(group, "part").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    same = rows[group].eqNullSafe(before[group]) & (rows["part"] == before["part"])
    return rows.withColumn("own", own).join(before.withColumnRenamed(group, "g").withColumnRenamed("part", "p"), F.col(group).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p"))).withColumn("offset", F.col("own") + F.col("before"))


@register("ing03_corpus_audit", """SELECT lang, count(*) AS n_pages, count_if(length(text) < 50) AS n_empty, count_if(length(text) < 200) AS n_low, min(length(text)) AS min_chars, max(length(text)) AS max_chars, round(avg(length(text)), 4) AS mean_chars, list(length(text) ORDER BY length(text))[count(*) // 2 + 1] AS median_chars,
round(100 * count_if(length(text) >= 50)::DOUBLE / count(*), 4) AS extractable_pct FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def ing03(spark, d):
    """Sizes by language.  The median is the upper of two middles, found by counting equal lengths."""
    p = read(spark, d, "documents").where("text is not null").select("lang", F.length("text").alias("n"))
    n = F.col("n")
    stats = p.groupBy("lang").agg(F.count("*").alias("n_pages"), F.count_if(n < 50).alias("n_empty"), F.count_if(n < 200).alias("n_low"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.round(F.avg(n), 4).alias("mean_chars"), F.round(100 * B.share(F.count_if(n >= 50), F.count("*")), 4).alias("extractable_pct"))
    runs = p.groupBy("lang", "n").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("lang").orderBy("n")))
    middle = runs.join(stats.select(F.col("lang").alias("l"), "n_pages"), F.col("lang").eqNullSafe(F.col("l"))).where(F.col("upto") > F.floor(F.col("n_pages") / 2)).groupBy("l").agg(F.min("n").alias("median_chars"))
    return stats.join(middle, F.col("lang").eqNullSafe(F.col("l"))).drop("l")


@register("ing03_recurring_lines", r"""WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls FROM documents WHERE text IS NOT NULL), e AS (SELECT 'first' AS place, ls[1] AS line FROM x WHERE len(ls) > 0 UNION ALL SELECT 'last', ls[-1] FROM x WHERE len(ls) > 0) SELECT place, line, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 5""")
def ing03_lines(spark, d):
    """First and last lines that at least five pages share: running heads and feet."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    p = read(spark, d, "documents").where("text is not null").select(lines.alias("l")).where(F.size("l") > 0)
    ends = F.explode(F.array(F.struct(F.lit("first").alias("place"), F.col("l")[0].alias("line")), F.struct(F.lit("last").alias("place"), F.element_at("l", -1).alias("line")))).alias("e")
    return p.select(ends).select("e.*").groupBy("place", "line").agg(F.count("*").alias("n")).where("n >= 5")


@register("flt01_holdout_guard", "SELECT 'q' || item_id AS qid FROM benchmark WHERE item_id % 7 <> 3")
def flt01(spark, d):
    i = F.col("item_id")
    return read(spark, d, "benchmark").select(F.concat(F.when(i % 7 == 3, "x_HoldOut_").otherwise("q"), i).alias("qid")).where(G.no_holdout(F.col("qid")))


@register("flt02_holdout_policy", "SELECT s AS split, count(*) AS n, 'tuning' AS purpose, s <> 'query_holdout' AS granted FROM (SELECT CASE WHEN item_id % 5 = 4 THEN 'query_holdout' WHEN item_id % 2 = 0 THEN 'development' ELSE 'test' END AS s FROM benchmark) GROUP BY s")
def flt02(spark, d):
    i = F.col("item_id")
    split = F.when(i % 5 == 4, "query_holdout").when(i % 2 == 0, "development").otherwise("test")
    return G.HoldoutPolicy(["development", "test"]).log(read(spark, d, "benchmark").select(split.alias("split")), "tuning")


@register("flt07_secret_scan", r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(api[_-]?key|authorization|bearer|password|secret|token)\s*[:=]') THEN '[REDACTED]' ELSE left(text, 80) END AS preview FROM documents""")
def flt07(spark, d):
    return read(spark, d, "documents").select("doc_id", redacted(F.col("text")).alias("preview"))


@register("flt08_span_containment", f"WITH {ASKS_SQL}, s AS (SELECT conv_id, turn, answer, CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN upper(substr(answer, 3, 20)) WHEN 2 THEN substr(answer, 3, 20) || '~' ELSE substr(answer, 3, 20) END AS span FROM asks) SELECT conv_id, turn, position(span IN answer) > 0 OR span = '' AS literal FROM s")
def flt08(spark, d):
    """Claimed spans: empty, in capitals, with a tail, or literal."""
    a, k = F.col("answer"), F.col("conv_id") % 4
    own = F.substring(a, 3, 20)
    span = F.when(k == 0, "").when(k == 1, F.upper(own)).when(k == 2, F.concat(own, F.lit("~"))).otherwise(own)
    return B.asks(spark, d).select("conv_id", "turn", ((span == "") | F.contains(a, span)).alias("literal"))


@register("flt09_role_grade", f"WITH {QRELS_SQL}, c AS (SELECT qid, passage, grade, CASE WHEN passage % 6 = 0 THEN (grade + 1) % 4 ELSE grade END AS claimed, passage % 12 = 0 AS noted FROM qrels) SELECT qid, passage, grade, ['NEGATIVE_CONTROL', 'CONTEXTUAL', 'SUPPORTING', 'PRIMARY'][claimed + 1] AS role, CASE WHEN claimed = grade THEN 'COMPATIBLE' WHEN noted THEN 'DIVERGENT_WITH_NOTES' ELSE 'DIVERGENT_WITHOUT_NOTES' END AS status FROM c")
def flt09(spark, d):
    """Roles that annotators claimed against those their grades imply; divergence needs notes."""
    p, g = F.col("passage"), F.col("grade")
    c = B.qrels(spark, d).select("qid", "passage", "grade", G.role_of(F.when(p % 6 == 0, (g + 1) % 4).otherwise(g)).alias("role"), F.when(p % 12 == 0, "because").otherwise(" ").alias("notes"))
    status = F.when(F.col("role") == G.role_of(F.col("grade")), "COMPATIBLE").when(F.trim("notes") != "", "DIVERGENT_WITH_NOTES").otherwise("DIVERGENT_WITHOUT_NOTES")
    return c.select("qid", "passage", "grade", "role", status.alias("status"))


@register("flt10_export_validation", """WITH q AS (SELECT doc_id FROM documents), l AS (SELECT doc_id, quality FROM labels WHERE doc_id % 21 <> 0 UNION ALL SELECT -doc_id, quality FROM labels WHERE doc_id % 33 = 1 UNION ALL SELECT doc_id, 5 FROM labels WHERE doc_id % 44 = 2)
SELECT (SELECT count(*) FROM l) AS n, (SELECT count(*) FROM q WHERE doc_id NOT IN (SELECT doc_id FROM l)) AS not_covered, (SELECT count(*) FROM (SELECT doc_id FROM l EXCEPT SELECT doc_id FROM q)) AS unknown, (SELECT count(*) FROM l WHERE quality NOT BETWEEN 0 AND 3) AS bad_grade, (SELECT count(*) - count(DISTINCT doc_id) FROM l) AS repeated""")
def flt10(spark, d):
    """An export against its queue: covered, unknown, repeated and badly graded items."""
    q, l = read(spark, d, "documents").select("doc_id").distinct(), read(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"))
    rows = l.where("doc_id % 21 <> 0").unionByName(l.where("doc_id % 33 = 1").withColumn("doc_id", -F.col("doc_id"))).unionByName(l.where("doc_id % 44 = 2").withColumn("quality", F.lit(5)))
    per = rows.groupBy("doc_id").agg(F.count("*").alias("k"), F.count_if(~F.col("quality").between(0, 3)).alias("bad"))
    j = q.withColumn("asked", F.lit(True)).join(per, "doc_id", "full_outer")
    has = F.col("k").isNotNull()
    return j.agg(F.sum("k").alias("n"), F.count_if(~has).alias("not_covered"), F.count_if(F.col("asked").isNull()).alias("unknown"), F.sum("bad").alias("bad_grade"), F.sum(F.col("k") - 1).alias("repeated"))


@register("flt11_package_validation", f"""WITH {RATERS_SQL}, p AS (SELECT item, item % 6 = 0 AS unanswerable, CASE WHEN item % 5 = 0 THEN 'yes' END AS gold, a AS g, item % 4 = 0 AS template, item % 11 = 0 AS named FROM raters)
SELECT item, concat_ws(',', CASE WHEN template AND g > 0 THEN 'TEMPLATE_WITH_GRADE' END, CASE WHEN NOT template AND named THEN 'NO_ANNOTATOR' END, CASE WHEN NOT template AND unanswerable AND gold = 'yes' THEN 'UNANSWERABLE_WITH_GOLD_ANSWER' END, CASE WHEN NOT template AND unanswerable AND g >= 1 THEN 'UNANSWERABLE_WITH_EVIDENCE' END, CASE WHEN NOT template AND NOT unanswerable AND g < 1 THEN 'ANSWERABLE_WITHOUT_EVIDENCE' END) AS violations FROM p""")
def flt11(spark, d):
    """Packages: a template must be blank, a completed one consistent."""
    i, g = F.col("item"), F.col("a")
    blank, closed, none = i % 4 == 0, i % 4 != 0, i % 6 == 0
    checks = {
        "TEMPLATE_WITH_GRADE": blank & (g > 0), "NO_ANNOTATOR": closed & (i % 11 == 0), "UNANSWERABLE_WITH_GOLD_ANSWER": closed & none & (i % 5 == 0),
        "UNANSWERABLE_WITH_EVIDENCE": closed & none & (g >= 1), "ANSWERABLE_WITHOUT_EVIDENCE": closed & ~none & (g < 1),
    }
    return B.raters(spark, d).select("item", G.violations(**checks).alias("violations"))


@register("flt12_silver_records", f"""WITH {RATERS_SQL} SELECT item, concat_ws(',', CASE WHEN item % 8 = 0 THEN 'BAD_LABEL_SOURCE' END, CASE WHEN item % 9 = 0 THEN 'BAD_GRADE' END, CASE WHEN item % 9 <> 0 AND item % 10 = 0 THEN 'ROLE_DIFFERS' END, CASE WHEN item % 11 = 0 THEN 'CONFIDENCE_OUT_OF_RANGE' END, CASE WHEN item % 12 = 0 THEN 'SPAN_NOT_LITERAL' END, CASE WHEN item % 13 = 0 THEN 'MODEL_BANNED' END) AS violations FROM raters""")
def flt12(spark, d):
    i = F.col("item")
    rows = B.raters(spark, d).select(
        "item", F.when(i % 8 == 0, "HUMAN").otherwise("SILVER").alias("label_source"), F.when(i % 9 == 0, 4).otherwise(F.col("a")).alias("grade"), F.when(i % 10 == 0, "NONE").otherwise(G.role_of(F.col("a"))).alias("role"),
        F.when(i % 11 == 0, -0.1).otherwise(0.7).alias("confidence"), F.when(i % 12 == 0, "Passage").otherwise("passage").alias("span"), F.lit("a passage").alias("text"), F.when(i % 13 == 0, "hash-judge").otherwise("judge").alias("model"),
    )
    return files.silver_violations(rows, banned=["hash-judge"]).select("item", "violations")


@register("flt13_artifact_audit", f"""WITH {ANSWERED_SQL}, tbl AS (SELECT strategy, qid, recall, mrr, ndcg, round(recall, 4) + CASE WHEN qid % 25 = 0 THEN 0.01 ELSE 0 END AS s_recall, CASE WHEN qid % 31 = 0 THEN NULL ELSE round(mrr, 4) END AS s_mrr, round(ndcg, 4) AS s_ndcg FROM answered)
SELECT strategy, count(*) AS n, count_if(recall IS NOT NULL AND qid % 25 = 0) AS recall_differs, count_if(mrr IS NOT NULL AND qid % 31 = 0) AS mrr_differs, 0 AS ndcg_differs FROM tbl GROUP BY strategy""")
def flt13(spark, d):
    """A stored artefact against metrics computed anew from run and judgements; each 25th recall was changed, each 31st mrr is lost."""
    q = F.col("qid")
    stored = human(spark, d).select("strategy", "qid", (F.round("recall", 4) + F.when(q % 25 == 0, 0.01).otherwise(0.0)).alias("s_recall"), F.when(q % 31 != 0, F.round("mrr", 4)).alias("s_mrr"), F.round("ndcg", 4).alias("s_ndcg"))
    anew = E.human_metrics(B.run(spark, d), B.qrels(spark, d), 5, F.col("passage") % 10 != 9).select("strategy", "qid", "recall", "mrr", "ndcg")
    j = stored.join(anew, ["strategy", "qid"])
    differs = lambda m: F.count_if(~F.coalesce(F.abs(F.col(m) - F.col(f"s_{m}")) <= 1e-3, F.col(m).isNull() & F.col(f"s_{m}").isNull())).alias(f"{m}_differs")
    return j.groupBy("strategy").agg(F.count("*").alias("n"), *map(differs, ("recall", "mrr", "ndcg")))


@register("flt14_smoke_gate", f"""WITH {ANSWERED_SQL}, r AS (SELECT strategy, qid, abstained, answerable, retrieved, unresolved, CASE WHEN abstained THEN 0 WHEN qid % 9 = 0 THEN 0 ELSE 1 END AS citations, CASE WHEN qid % 13 = 0 THEN 9 ELSE retrieved END AS cited_pages FROM answered),
f AS (SELECT *, list_filter([CASE WHEN retrieved = 0 THEN 'NO_EVIDENCE' END, CASE WHEN unresolved > 0 THEN 'UNRESOLVED_MAPPING' END, CASE WHEN NOT abstained AND citations = 0 THEN 'ANSWER_WITHOUT_CITATION' END, CASE WHEN cited_pages > retrieved THEN 'CITATION_OUTSIDE_EVIDENCE' END], lambda x: x IS NOT NULL) AS failures FROM r)
SELECT strategy, qid, array_to_string(failures, ',') AS failures, CASE WHEN len(failures) > 0 THEN 'SMOKE_FAILED' WHEN abstained THEN 'SMOKE_ABSTENTION_OK' ELSE 'SMOKE_POSITIVE_OK' END AS gate FROM f""")
def flt14(spark, d):
    """Every failure of each result, and the gate that it passes."""
    q, ab = F.col("qid"), F.col("abstained")
    r = answered(spark, d).withColumn("citations", F.when(ab | (q % 9 == 0), 0).otherwise(1)).withColumn("cited", F.when(q % 13 == 0, 9).otherwise(F.col("retrieved")))
    failures = G.violations(NO_EVIDENCE=F.col("retrieved") == 0, UNRESOLVED_MAPPING=F.col("unresolved") > 0, ANSWER_WITHOUT_CITATION=~ab & (F.col("citations") == 0), CITATION_OUTSIDE_EVIDENCE=F.col("cited") > F.col("retrieved"))
    done = r.select("strategy", "qid", "abstained", failures.alias("failures"))
    return done.withColumn("gate", F.when(F.col("failures") != "", "SMOKE_FAILED").when(F.col("abstained"), "SMOKE_ABSTENTION_OK").otherwise("SMOKE_POSITIVE_OK")).drop("abstained")


@register("flt15_run_ids", "SELECT user_id, CASE user_id % 5 WHEN 0 THEN '../run' WHEN 1 THEN 'run 1' WHEN 2 THEN '' ELSE 'run_' || user_id END AS run_id, CASE user_id % 5 WHEN 0 THEN 'PATH_ESCAPES' WHEN 1 THEN 'BAD_SYNTAX' WHEN 2 THEN 'BAD_SYNTAX' ELSE CASE WHEN user_id % 7 = 0 THEN 'RESUME_INCOMPATIBLE' ELSE 'OK' END END AS status FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)")
def flt15(spark, d):
    """Run ids: plain names only, no way out of the folder, and resumed only under the same configuration."""
    u = F.col("user_id")
    ident = F.when(u % 5 == 0, "../run").when(u % 5 == 1, "run 1").when(u % 5 == 2, "").otherwise(F.concat(F.lit("run_"), u))
    e = read(spark, d, "events").where("user_id is not null").select("user_id").distinct().select("user_id", ident.alias("run_id"), F.when(u % 7 == 0, "other").otherwise("same").alias("config"))
    r = F.col("run_id")
    status = F.when(F.contains(r, F.lit("..")) | F.contains(r, F.lit("/")), "PATH_ESCAPES").when(~r.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"), "BAD_SYNTAX").when(F.col("config") != "same", "RESUME_INCOMPATIBLE").otherwise("OK")
    return e.select("user_id", "run_id", status.alias("status"))


@register("flt17_config_fingerprint", """WITH c AS (SELECT event_type, '{"chunk_size":512,"strategy":"' || event_type || '","top_k":' || length(event_type) || '}' AS json FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)) SELECT event_type, sha256(json) AS fingerprint, CASE WHEN length(event_type) > 7 THEN 'TOP_K_TOO_LARGE' ELSE 'OK' END AS status FROM c""")
def flt17(spark, d):
    """Configurations of a run: checked, and named by the hash of their sorted JSON."""
    from rankwell.sources import checkpoints

    names = [r[0] for r in read(spark, d, "events").where("event_type is not null").select("event_type").distinct().collect()]  # a few labels
    rows = []
    for n in names:
        config = {"top_k": len(n), "chunk_size": 512, "strategy": n}
        rows.append((n, checkpoints.fingerprint(config), "OK" if 1 <= config["top_k"] <= 7 else "TOP_K_TOO_LARGE"))
    return spark.createDataFrame(rows, "event_type string, fingerprint string, status string")


@register("flt18_preflight", f"""WITH {HUMAN_SQL}, tbl AS (SELECT strategy, count(*) AS lists, count(DISTINCT qid) AS questions, sum(retrieved)::BIGINT AS retrieved, sum(unresolved)::BIGINT AS unresolved, round(sum(judged)::DOUBLE / sum(retrieved), 4) AS coverage FROM human GROUP BY strategy)
SELECT tbl.*, (SELECT count(DISTINCT qid) FROM run) - questions AS missing, CASE WHEN (SELECT count(DISTINCT qid) FROM run) > questions THEN 'INCOMPLETE' WHEN coverage < 0.4 THEN 'LOW_COVERAGE' ELSE 'READY' END AS status FROM tbl""")
def flt18(spark, d):
    """What each retriever is ready with before a run: lists, coverage, what is missing."""
    asked = B.run(spark, d).agg(F.count_distinct("qid").alias("asked"))
    s = human(spark, d).groupBy("strategy").agg(F.count("*").alias("lists"), F.count_distinct("qid").alias("questions"), F.sum("retrieved").alias("retrieved"), F.sum("unresolved").alias("unresolved"), F.round(B.share(F.sum("judged"), F.sum("retrieved")), 4).alias("coverage"))
    j = s.crossJoin(F.broadcast(asked)).withColumn("missing", F.col("asked") - F.col("questions")).drop("asked")  # one row
    return j.withColumn("status", F.when(F.col("missing") > 0, "INCOMPLETE").when(F.col("coverage") < 0.4, "LOW_COVERAGE").otherwise("READY"))


@register("snk05_exactly_once", """WITH e AS (SELECT event_id, user_id, event_type, dayofmonth(ts) AS day, value FROM events), k AS (SELECT *, row_number() OVER w AS k, first_value(value) OVER w AS v FROM e WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND day IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type, day ORDER BY event_id))
SELECT CASE WHEN k = 1 THEN 'APPENDED' WHEN v IS NOT DISTINCT FROM value THEN 'REPEATED' ELSE 'CONFLICT' END AS status, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM k GROUP BY 1
UNION ALL SELECT 'REFUSED', count(*), count(DISTINCT user_id), round(sum(value), 2) FROM e WHERE user_id IS NULL OR event_type IS NULL OR day IS NULL HAVING count(*) > 0""")
def snk05_stream(spark, d):
    """A stream into the ledger that breaks off between write and commit, starts again, and runs once more on nothing new."""
    kind = read(spark, d, "events").schema
    source = spark.readStream.schema(kind).parquet(f"{d}/events.parque[t]").select("event_id", "user_id", "event_type", F.dayofmonth("ts").alias("day"), "value")
    path, state = scratch(spark, "ledger"), scratch(spark, "ledger-state")
    broken = []

    def break_once():
        if not broken:
            broken.append(1)
            raise RuntimeError("lost between write and commit")

    for _ in range(3):
        query = ledger.stream(source, path, state, ["user_id", "event_type", "day"], ["event_id"], ["value"], break_once)
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if not broken:
                raise
    rows = ledger.judged(spark, path, "event_id long, user_id long, event_type string, day int, value double")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))
