"""File sources and sinks: JSON corpora, questions, judgements, directories; CSV and JSON out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.operators import filters as G

CORPUS = "documents array<struct<document_id:string,pages:array<struct<page_number:int,text:string>>>>"
QRELS = "question_id string, passage_id string, grade int, role string"


def corpus_chunks(corpus: DataFrame) -> DataFrame:
    """One chunk a page of nested documents, named by document and page."""
    p = corpus.select(F.explode("documents").alias("d")).select("d.document_id", F.explode("d.pages").alias("p"))
    return p.select("document_id", "p.page_number", F.concat("document_id", F.lit("_p"), "p.page_number").alias("chunk_id"), "p.text")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a corpus file."""
    return corpus_chunks(spark.read.schema(CORPUS).json(path, multiLine=True))


def questions_of(raw: DataFrame) -> DataFrame:
    """qid, question under either spelling of the keys, with flags for empty and repeated ones."""
    q = raw.select(F.coalesce("qid", "question_id").alias("qid"), F.coalesce("question", "query").alias("question"), "split")
    n = q.groupBy("qid").agg(F.count("*").alias("n"))
    return q.join(n, "qid").select("qid", "question", "split", (F.trim(F.coalesce("question", F.lit(""))) == "").alias("is_empty"), (F.col("n") > 1).alias("is_duplicate"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return questions_of(spark.read.schema("qid string, question_id string, question string, query string, split string").json(path))


def qrels_report(q: DataFrame) -> DataFrame:
    """One row on judgements (question_id, passage_id, grade, role): counts of violations and grades, and the verdict."""
    g = F.col("grade")
    known = g.between(0, 3) & F.col("role").isin(G.ROLES)
    bad = {
        "duplicate_pairs": F.count("*") - F.count_distinct("question_id", "passage_id"), "bad_grade": F.count_if(~F.coalesce(g.between(0, 3), F.lit(False))), "holdout": F.count_if(~G.no_holdout(F.col("question_id"))),
        "bad_role": F.count_if(~F.coalesce(F.col("role").isin(G.ROLES), F.lit(False))), "role_differs": F.count_if(known & (F.col("role") != G.role_of(g))),
    }
    out = q.agg(F.count("*").alias("n"), *[v.alias(k) for k, v in bad.items()], *[F.count_if(g == i).alias(f"g{i}") for i in range(4)])
    total = sum((F.col(k) for k in bad), F.lit(0))
    return out.withColumn("status", F.when(total > 0, "REJECTED").otherwise("ACCEPTED"))


def read_qrels(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """Graded judgements; fails on any violation of their contract, and on another number than the manifest's."""
    q = spark.read.schema(QRELS).json(path)
    report = qrels_report(q).first()
    if report["status"] != "ACCEPTED" or expected is not None and report["n"] != expected:
        raise ValueError(f"judgements violate their contract: {report.asDict()}, expected {expected}")
    return q


def export_violations(rows: DataFrame, annotator: str) -> DataFrame:
    """rows (annotator_id, question_id, passage_id, grade, notes) with the names of the checks that each fails."""
    k = rows.groupBy("question_id", "passage_id").agg(F.count("*").alias("k"))
    c = F.col
    checks = G.violations(
        WRONG_ANNOTATOR=c("annotator_id") != annotator, DUPLICATE_PAIR=c("k") > 1, HOLDOUT=~G.no_holdout(c("question_id")),
        BAD_GRADE=~F.coalesce(c("grade").between(0, 3), F.lit(False)), NOT_BLIND=F.lower("notes").rlike("strateg|rank|score|retriev"),
    )
    return rows.join(k, ["question_id", "passage_id"]).withColumn("violations", checks)


def adjudication_violations(rows: DataFrame) -> DataFrame:
    """rows (status, grade, reasoning) with the names of the checks that each fails."""
    c = F.col
    return rows.withColumn("violations", G.violations(NOT_COMPLETED=~c("status").eqNullSafe("COMPLETED"), BAD_GRADE=~F.coalesce(c("grade").between(0, 3), F.lit(False)), NO_REASONING=F.coalesce(F.regexp_replace("reasoning", r"\s", ""), F.lit("")) == ""))


def evidence_errors(rows: DataFrame) -> DataFrame:
    """A row for each error of an evidence row (rank, score, passage_id, sha, pages, reranked, post_rank)."""
    c = F.col
    errors = G.violations(
        BAD_RANK=c("rank") < 1, SCORE_MISSING=c("score").isNull(), SCORE_NEGATIVE=c("score") < 0, PASSAGE_NOT_CANONICAL=~F.startswith(c("passage_id"), F.lit("ps_")), BAD_SHA=~c("sha").rlike("^[0-9a-f]{64}$"),
        NO_PAGES=F.size("pages") == 0, POST_RANK_OF_UNRANKED=~c("reranked") & c("post_rank").isNotNull(),
    )
    return rows.withColumn("error", F.explode(F.split(errors, ","))).where("error <> ''")


def silver_violations(rows: DataFrame, banned: list[str]) -> DataFrame:
    """rows (label_source, grade, role, confidence, span, text, model) with the names of the checks that each fails."""
    c = F.col
    graded = F.coalesce(c("grade").between(0, 3), F.lit(False))
    checks = G.violations(
        BAD_LABEL_SOURCE=c("label_source") != "SILVER", BAD_GRADE=~graded, ROLE_DIFFERS=graded & ~c("role").eqNullSafe(G.role_of(c("grade"))), CONFIDENCE_OUT_OF_RANGE=~F.coalesce(c("confidence").between(0, 1), F.lit(False)),
        SPAN_NOT_LITERAL=(c("span") != "") & ~F.contains("text", c("span")), MODEL_BANNED=c("model").isin(banned),
    )
    return rows.withColumn("violations", checks)


def replay_rows(nested: DataFrame) -> DataFrame:
    """qid, strategy, metric, value of (qid, results: map of strategies to maps of metrics); nulls are no scores."""
    s = nested.select("qid", F.explode("results").alias("strategy", "scores"))
    return s.select("qid", "strategy", F.explode("scores").alias("metric", "value")).where("value is not null")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes and sha256 of the files of a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_csv(df: DataFrame, path: str) -> None:
    """NA for null, lists joined by semicolons."""
    cols = [F.concat_ws(";", c) if t.startswith("array") else F.col(c).cast("string") for c, t in df.dtypes]
    df.select(*[F.coalesce(c, F.lit("NA")).alias(n) for c, n in zip(cols, df.columns, strict=True)]).write.mode("overwrite").option("header", True).csv(path)
