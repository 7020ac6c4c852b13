"""Sinks: JSON lines, CSV, sealed state, an append-only ledger, audited artefacts and reports.

Spark's job commit makes each write whole or absent; what is returned is read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.operators.filters import forbidden_fields, no_holdout
from rankwell.operators.mapping import SECRET

#: Keys that a ledger must not hold, at any depth. Fixed values.
LEDGER_FORBIDDEN = "chain_of_thought reasoning internal_messages secret credential api_key qrels gold_answer holdout password token".split()
FIELD = r'^(\{"data": )(.*)(, "integrity_sha256": ")([0-9a-f]{64})("\})$'


class Refused(ValueError):
    """What an audit before a write found."""


def write_json(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def sealed(data: Column) -> Column:
    """One-line envelope of a JSON text: itself and its hash."""
    return F.concat(F.lit('{"data": '), data, F.lit(', "integrity_sha256": "'), F.sha2(data, 256), F.lit('"}'))


def unsealed(envelope: Column) -> tuple[Column, Column]:
    """(data, status) of an envelope: VALID, CORRUPT or NO_ENVELOPE; data only where valid."""
    data, kept = F.regexp_extract(envelope, FIELD, 2), F.regexp_extract(envelope, FIELD, 4)
    status = F.when(~F.coalesce(envelope.rlike(FIELD), F.lit(False)), "NO_ENVELOPE").when(F.sha2(data, 256) == kept, "VALID").otherwise("CORRUPT")
    return F.when(status == "VALID", data), status


def append_ledger(df: DataFrame, path: str, key: list[str]) -> DataFrame:
    """Appends rows whose key the ledger lacks; returns (status, n) of what was appended, repeated or in conflict.

    A schema with a forbidden field anywhere is refused.  Of rows of one key the batch may
    hold one only; more are a conflict, and the first in order stays.
    """
    from pyspark.sql import Window

    bad = forbidden_fields(df, LEDGER_FORBIDDEN)
    if bad:
        raise Refused(f"forbidden fields: {bad}")
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
    known = (spark.read.parquet(path) if there else df.limit(0)).select(*key).distinct().withColumn("known", F.lit(True))
    order = Window.partitionBy(*key).orderBy(*[c for c in df.columns if c not in key])
    judged = df.withColumn("k", F.row_number().over(order)).join(known, key, "left")
    status = F.when(F.col("known"), "CONFLICT_WITH_LEDGER").when(F.col("k") > 1, "CONFLICT_IN_BATCH").otherwise("APPENDED")
    counts = judged.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    out = spark.createDataFrame([r.asDict() for r in counts.collect()], "status string, n long")  # three rows at most
    judged.where(status == "APPENDED").select(*df.columns).write.mode("append").parquet(path)
    return out


def audit(rows: DataFrame, strategies: int, questions: int) -> DataFrame:
    """gate, violations of a result matrix (strategy, qid, answer, abstained, citations, passage_ids) before it is written."""
    pairs = F.count("*") - F.count_distinct("strategy", "qid")
    bad_ids = F.exists("passage_ids", lambda p: ~F.startswith(p, F.lit("ps_")))
    checks = {
        "row_count": F.abs(F.count("*") - F.lit(strategies * questions)), "duplicate_pairs": pairs, "holdout": F.count_if(~no_holdout(F.col("qid"))),
        "answers_without_citation": F.count_if(~F.col("abstained") & (F.size("citations") == 0)), "non_canonical_ids": F.count_if(bad_ids), "secrets": F.count_if(F.col("answer").rlike(SECRET)),
    }
    one = rows.agg(*[v.cast("long").alias(k) for k, v in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("violations")) for k in checks])).alias("g")).select("g.*")


def write_artefact(rows: DataFrame, path: str, strategies: int, questions: int) -> DataFrame:
    """Writes a result matrix that passes its audit, else refuses."""
    failed = [f"{r['gate']}={r['violations']}" for r in audit(rows, strategies, questions).collect() if r["violations"]]  # six rows
    if failed:
        raise Refused(", ".join(failed))
    return write_json(rows, path)


def markdown(table: DataFrame, title: str, order: list[str]) -> DataFrame:
    """(line, text) of a report: a title, a header and a row for each row of a small aggregate, NA for null."""
    from pyspark.sql import Window

    cells = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in table.columns]
    rows = table.withColumn("line", F.row_number().over(Window.orderBy(*order)) + 3).select("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("text"))
    head = [(1, f"# {title}"), (2, "| " + " | ".join(table.columns) + " |"), (3, "|" + "---|" * len(table.columns))]
    return rows.sparkSession.createDataFrame(head, "line int, text string").unionByName(rows)
