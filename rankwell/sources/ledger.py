"""An append-only ledger that a stream feeds exactly once.

Each batch is judged and written to a folder of its own, which a repetition overwrites, and
counts once its mark is in the commit log.  A batch that is replayed after its mark changes
nothing; one that was written without a mark is written again from the same rows against the
same committed batches, so a run that dies anywhere and starts again ends in the same ledger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankwell.operators import canonical
from rankwell.operators.filters import forbidden_fields
from rankwell.sources.sinks import LEDGER_FORBIDDEN, Refused


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def committed(spark: SparkSession, path: str) -> DataFrame:
    """batch of every committed batch."""
    fs, log = _file(spark, f"{path}/commits")
    if not fs.exists(log):
        return spark.createDataFrame([], "batch long")
    return spark.read.schema("batch long").json(f"{path}/commits")


def judged(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of committed batches with content_sha256, status and batch."""
    own = f"{schema if isinstance(schema, str) else ', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, content_sha256 string, status string, batch long"
    fs, there = _file(spark, f"{path}/rows")
    if not fs.exists(there):
        return spark.createDataFrame([], own)
    return spark.read.schema(own).parquet(f"{path}/rows").join(F.broadcast(committed(spark, path)), "batch", "left_semi")  # a number for each batch


def append_batch(rows: DataFrame, batch: int, path: str, key: list[str], order: list[str], content: list[str], before_commit: Callable[[], None] | None = None) -> bool:
    """Judges and writes a batch unless it is committed; whether it was written.

    A row whose key is new is APPENDED (of several in a batch the first in order, then by
    content), one that says what the ledger says of its key is REPEATED, any other a CONFLICT.  Rows with
    a null in the key are REFUSED; a schema with a forbidden field anywhere raises Refused.
    """
    bad = forbidden_fields(rows, LEDGER_FORBIDDEN)
    if bad:
        raise Refused(f"forbidden fields: {bad}")
    spark = rows.sparkSession
    fs, mark = _file(spark, f"{path}/commits/{batch:012d}.json")
    if fs.exists(mark):
        return False
    kinds = {f.name: f.dataType for f in rows.schema}
    said = F.sha2(F.concat_ws(",", *[canonical.json(F.col(c), kinds[c]) for c in sorted(content)]).cast("binary"), 256)
    known = judged(spark, path, rows.schema).where("status = 'APPENDED'").where(F.col("batch") < batch).select(*key, F.col("content_sha256").alias("_known"))
    own = rows.withColumn("content_sha256", said)
    first = Window.partitionBy(*key).orderBy(*order, "content_sha256")
    j = own.withColumn("_k", F.row_number().over(first)).withColumn("_first", F.first("content_sha256").over(first)).join(known, key, "left")
    there = F.coalesce("_known", F.when(F.col("_k") > 1, F.col("_first")))
    none = F.array_contains(F.array(*[F.col(c).isNull() for c in key]), True)
    status = F.when(none, "REFUSED").when(there.isNull(), "APPENDED").when(there == F.col("content_sha256"), "REPEATED").otherwise("CONFLICT")
    j.select(*rows.columns, "content_sha256", status.alias("status")).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    if before_commit:
        before_commit()
    out = fs.create(mark, False)  # refuses a second writer
    out.write(bytearray(f'{{"batch": {batch}}}\n'.encode()))
    out.close()
    return True


def stream(rows: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], content: list[str], before_commit: Callable[[], None] | None = None) -> StreamingQuery:
    """A query that appends what has arrived and ends; start it again on the same checkpoint for what comes next."""

    def each(df: DataFrame, batch: int) -> None:
        append_batch(df, batch, path, key, order, content, before_commit)

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
