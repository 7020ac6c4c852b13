"""Sealed run state, and row-level checkpoints that a run resumes from.

The state of a run is small and lives in one JSON text beside its hash.  Finished rows are
data: they are appended as Parquet, split by strategy, and a resumed run takes what is not
among them by an anti join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROW_KEY = ["query_id", "strategy"]


class Corrupt(ValueError):
    """A sealed text that is no envelope or does not match its hash."""


def run_folder(base: str, run_id: str) -> str:
    """base/run_id; a run id is one plain name, so no path leaves base."""
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", run_id) or ".." in run_id:
        raise ValueError(f"not a run id: {run_id!r}")
    return f"{base.rstrip('/')}/{run_id}"


def canonical(value: object, compact: bool = True) -> str:
    """JSON with sorted keys and ASCII only; equal values have equal texts."""
    return json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":") if compact else None)


def fingerprint(value: object, compact: bool = True) -> str:
    return hashlib.sha256(canonical(value, compact).encode()).hexdigest()


def seal(data: object) -> str:
    return json.dumps({"integrity_sha256": fingerprint(data, compact=False), "data": data}, sort_keys=True, indent=2, ensure_ascii=True)


def unseal(text: str) -> object:
    try:
        envelope = json.loads(text)
        data, kept = envelope["data"], envelope["integrity_sha256"]
    except (ValueError, KeyError, TypeError) as e:
        raise Corrupt("no sealed state") from e
    if fingerprint(data, compact=False) != kept:
        raise Corrupt("the state does not match its hash")
    return data


def finished(schema: StructType, spark, path: str) -> DataFrame:
    """Rows of a checkpoint, none if there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def remaining(work: DataFrame, done: DataFrame) -> DataFrame:
    """What of work (query_id, strategy, ...) has no finished row."""
    return work.join(done.select(*ROW_KEY).distinct(), ROW_KEY, "left_anti")


def append_rows(rows: DataFrame, path: str) -> None:
    """Appends one row of each query and strategy that is not finished yet."""
    new = remaining(rows.dropDuplicates(ROW_KEY), finished(rows.schema, rows.sparkSession, path))
    new.write.mode("append").partitionBy("strategy").parquet(path)


def row_keys(rows: DataFrame) -> DataFrame:
    """rows with the key ``query::strategy``."""
    return rows.withColumn("row_key", F.concat_ws("::", *ROW_KEY))


def later_wins(rows: DataFrame, key: list[str], order: str, complete: Column) -> DataFrame:
    """Of several rows of a key the complete one of highest order."""
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.where(complete).withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def superseded(old: DataFrame, again: DataFrame) -> DataFrame:
    """old without the records that again names in supersedes, and again."""
    return old.join(again.select(F.col("supersedes").alias("record_id")), "record_id", "left_anti").unionByName(again)


def _inventory(df: DataFrame) -> dict:
    """Rows and a checksum of their contents, whatever their order."""
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
    return {"n": total["n"], "sum": total["sum"]}


def stage(spark: SparkSession, home: str, settings: dict, build: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """A table kept below home under the hash of its settings, and whether it was BUILT, REUSED or REBUILT.

    It is reused only if its contents still have the inventory that was sealed beside it.
    """
    path = f"{home.rstrip('/')}/{fingerprint(settings)}"
    known = _sealed_inventory(spark, path)
    if known is not None:
        try:
            if _inventory(spark.read.parquet(f"{path}/rows")) == known:
                return spark.read.parquet(f"{path}/rows"), "REUSED"
        except AnalysisException:
            pass  # rows are gone
    build().write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    spark.createDataFrame([(seal(_inventory(rows)),)], "envelope string").coalesce(1).write.mode("overwrite").parquet(f"{path}/sealed")
    return rows, "BUILT" if known is None else "REBUILT"


def _sealed_inventory(spark: SparkSession, path: str) -> dict | None:
    try:
        return unseal(spark.read.parquet(f"{path}/sealed").first()["envelope"])
    except AnalysisException:
        return None  # never built
