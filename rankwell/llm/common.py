"""What the operators share: sources, Arrow mapping, shared folders, materialisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.sources import folders

#: What an Arrow batch holds at most: a worker's memory does not follow the length of texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the one in spark.checkpoint.dir, which driver and executors share; a cluster must name it."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folders.shared(spark))
    return folders.scratch(spark, what)


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what materialise wrote for df, once nothing reads it any more."""
    jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(session.sessionState().newHadoopConf()).delete(where, True)


def small(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, df as it is beyond."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hand_back() -> None:
    """Returns freed memory to the system, as workers stay for later tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc only
        libc.malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH, unless they are bounded tighter already.

    The settings stay: a plan reads them when it is run, after its operator has returned.
    """
    for name, most in BATCH.items():
        now = spark.conf.get(name, most)
        if not (now.isdigit() and 0 < int(now) <= int(most)):
            spark.conf.set(name, most)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow by a function from a batch to dicts of columns."""
    from pyspark.sql.types import StructType

    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType.fromDDL(schema)
    bound_batches(df.sparkSession)

    def run(batches):
        kind = to_arrow_schema(out)
        for b in batches:
            for cols in fn(b):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c := cols[f.name], pa.Array) else pa.array(c, f.type) for f in kind], schema=kind)
            hand_back()

    return df.mapInArrow(run, out)


def doc_columns(df: DataFrame) -> DataFrame:
    """documents' own columns; clashing extra columns are left out."""
    return df.select(*[F.col(c) for c in DOCUMENTS if c in df.columns])
