"""Bootstrap intervals with draws from a keyed hash, the same on every run and engine."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.sources.folders import scratch

#: Rows whose values travel as one array.
BLOCK_ROWS = 16_384
#: Values that a task holds on average, and resamples that it draws.
HELD_ROWS = 8_000_000
TASK_RESAMPLES = 20


def numbered(df: DataFrame, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with i from 0 in each group, in order of the key's hash: counted within 256 parts of hash space, so no task sorts a whole group."""
    h = df.withColumn("h", F.sha2(F.col(key).cast("string"), 256)).withColumn("part", F.substring("h", 1, 2))
    before = h.groupBy(*by, "part").agg(F.count("*").alias("n")).select(*by, "part", (F.sum("n").over(Window.partitionBy(*by).orderBy("part")) - F.col("n")).alias("before"))  # at most 256 rows a group
    own = F.row_number().over(Window.partitionBy(*by, "part").orderBy("h", key)) - 1
    return h.withColumn("own", own).join(before, [*by, "part"]).withColumn("i", F.col("own") + F.col("before")).drop("h", "part", "own", "before")


def interval(values: DataFrame, by: list[str], key: str, value: str, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """low and high of the mean's interval of each group: entries int((1-level)/2 n) and int((1+level)/2 n) of the sorted means.

    Row i of a group in resample b draws a row of the same group by hash.  Groups are meant
    to hold the questions of an evaluation: rows times resamples are drawn.
    """
    own = values.where(F.col(value).isNotNull()).select(*by, key, F.col(value).cast("double").alias("v"))
    means = _means(numbered(own, key, tuple(by)), by, resamples, seed)
    k = F.row_number().over(Window.partitionBy(*by).orderBy("m", "b")) - 1  # as many rows as resamples
    lo, hi = int((1 - level) / 2 * resamples), int((1 + level) / 2 * resamples)
    at = lambda p: F.round(F.max(F.when(F.col("k") == p, F.col("m"))), 4)
    return means.withColumn("k", k).groupBy(*by).agg(at(lo).alias("low"), at(hi).alias("high"))


def _means(row: DataFrame, by: list[str], resamples: int, seed: int) -> DataFrame:
    """by, b, m: the mean of each group in each resample.

    Hashes depend on resample and row number alone, so all groups share them.  Values travel
    in blocks to the tasks, each of which draws some resamples and holds HELD_ROWS values or
    so: of more values there are several shares, whose sums are added.
    """
    spark, path = row.sparkSession, scratch(row.sparkSession, "values")
    place = F.floor(F.col("i") / BLOCK_ROWS)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    row.groupBy(*by, place.alias("block")).agg(ordered.alias("v")).write.parquet(path)
    blocks = spark.read.parquet(path)
    size = blocks.groupBy(*by).agg(F.sum(F.size("v")).alias("n"))
    shares, chunks = max(1, -(-(size.agg(F.sum("n")).first()[0] or 0) // HELD_ROWS)), -(-resamples // TASK_RESAMPLES)
    keyed = size.select(*by, F.xxhash64(*by).alias("_group"), "n")
    dealt = blocks.join(keyed, by)
    chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    dealt = dealt.select("_group", "n", "block", "v", F.pmod(F.xxhash64("_group", "block"), F.lit(shares)).cast("int").alias("share"), chunk)
    dealt = dealt.select((F.col("chunk") * shares + F.col("share")).cast("int").alias("task"), "_group", "n", "block", "v")

    def draw(batches):
        held, task = {}, None
        for b in batches:
            for t, g, n, k, v in zip(*(b.column(c) for c in range(5)), strict=True):
                task = t.as_py()
                held.setdefault((g.as_py(), n.as_py()), {})[k.as_py()] = v.values.to_numpy(zero_copy_only=False)
        if task is None:
            return
        groups = []
        for (g, n), own in held.items():
            start, at = np.full(-(-n // BLOCK_ROWS), -1), 0
            for k, v in sorted(own.items()):
                start[k], at = at, at + len(v)
            groups.append((g, n, None if len(own) == len(start) else start, np.concatenate([own[k] for k in sorted(own)])))
        most, sha = max(n for _, n, _, _ in groups), hashlib.sha256
        of = task // shares
        mine = range(of * TASK_RESAMPLES, min(resamples, (of + 1) * TASK_RESAMPLES))
        sums = np.zeros((len(mine), len(groups)))
        for lo in range(0, most, 1 << 18):
            ends = [b"%d" % i for i in range(lo, min(most, lo + (1 << 18)))]
            for r, b in enumerate(mine):
                lead = f"{seed}:{b}:".encode()
                h = np.frombuffer(b"".join([sha(lead + i).digest()[:4] for i in ends]), ">u4").astype(np.int64)
                for x, (_, n, start, v) in enumerate(groups):
                    j = h[: max(0, n - lo)] % n
                    if start is not None:
                        to = start[j // BLOCK_ROWS]
                        j = (to + j % BLOCK_ROWS)[to >= 0]
                    sums[r, x] += v[j].sum()
        yield pa.RecordBatch.from_pydict({"_group": np.repeat([g for g, *_ in groups], len(mine)), "b": np.tile(np.array(mine, np.int32), len(groups)), "s": sums.T.ravel()})

    drawn = dealt.repartitionById(chunks * shares, F.col("task")).mapInArrow(draw, "_group long, b int, s double")
    total = drawn.groupBy("_group", "b").agg(F.sum("s").alias("s"))
    return total.join(keyed, "_group").select(*by, "b", (F.col("s") / F.col("n")).alias("m"))


def overall(values: DataFrame, key: str, value: str, resamples: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """The interval of a whole table's mean."""
    return interval(values.withColumn("one", F.lit(1)), ["one"], key, value, resamples, seed, level).drop("one")
