"""Draws of a seeded Mersenne twister, as Python's random module makes them.

Samples and orders are drawn by that module itself, once for each group: only seeds, sizes and
places pass through Python, and a group's items are picked by their places in the JVM.  Long
streams of integers, as resampling takes, come in blocks from numpy's generator, which goes on
from the state that a seed gives; an integer below n takes the top bits of one word and is
drawn again until it is below n.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from rankwell.operators.bootstrap import numbered

#: Words drawn at once.
BLOCK = 1 << 16


class Twister:
    """A stream of words and integers equal to those of random.Random(seed), 0 <= seed."""

    def __init__(self, seed: int):
        *key, at = random.Random(seed).getstate()[1]
        self.bits = np.random.MT19937()
        self.bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, np.uint32), "pos": at}}
        self.held = np.zeros(0, np.uint32)

    def _words(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            self.held = np.concatenate([self.held, self.bits.random_raw(max(n - len(self.held), 64)).astype(np.uint32)])
        return self.held[:n]

    def below(self, n: int, count: int = 1) -> np.ndarray:
        """count integers below n, 0 < n < 2^32."""
        shift, out, have = np.uint32(32 - int(n).bit_length()), [], 0
        while have < count:
            words = self._words(min(BLOCK, 2 * (count - have) + 2)) >> shift
            good = np.flatnonzero(words < n)[: count - have]
            have += len(good)
            out.append(words[good])
            # what follows the last word that was needed is for the next draw
            self.held = self.held[int(good[-1]) + 1 if have == count else len(words) :]
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@pandas_udf(ArrayType(IntegerType()))
def sample_places(seed: pd.Series, n: pd.Series, k: pd.Series) -> pd.Series:
    """Places (from 0) of a sample of k of n items."""
    return pd.Series([random.Random(int(s)).sample(range(int(a)), int(b)) for s, a, b in zip(seed, n, k, strict=True)])


@pandas_udf(ArrayType(IntegerType()))
def shuffled_places(seed: pd.Series, n: pd.Series) -> pd.Series:
    """Places (from 0) of n items in shuffled order."""
    orders = [list(range(int(a))) for a in n]
    for s, order in zip(seed, orders, strict=True):
        random.Random(int(s)).shuffle(order)
    return pd.Series(orders)


def seed_of(*parts: Column | str) -> Column:
    """The first eight hex digits of the text's SHA-256, as a number."""
    text = F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")


def gathered(rows: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, items, n: the distinct items of each group, in order."""
    lists = rows.where(F.col(item).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return lists.withColumn("n", F.size("items"))


def sample(lists: DataFrame, by: list[str], item: str, seed: Column, k: Column) -> DataFrame:
    """by, item, place of k(n) sampled items of each group of gathered(), place being the order they were drawn in."""
    drawn = lists.withColumn("at", sample_places(seed, F.col("n"), F.least(k, F.col("n"))))
    return drawn.select(*by, F.posexplode(F.transform("at", lambda i: F.get("items", i))).alias("place", item))


def shuffle(lists: DataFrame, by: list[str], item: str, seed: Column) -> DataFrame:
    """by, item, position (from 1) of all items of each group of gathered(), shuffled."""
    drawn = lists.withColumn("at", shuffled_places(seed, F.col("n")))
    out = drawn.select(*by, F.posexplode(F.transform("at", lambda i: F.get("items", i))).alias("position", item))
    return out.withColumn("position", F.col("position") + 1)


def interval(values: DataFrame, key: str, value: str, resamples: int = 1000, seed: int = 42, level: float = 0.95, index: str | None = None) -> DataFrame:
    """low and high of a table's mean: entries int((1-level)/2 r) and int((1+level)/2 r) of the sorted means of r resamples.

    Rows are numbered by their keys' hashes, or by index from 0 if a column has one; nulls are left
    out, no rows give 0 and 0.  Each task goes through the stream, takes from each resample what falls to its own rows and hands on one sum for each, so
    that nothing else moves, however many rows there are.
    """
    spark = values.sparkSession
    there = values.where(F.col(value).isNotNull()).withColumn("v", F.col(value).cast("double"))
    own = there.select(F.col(index).cast("long").alias("i"), "v") if index else numbered(there.select(key, "v"), key).select("i", "v")
    n = own.count()
    if not n:
        return spark.range(1).select(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))

    def sums(batches):
        parts = [(np.asarray(b.column("i")), np.asarray(b.column("v"))) for b in batches]
        if not parts:
            return
        at, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(at)
        lo, v = int(at[order[0]]), v[order]
        stream, out = Twister(seed), np.zeros(resamples)
        for b in range(resamples):
            for done in range(0, n, BLOCK):
                drawn = stream.below(n, min(BLOCK, n - done)) - lo
                out[b] += v[drawn[(drawn >= 0) & (drawn < len(v))]].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(out)], names=["b", "total"])

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 100_000 + 1))
    ranges = own.withColumn("range", F.expr(f"cast(i * {parts} div {n} as int)")).repartition(parts, "range")
    means = ranges.groupBy("range").applyInArrow(lambda t: pa.Table.from_batches(list(sums(t.to_batches()))), "b long, total double")
    ordered = means.groupBy("b").agg((F.sum("total") / n).alias("m")).agg(F.array_sort(F.collect_list("m")).alias("m"))  # as many as resamples
    return ordered.select(*[F.round(F.get("m", F.lit(int(p * resamples))), 4).alias(c) for p, c in (((1 - level) / 2, "low"), ((1 + level) / 2, "high"))])
