"""Rolling exact medians and median deviations of series, by square-root decomposition.

A series is cut into stretches of the window's length, dense ones into 2, 4, 8 ... parts.
The window of a row in a part holds rows of the part itself, rows that leave the window
while the part lasts, and rows that stay in it throughout; of the last only counts by
value travel, so a part's task holds a bounded number of rows even where a window has
more of them than a task may hold.

Within a part, rows are cut into blocks by time and into buckets by value, about the
square root of their number of either.  A table has, for each block boundary, how many
rows before it fall into each bucket.  A window's counts by bucket are the difference of
two of the table's rows, corrected by the two blocks that it holds in part; one bucket is
scanned for a median.  The deviation is the least radius about the median that holds
enough rows, found by bisection.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankwell.llm.common import bound_batches, hand_back, materialise

#: Rows of a series and a stretch beyond which the stretch is cut into parts.
BLOCK_ROWS = 250_000
#: Fewer values than this have no median.
LEAST = 5
#: Cents at or beyond this, and values that are no numbers, count as none, so that sums of four fit a long.
MOST_CENTS = 1 << 59
#: Entries of the count matrix of a batch of windows.
CELLS = 1 << 20
OWN, LEAVING, STAYING = 0, 1, 2


def _micros(ts: Column, kind: T.DataType) -> Column:
    """Exact microseconds since 1970; of a timestamp without a zone, by its clock alone."""
    if not isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(ts.cast("timestamp"))
    seconds = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (F.unix_date(ts.cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)) * 60_000_000 + seconds


def _cents(value: Column) -> Column:
    c = F.floor(value * 100 + 0.5)
    return F.when(F.isnan(value) | (F.abs(value) >= MOST_CENTS / 100), None).otherwise(c).cast("long")


class Windows:
    """Selection by value within windows over entries (t, c, w) in time and (c, w) that are in every window."""

    def __init__(self, t: np.ndarray, c: np.ndarray, w: np.ndarray, base_c: np.ndarray, base_w: np.ndarray):
        order = np.argsort(t, kind="stable")
        self.t, c, self.w = t[order], c[order], w[order]
        m, total = len(t), len(t) + len(base_c)
        value, weight = np.concatenate([c, base_c]), np.concatenate([self.w, base_w])
        by = np.argsort(value, kind="stable")
        size = max(4, int(0.7 * np.sqrt(total)))
        self.size, self.k = size, max(1, -(-total // size))
        bucket = np.empty(total, np.int64)
        bucket[by] = np.arange(total) // size
        room = self.k * size - total
        lay = lambda x, fill: np.concatenate([x[by], np.full(room, fill, x.dtype)]).reshape(self.k, size)
        self.sorted = value[by]
        self.value, self.least = lay(value, self.sorted[-1]), self.sorted[::size]
        #: weights other than 1 are rare; without any, entries are counted
        self.weight = None if (weight == 1).all() else lay(weight, 0)
        place = np.concatenate([np.arange(m, dtype=np.int32), np.full(len(base_c), -1, np.int32)])
        self.place, self.standing = lay(place, np.int32(-2)), len(base_c) > 0
        self.columns = np.arange(size, dtype=np.int32)
        self.bucket, self.span = bucket[:m], max(4, int(np.sqrt(m)))
        table = np.bincount((np.arange(m) // self.span + 1) * self.k + self.bucket, self.w, (m // self.span + 2) * self.k)
        self.table = np.cumsum(table.reshape(-1, self.k), axis=0).astype(np.int64)
        self.base = np.bincount(bucket[m:], base_w, self.k).astype(np.int64)

    def open(self, lo: np.ndarray, hi: np.ndarray) -> None:
        """Counts of the windows of entries lo to hi in time: below[:, k] are those in buckets before k."""
        self.lo, self.n = lo[:, None].astype(np.int32), (hi - lo)[:, None].astype(np.uint32)
        self.below = np.zeros((len(lo), self.k + 1), np.int64)
        counts = self.below[:, 1:]
        np.subtract(self.table[hi // self.span], self.table[lo // self.span], out=counts)
        counts += self.base
        for at, sign in ((hi, 1), (lo, -1)):
            n = at % self.span
            entry = np.arange(int(n.sum())) + np.repeat(at - np.cumsum(n), n)
            cell = self.bucket[entry] + np.repeat(np.arange(len(at)) * self.k, n)
            part = np.bincount(cell, None if self.weight is None else self.w[entry], len(at) * self.k)
            counts += sign * part.astype(np.int64, copy=False).reshape(-1, self.k)
        np.cumsum(counts, axis=1, out=counts)

    def _inside(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Which entries of bucket k are in the windows of those rows."""
        place = self.place[k]
        inside = (place - self.lo[rows]).view(np.uint32) < self.n[rows]
        return inside | (place == -1) if self.standing else inside

    def at_rank(self, rows: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Value of that rank, from 0, in each window of rows."""
        below = self.below[rows]
        k = np.minimum((below[:, 1:] <= rank[:, None]).sum(1), self.k - 1)
        inside = self._inside(rows, k)
        upto = np.cumsum(inside if self.weight is None else inside * self.weight[k], axis=1, dtype=np.int64)
        at = (upto <= (rank - below[np.arange(len(rows)), k])[:, None]).sum(1)
        return self.value[k, np.minimum(at, self.size - 1)]

    def upto(self, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each window are at most x."""
        k, rest = np.divmod(np.searchsorted(self.sorted, x, "right"), self.size)
        some = np.minimum(k, self.k - 1)
        inside = self._inside(rows, some)
        inside &= self.columns < rest[:, None].astype(np.int32)
        part = inside.view(np.uint8).sum(1, dtype=np.int32) if self.weight is None else (inside * self.weight[some]).sum(1)
        return self.below[rows, k] + part

    def about(self, rows: np.ndarray, twice: np.ndarray, r: np.ndarray) -> np.ndarray:
        """How many values v of each window have |2 v - twice| <= r."""
        return self.upto(rows, (twice + r) // 2) - self.upto(rows, -((r - twice) // 2) - 1)

    def about_by_bucket(self, rows: np.ndarray, twice: np.ndarray, r: np.ndarray, whole: bool) -> np.ndarray:
        """A bound of about without a scan: from above by the buckets touched, from below by those wholly inside."""
        up = np.searchsorted(self.least, (twice + r) // 2, "right") - 1
        down = np.maximum(np.searchsorted(self.least, -((r - twice) // 2), "left") - 1, 0)
        if whole:
            return np.maximum(self.below[rows, np.maximum(up, 0)] - self.below[rows, np.minimum(down + 1, self.k)], 0)
        return self.below[rows, up + 1] - self.below[rows, np.minimum(down, up + 1)]


def _bisect(least: np.ndarray, most: np.ndarray, enough) -> np.ndarray:
    """Least value of [least, most] for which enough holds; it holds at most."""
    least, most = least.copy(), most.copy()
    while (least < most).any():
        mid = least + (most - least) // 2
        ok = enough(mid)
        most = np.where(ok, mid, most)
        least = np.where(ok, least, np.minimum(mid + 1, most))
    return most


def _doubled(w: Windows, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubled median and doubled median deviation of the open windows, n values each."""
    rows = np.arange(len(n))
    first, second = (n - 1) // 2, n // 2
    a = w.at_rank(rows, first)
    b = a.copy()
    even = np.flatnonzero(first != second)
    b[even] = w.at_rank(even, second[even])
    twice = a + b
    need = first + 1
    end = np.maximum(np.abs(2 * w.value[0, 0] - twice), np.abs(2 * w.value[-1, -1] - twice))
    low = _bisect(np.zeros_like(end), end, lambda r: w.about_by_bucket(rows, twice, r, False) >= need)
    high = _bisect(low, end, lambda r: (w.about_by_bucket(rows, twice, r, True) >= need) | (r >= end))
    d = _bisect(low, high, lambda r: w.about(rows, twice, r) >= need)
    d2 = d.copy()
    more = np.flatnonzero((first != second) & (w.about(rows, twice, d) <= second))
    if len(more):  # the next distance: of the values just above and just below
        t, r = twice[more], d[more]
        up, down = w.upto(more, (t + r) // 2), w.upto(more, -((r - t) // 2) - 1)
        over = np.abs(2 * w.at_rank(more, np.minimum(up, n[more] - 1)) - t)
        under = np.abs(2 * w.at_rank(more, np.maximum(down - 1, 0)) - t)
        far = np.iinfo(np.int64).max
        d2[more] = np.minimum(np.where(up < n[more], over, far), np.where(down > 0, under, far))
    return twice, d + d2


def window_medians(t: np.ndarray, c: np.ndarray, w: np.ndarray, base_c: np.ndarray, base_w: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, doubled median and doubled median deviation of the windows [at - width, at], and 0 where n < LEAST."""
    n, median2, mad4 = (np.zeros(len(at), np.int64) for _ in range(3))
    if not len(t) + len(base_c):
        return n, median2, mad4
    windows = Windows(t, c, w, base_c, base_w)
    lo, hi = np.searchsorted(windows.t, at - width, "left"), np.searchsorted(windows.t, at, "right")
    step = max(1, CELLS // max(windows.value.shape))
    for i in range(0, len(at), step):
        part = slice(i, i + step)
        windows.open(lo[part], hi[part])
        n[part] = windows.below[:, -1]
        full = i + np.flatnonzero(n[part] >= LEAST)
        if len(full):
            if len(full) < len(n[part]):
                windows.open(lo[full], hi[full])
            median2[full], mad4[full] = _doubled(windows, n[full])
    return n, median2, mad4


def _part(part: pa.Table, width: int) -> pa.Table:
    """Medians at each time of a part's own rows."""
    role, t, c, w = (np.asarray(part.column(x).combine_chunks().fill_null(0)) for x in ("role", "t", "cents", "w"))
    own = role == OWN
    at = np.unique(t[own])
    moving, staying = (role != STAYING) & (w > 0), role == STAYING
    n, median2, mad4 = window_medians(t[moving], c[moving], w[moving], c[staying], w[staying], at, width)
    few = n < LEAST
    key = part.column("series").slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(at), np.int64)))
    out = pa.table({"series": key, "t": pa.array(at), "n": pa.array(n), "median2": pa.array(median2, mask=few), "mad4": pa.array(mad4, mask=few)})
    hand_back()
    return out


def points(clicks: DataFrame) -> DataFrame:
    """(click_id, series, t, cents): every click_id once.

    Of rows of one click_id that differ, the one with the least time, kind and cents counts; rows
    without a time are left out first.  A null click_id is an id like any other, a null kind a series.
    """
    ts = clicks.schema["ts"].dataType
    rows = clicks.select("click_id", F.col("kind").cast("string").alias("series"), _micros(F.col("ts"), ts).alias("t"), _cents(F.col("value").cast("double")).alias("cents")).where("t is not null")
    return rows.groupBy("click_id").agg(F.min(F.struct("t", "series", "cents")).alias("r")).select("click_id", "r.series", "r.t", "r.cents")


def rolling_medians(one: DataFrame, minutes: int = 360, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """one row (series, t, n, median2, mad4) for each time of each series of points().

    n counts the cents of the series with times in [t - minutes, t]; median2 and mad4 are the
    doubled medians of those cents and of |2 cents - median2|, null where n < LEAST.  Cents that are
    null count nowhere, but their time has a row.  An empty table gives no rows.  Rows of one series,
    time and cents are one weighted entry, so a time that very many rows share is one small part.
    """
    spark = one.sparkSession
    width = minutes * 60_000_000
    bound_batches(spark)
    stretch = F.expr(f"(t - pmod(t, {width}L)) div {width}L")
    entries = one.groupBy("series", "t", "cents").agg(F.count("*").alias("w")).withColumn("w", F.when(F.col("cents").isNull(), 0).otherwise(F.col("w"))).withColumn("s", stretch)
    # stretches of too many rows, and into how many parts they are cut: as a rule none
    dense = one.groupBy("series", stretch.alias("s")).agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    dense = materialise(dense.select("series", "s", F.expr(f"shiftleft(1L, cast(ceil(log2(n / {block_rows}D)) as int))").alias("parts")), "dense")
    for off, name in ((0, "own"), (1, "next")):
        d = dense.select(F.col("series").alias("d_series"), (F.col("s") - off).alias("d_s"), F.col("parts").alias(name))
        entries = entries.join(d, F.col("series").eqNullSafe(F.col("d_series")) & (F.col("s") == F.col("d_s")), "left").drop("d_series", "d_s").withColumn(name, F.coalesce(name, F.lit(1).cast("long")))
    part_of = lambda name: F.expr(f"(pmod(t, {width}L) * {name}) div {width}L")
    own = entries.select("series", "s", part_of("own").alias("j"), F.lit(OWN).alias("role"), "t", "cents", "w")
    valued = entries.where("w > 0")
    leaving = valued.select("series", (F.col("s") + 1).alias("s"), part_of("next").alias("j"), F.lit(LEAVING).alias("role"), "t", "cents", "w")
    # rows that stay: counts by value of the finest slices, then of each part that they last through
    sliced = valued.where("own > 1 or next > 1").withColumn("i", F.expr(f"(pmod(t, {width}L) * greatest(own, next)) div {width}L")).groupBy("series", "s", "own", "next", "i", "cents").agg(F.sum("w").alias("w"))
    after = F.expr("transform(sequence(i * own div greatest(own, next) + 1, own), j -> struct(s AS s, j AS j))")
    before = F.expr("transform(sequence(0L, i * next div greatest(own, next)), j -> struct(s + 1 AS s, j AS j))")
    lasting = sliced.select("series", "cents", "w", "own", F.expr("i * next div greatest(own, next)").alias("last"), F.col("s").alias("s0"), F.explode(F.concat(after, before)).alias("p"))
    lasting = lasting.where("(p.s = s0 and p.j < own) or (p.s > s0 and p.j < last)")
    staying = lasting.groupBy("series", "p.s", "p.j", "cents").agg(F.sum("w").alias("w")).select("series", "s", "j", F.lit(STAYING).alias("role"), F.lit(None).cast("long").alias("t"), "cents", "w")
    parts = own.unionByName(leaving).unionByName(staying).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "series", "s", "j")
    return parts.groupBy("series", "s", "j").applyInArrow(lambda p: _part(p, width), "series string, t long, n long, median2 long, mad4 long")


def flag_clicks(clicks: DataFrame, minutes: int = 360, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """click_id, kind, n, median2, mad4, far of every click with a time.

    far says that a click's own cents lie over 2.5 median deviations from its window's median; it is
    null without cents or median.  Columns other than click_id, ts, kind and value are left out.
    """
    one = materialise(points(clicks), "clicks")
    found = rolling_medians(one, minutes, block_rows).withColumnsRenamed({"series": "f_series", "t": "f_t"})
    far = 2 * F.abs(2 * F.col("cents") - F.col("median2")) > 5 * F.col("mad4")
    both = one.join(found, F.col("series").eqNullSafe(F.col("f_series")) & (F.col("t") == F.col("f_t")))
    return both.select("click_id", F.col("series").alias("kind"), "n", "median2", "mad4", far.alias("far"))
