"""Best-fit packing by linear grouping.

Documents become token pieces of at most ``size`` ids.  Only the histogram of piece
lengths (at most ``size`` rows, whatever the corpus) reaches the driver, where

1. lengths over ``size / 4`` are sorted and cut into groups of equal cardinality, each
   rounded up to its largest member;
2. configurations of the few rounded sizes, at most three to a sequence, are optimised by
   a linear program whose columns are generated as they pay; what its whole parts leave is
   filled greedily, the largest remaining size with the one or two that complement it best;
3. actual lengths take the places of the rounded ones;
4. the small lengths go best-fit into what is left, longest first.

The plan is a list of runs (length, ranks, first sequence, offset).  Its length depends
on the number of lengths, not of documents.  Pieces find their run by their rank within
their length, which is counted in salted buckets so that one frequent length is no
hot spot.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm import textvec as tv
from rankwell.llm.common import arrow_map, materialise
from rankwell.llm.tokens import PieceEncoder, default_path

#: Pieces that share a bucket of ranks, on average at most, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 500_000, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, size: int = 2048, path: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each piece; null text is empty.

    A document's ids end with end_id; only documents longer than size are cut.  Repeated
    rows and null doc_id give pieces like any others; further columns are ignored.
    """
    path = path or default_path("word_bpe_49k.json")

    def pieces(batch):
        enc = PieceEncoder.of(path)
        keys = batch.column("doc_id")
        for s in tv.slices(batch.column("text")):
            ids, first = enc.encode(s)
            out = defaultdict(list)
            for i in range(len(s)):
                own = np.append(ids[first[i] : first[i + 1]], end_id).astype("<u4")
                for k, lo in enumerate(range(0, len(own), size)):
                    part = own[lo : lo + size]
                    key = keys[s.lo + i].as_py()
                    for c, v in (("doc_id", key), ("piece", k), ("start", lo), ("length", len(part)), ("ids_crc32", zlib.crc32(part.tobytes())), ("ids", part.astype(np.int32))):
                        if c != "ids" or with_ids:
                            out[c].append(v)
            yield out

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), pieces, PIECES + ", ids array<int>" * with_ids)


class _Bins:
    """Sequences as intervals of equal free space."""

    def __init__(self, size: int):
        self.size, self.next, self.free = size, 0, defaultdict(list)
        self.levels: list[int] = []

    def put(self, room: int, lo: int, n: int) -> None:
        if room and n:
            if not self.free[room]:
                self.levels.insert(bisect_left(self.levels, room), room)
            self.free[room].append((lo, n))

    def take(self, room: int, n: int) -> tuple[int, int]:
        """An interval of at most n sequences with exactly that room."""
        lo, m = self.free[room].pop()
        if m > n:
            self.free[room].append((lo + n, m - n))
            m = n
        if not self.free[room]:
            self.levels.remove(room)
        return lo, m

    def open(self, n: int) -> int:
        self.next += n
        return self.next - n


def _groups(counts: dict[int, int], n_groups: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: (rounded size, [[length, count]...]) from the longest on."""
    total = sum(counts.values())
    each = max(1, -(-total // n_groups))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = each
            n = min(left, room)
            out[-1][1].append([length, n])
            left, room = left - n, room - n
    return out


def configurations(sizes: np.ndarray, counts: np.ndarray, size: int) -> list[tuple[list[int], float]]:
    """(groups of a sequence, how many such sequences) of an optimal fractional packing of a few sizes.

    Minimises the number of sequences over all configurations of one to three sizes, each over a
    fourth of a sequence, by column generation: a step prices pairs with the dearest third size
    that still fits, found in a table of the dearest size up to each room, and brings in the best.
    sizes fall, and the plan starts from one size to a sequence.
    """
    g = len(sizes)
    a, b = np.triu_indices(g)
    room = size - sizes[a] - sizes[b]
    fits = room >= 0
    a, b, room = a[fits], b[fits], room[fits]
    # the first group (of falling sizes) that fits a room; those after it fit too
    third = np.searchsorted(-sizes, -room, "left")
    second = np.searchsorted(-sizes, sizes - size, "left")
    basis, inverse, x = [[i] for i in range(g)], np.eye(g), counts.astype(float)
    for _ in range(60 * g):  # more steps improve it further, but any is a plan
        price = inverse.sum(0)
        # dearest price among groups i, i + 1, ...: none beyond the last
        dear = np.append(np.maximum.accumulate(price[::-1])[::-1], 0.0)
        three = price[a] + price[b] + np.maximum(dear[third], 0.0) if len(a) else np.zeros(1)
        best, column = 1 + 1e-9, None
        if len(a) and three.max() > best:
            i = int(three.argmax())
            best, column = three[i], [int(a[i]), int(b[i])]
            if dear[third[i]] > 0:
                column.append(int(third[i] + price[third[i] :].argmax()))
        two = price + np.maximum(dear[second], 0.0)
        if two.max() > best:
            i = int(two.argmax())
            column = [i] + ([int(second[i] + price[second[i] :].argmax())] if dear[second[i]] > 0 else [])
        if column is None:
            break
        step = inverse[:, column].sum(1)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        x = x - t * step
        x[out] = t
        pivot = inverse[out] / step[out]
        step[out] = 0
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        basis[out] = column
    return [(sorted(config), float(v)) for config, v in zip(basis, x, strict=True) if v > 0]


def plan(histogram: dict[int, int], size: int = 2048, n_groups: int = 512) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, last rank, sequence of the first, offset in the sequence)."""
    return _plan(histogram, size, n_groups, True)[1]


def _plan(histogram: dict[int, int], size: int, n_groups: int, optimise: bool) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Number of sequences, and the runs."""
    bins, runs, used = _Bins(size), [], defaultdict(int)

    def lay(length: int, n: int, lo: int, at: int) -> None:
        runs.append((length, used[length], used[length] + n - 1, lo, at))
        used[length] += n

    large = {k: v for k, v in histogram.items() if k > size // 4}
    groups = _groups(large, n_groups)
    rounded = np.array([g[0] for g in groups], np.int64)
    left = np.array([sum(n for _, n in g[1]) for g in groups], np.int64)

    def best(room: int, but: list[int]) -> int:
        """Largest remaining group within room, -1 if there is none."""
        have = left.copy()
        for b in but:
            have[b] -= 1
        fit = np.flatnonzero((have > 0) & (rounded <= room))
        return int(fit[0]) if len(fit) else -1

    def place(config: list[int], times: int) -> None:
        """So many sequences of a configuration."""
        lo, done = bins.open(times), 0
        for g in config:
            left[g] -= times
        # actual lengths take the rounded places, as runs of equal lengths on all places
        slots = [_cut(groups[g][1], times) for g in config]
        marks = sorted({m for s in slots for m in _ends(s)})
        at = [0] * len(slots)
        got = [0] * len(slots)
        for mark in marks:
            n, fill = mark - done, 0
            for k, s in enumerate(slots):
                lay(s[at[k]][0], n, lo + done, fill)
                fill += s[at[k]][0]
                got[k] += n
                if got[k] == s[at[k]][1]:
                    at[k], got[k] = at[k] + 1, 0
            bins.put(size - fill, lo + done, n)
            done = mark

    if optimise and len(groups):
        for config, times in configurations(rounded, left, size):
            whole = min([int(times + 1e-6), *[int(left[g]) // config.count(g) for g in config]])
            if whole:
                place(config, whole)
    while left.any():
        a = int(np.flatnonzero(left)[0])
        config, fill = [a], int(rounded[a])
        second = [int(b) for b in np.flatnonzero((left > 0) & (rounded <= size - rounded[a])) if b != a or left[a] > 1]
        top = (fill, [a])
        for b in second:
            c = best(size - fill - int(rounded[b]), [a, b])
            got = [a, b] + [c] * (c >= 0)
            top = max(top, (int(rounded[got].sum()), got), key=lambda t: (t[0], -len(t[1])))
        config = top[1]
        place(config, min(int(left[g]) // config.count(g) for g in config))
    for length in sorted((k for k in histogram if k <= size // 4), reverse=True):
        todo = histogram[length]
        while todo:
            k = bisect_left(bins.levels, length)
            if k == len(bins.levels):
                per = size // length
                n = -(-todo // per)
                bins.put(size, bins.open(n), n)
                continue
            room = bins.levels[k]
            lo, n = bins.take(room, todo)
            lay(length, n, lo, size - room)
            bins.put(room - length, lo, n)
            todo -= n
    return bins.next, runs


def _cut(members: list[list[int]], n: int) -> list[tuple[int, int]]:
    """Takes n members off a group: (length, count) runs."""
    out = []
    while n:
        m = min(n, members[0][1])
        out.append((members[0][0], m))
        members[0][1] -= m
        if not members[0][1]:
            members.pop(0)
        n -= m
    return out


def _ends(runs: list[tuple[int, int]]) -> list[int]:
    return np.cumsum([n for _, n in runs]).tolist()


def _ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """rank of each piece within its length, from 0, counted by salted buckets."""
    order = ["doc_id", "piece", "ids_crc32"]
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    within = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1)
    return within.join(before, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "bucket")


def pack(pieces: DataFrame, size: int = 2048, n_groups: int = 512, buckets: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset: gapless from 0 in each sequence.

    pieces must be materialised, or at least give the same rows whenever it is run.
    An empty table gives an empty result.  The number of buckets follows that of pieces, so
    that one length of all pieces is ranked in parts of about BUCKET_ROWS at any size.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    buckets = buckets or max(LEAST_BUCKETS, -(-sum(histogram.values()) // BUCKET_ROWS))
    runs = plan(histogram, size, n_groups)
    # runs of a length lie in ascending rank: a slice of ranks finds them without a scan of all
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    table = spark.createDataFrame(pa.table(dict(zip(("length", "first", "last", "seq", "offset"), map(pa.array, columns), strict=True))))
    hit = (F.col("r.length") == F.col("p.length")) & F.col("p.rank").between(F.col("r.first"), F.col("r.last"))
    # at most about 4 runs for each pair of a length and a level of free space, 24 bytes each: broadcast by its size
    near = F.broadcast(table) if len(runs) <= 200_000 else table
    cols = [F.col(f"p.{c}") for c in pieces.columns]
    return _ranked(pieces, buckets).alias("p").join(near.alias("r"), hit).select(*cols, (F.col("r.seq") + F.col("p.rank") - F.col("r.first")).alias("sequence_id"), F.col("r.offset").alias("offset"))


def best_fit_packing(docs: DataFrame, size: int = 2048, path: str | None = None, n_groups: int = 512) -> DataFrame:
    """Packs whole documents: one row per piece with its place."""
    return pack(materialise(token_pieces(docs, size, path), "pieces"), size, n_groups)
