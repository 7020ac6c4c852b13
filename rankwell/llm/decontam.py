"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (size consecutive words; a shorter item is one window) is a set
of word shingles that must be contained whole in a document, so one shingle is a
sufficient prefix.  Shingles are ordered by rarity, counted over all documents; the
document side joins on each window's rarest shingle only.  A hit gives the one place the
window could stand at; the length and positional bounds discard places that leave the
text, and the words of the rest are compared exactly.

Windows are dealt into blocks of a fixed number of distinct ones.  A block is what the
driver and a task hold; all documents pass by each block, so any number of windows is
handled.  Which items a window belongs to, and of a common one these may be very many,
stays in a table that is joined with the distinct sets of windows that documents hold.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm import textvec as tv
from rankwell.llm.common import arrow_map, discard, materialise, small

WINDOW = 13
SHINGLE = 3
#: Distinct windows of a block: some 200 bytes each on the driver and in a task.
BLOCK_ROWS = 100_000
#: Up to this many sets of windows with their items' hash are broadcast; more are joined by a shuffle.
BROADCAST_SETS = 200_000
_FILTER = 1 << 18


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, window, n): distinct windows of each item, words joined by a blank.  No words: none."""

    def run(batch):
        ids = batch.column("item_id")
        for s in tv.slices(batch.column("text")):
            starts, ends, first, data = tv.words(s, tv.ALNUM, lower=True)
            item, window, n = [], [], []
            for i in range(len(s)):
                own = [data[a:b].tobytes() for a, b in zip(starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist(), strict=True)]
                seen = {b" ".join(own[k : k + size]) for k in range(max(1, len(own) - size + 1))} if own else set()
                item += [ids[s.lo + i].as_py()] * len(seen)
                window += sorted(seen)
                n += [min(size, len(own))] * len(seen)
            yield {"item": item, "window": pa.array(window, pa.binary()), "n": n}

    return arrow_map(items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text"), run, "item string, window binary, n int")


@dataclass
class Block:
    """Windows of a block with their shingles, which become prefixes once they are counted."""

    windows: list[bytes]
    shingles: list[list[tuple[int, int]]]  # of each window: (hash, width)

    @property
    def widths(self) -> list[int]:
        return sorted({w for s in self.shingles for _, w in s})

    def hashes(self, width: int) -> np.ndarray:
        return np.unique(np.array([h for s in self.shingles for h, w in s if w == width], np.uint64))


def window_id(window: bytes) -> str:
    return hashlib.sha256(window).hexdigest()[:32]


def _block(windows: list[bytes]) -> Block:
    windows = sorted(windows)
    shingles = []
    for w in windows:
        data = np.frombuffer(w, np.uint8)
        gap = np.flatnonzero(data == 0x20)
        h = tv.span_hashes(data, np.append(0, gap + 1), np.append(gap, len(data)))
        k = min(SHINGLE, len(h))
        shingles.append([(int(x), k) for x in tv.run_hashes(h, k)])
    return Block(windows, shingles)


class _Known:
    """Fast test of many hashes against a sorted few."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(_FILTER, bool)
        self.bits[(keys & np.uint64(_FILTER - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of known hashes, and which they are."""
        at = np.flatnonzero(self.bits[(h & np.uint64(_FILTER - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[k] == h[at]
        return at[good], k[good]


def count_shingles(docs: DataFrame, block: Block) -> dict[tuple[int, int], int]:
    """Occurrences in all documents of the block's shingles: at most a row for each."""
    widths = {w: block.hashes(w) for w in block.widths}

    def run(batches):
        known = {w: _Known(k) for w, k in widths.items()}
        total = {w: np.zeros(len(k), np.int64) for w, k in widths.items()}
        for batch in batches:
            for s in tv.slices(batch.column(0)):
                starts, ends, first, data = tv.words(s, tv.ALNUM, lower=True)
                h = tv.span_hashes(data, starts, ends)
                own = tv.owner_of(first)
                for w, k in known.items():
                    if len(h) >= w:
                        at, which = k.find(tv.run_hashes(h, w))
                        which = which[own[at] == own[at + w - 1]]
                        total[w] += np.bincount(which, minlength=len(total[w]))
        for w, t in total.items():
            hit = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(widths[w][hit].view(np.int64)), pa.array(np.full(len(hit), w, np.int32)), pa.array(t[hit])], names=["h", "w", "n"])

    got = docs.select("text").mapInArrow(run, "h long, w int, n long").groupBy("h", "w").agg(F.sum("n").alias("n")).collect()
    return {(r["h"] & (2**64 - 1), r["w"]): r["n"] for r in got}


def _match(docs: DataFrame, block: Block, counts: dict[tuple[int, int], int], size: int) -> DataFrame:
    """Adds the block's spans (first word, word after) and windows to each document's."""
    prefix: dict[int, list[tuple[int, int, int]]] = {}
    for i, s in enumerate(block.shingles):
        _, at = min((counts.get(x, 0), p) for p, x in enumerate(s))
        if all(counts.get(x, 0) for x in s):  # a shingle that occurs nowhere rules the window out
            prefix.setdefault(s[at][1], []).append((s[at][0], i, at))
    tables = {}
    for w, rows in prefix.items():
        rows.sort()
        keys, first = np.unique(np.array([r[0] for r in rows], np.uint64), return_index=True)
        tables[w] = (keys, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    used = sorted({int(i) for t in tables.values() for i in t[2]})
    windows = {i: block.windows[i] for i in used}
    names = {i: window_id(windows[i]) for i in used}
    length = {i: windows[i].count(b" ") + 1 for i in used}
    columns = docs.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)

    def run(batch):
        for s in tv.slices(batch.column("text")):
            starts, ends, first, data = tv.words(s, tv.ALNUM, lower=True)
            h = tv.span_hashes(data, starts, ends)
            own = tv.owner_of(first)
            spans: list[list] = [list(x) for x in batch.column("spans").slice(s.lo, len(s)).to_pylist()]
            found: list[set] = [set(x) for x in batch.column("windows").slice(s.lo, len(s)).to_pylist()]
            sure: dict[tuple[int, int], bool] = {}
            for w, (keys, begin, which, offset) in tables.items():
                if len(h) < w:
                    continue
                at, k = _Known(keys).find(tv.run_hashes(h, w))
                for place, key in zip(at.tolist(), k.tolist(), strict=True):
                    doc = int(own[place])
                    for r in range(begin[key], begin[key + 1]):
                        i = int(which[r])
                        lo = place - int(offset[r])
                        hi = lo + length[i]
                        if lo < first[doc] or hi > first[doc + 1] or (i, lo) in sure:
                            continue
                        if sure.setdefault((i, lo), b" ".join(data[a:b].tobytes() for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)) == windows[i]):
                            spans[doc].append({"lo": lo - int(first[doc]), "hi": hi - int(first[doc])})
                            found[doc].add(names[i])
            yield {c: batch.column(c).slice(s.lo, len(s)) for c in columns} | {
                "n_words": np.diff(first),
                "spans": [_merged(x) for x in spans],
                "windows": [sorted(x) for x in found],
            }

    return arrow_map(docs, run, kinds)


def _merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["lo"], x["hi"])):
        if out and x["lo"] <= out[-1]["hi"]:
            out[-1]["hi"] = max(out[-1]["hi"], x["hi"])
        else:
            out.append(dict(x))
    return out


def _pieces(items: DataFrame, size: int) -> DataFrame:
    return materialise(windows_of(items, size).distinct(), "windows")


def find_contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_rows: int = BLOCK_ROWS, pieces: DataFrame | None = None) -> DataFrame:
    """docs' own columns with n_words, spans (array of lo, hi in words, disjoint), windows (ids of those that occur), n_hit and contaminated.

    Null texts have no words and no hits; so have all documents when there are no items.
    Items without words or without an id have no windows; rows of one item_id are one item.
    Repeated documents are judged one by one, and further columns are ignored.
    """
    own = docs.select(*[c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns])
    distinct = (_pieces(items, size) if pieces is None else pieces).select("window").distinct()
    n_blocks = max(1, -(-distinct.count() // block_rows))
    out = own.select("*", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<lo:long,hi:long>>").alias("spans"), F.array().cast("array<string>").alias("windows"))
    for b in range(n_blocks):
        part = distinct.where(F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == b)
        block = _block([bytes(r["window"]) for r in part.collect()])  # about block_rows distinct windows
        last, out = out, _match(out, block, count_shingles(own, block), size)
        if n_blocks > 1:
            out = materialise(out, "block")
            if b:
                discard(last)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    out = out.withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def items_of(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """found (set_key, windows), each set once, with items: the sorted ids of the items whose windows these are."""
    name = F.substring(F.sha2("window", 256), 1, 32)
    each = found.select("set_key", F.explode("windows").alias("w")).join(pieces.select(name.alias("w"), "item"), "w")
    return each.select("set_key", "item").distinct().groupBy("set_key").agg(F.array_sort(F.collect_list("item")).alias("items"))


def report(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items of each document."""
    pieces = _pieces(items, size)
    judged = find_contamination(docs, items, size, block_rows, pieces).select("doc_id", "n_words", "n_hit", "contaminated", "windows")
    judged = materialise(judged.withColumn("set_key", F.when(F.size("windows") > 0, F.sha2(F.array_join("windows", ""), 256))), "judged")
    sets = judged.where("set_key is not null").groupBy("set_key").agg(F.first("windows").alias("windows"))
    known = items_of(sets, pieces).select("set_key", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha"), "items")
    out = judged.drop("windows").join(small(materialise(known, "sets"), BROADCAST_SETS), "set_key", "left").drop("set_key")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("sha", F.lit(digest([]))).alias("items_sha256"), "contaminated", F.coalesce("items", none).alias("items"))
