"""Repeated passages by the common-prefix interval tree of a sparse enhanced suffix array.

Suffixes start at anchors only: of the K-byte strings of every LENGTH-byte string, the one
of the least hash.  Both places of a repeated LENGTH-byte string have the same anchor at the
same distance, so what is sought are occurrences of one anchor whose contexts, to the left
and from the anchor on to the right, agree over LENGTH bytes together; nothing beyond the
strings that hold the anchor matters, so contexts are bounded.

Occurrences of equal contexts are one class.  Where an anchor has several classes, one
occurrence of each is sorted by its right context (the suffix array of that anchor).  A
stack-scan over common prefixes of neighbours finds the intervals of the tree; within an
interval, a second scan over left contexts finds the members that go on alike to the left,
and a group is put out if its members differ on the next byte on either side: a maximal
repeat with all its occurrences.  Equality is that of bytes there, and of 64-bit digests
(of bytes, keyed) between occurrences of one anchor and class.

Texts are written once, each partition as its own bucket; marks travel to the texts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm import textvec as tv
from rankwell.llm.common import arrow_map, bound_batches, discard, hand_back, materialise

#: Length of the strings that may not start twice, and of an anchor.
LENGTH, K = 400, 64
#: Classes of an anchor up to which they are sorted by one task; beyond, whole windows are counted instead.
HOT_CLASSES = 50_000
#: A document's place: its partition, and its first byte within it.
PART_BITS = 42
OCCURRENCE = "anchor long, cls long, base long, pos int"


def write_texts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as a table of part, base, doc_id, text as bytes; a partition's rows are one bucket.

    base tells rows apart, repeated ones too, and orders them; a null text is empty.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            text = b.column("text").cast(pa.binary()).fill_null(b"")
            n = np.fromiter((len(t.as_buffer()) for t in text), np.int64, b.num_rows)
            base = (part << PART_BITS) + at + np.arange(b.num_rows) + np.cumsum(n) - n  # a byte between texts: empty ones differ too
            at += int(n.sum()) + b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part), pa.int64()), pa.array(base), b.column("doc_id").cast(pa.int64()), text], names=["part", "base", "doc_id", "text"])
            hand_back()

    done = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "part long, base long, doc_id long, text binary")
    name = f"texts_{uuid.uuid4().hex}"
    parts = max(1, min(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))))
    done.write.bucketBy(parts, "part").option("compression", "zstd").saveAsTable(name)
    # a join on (part, base) may then leave the texts where they are
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(name).alias(name)


def drop_texts(texts: DataFrame) -> None:
    """Drops what write_texts wrote, once nothing reads it any more."""
    name = next(n for n in texts._jdf.queryExecution().analyzed().toString().split() if n.startswith("texts_"))
    texts.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def anchor_places(s: tv.Slice, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Places in the slice of all anchors, and their hashes: of every length bytes of a text, the first k-byte string of least hash."""
    n, w = len(s.data), length - k + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(n - k + 1)
    h = tv.gram_hashes(s.data, k)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    rows = np.concatenate([key, np.full(-len(key) % w, ~np.uint64(0))]).reshape(-1, w)
    upto = np.minimum.accumulate(rows, 1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    m = len(key) - w + 1
    least = np.minimum(onward[:m], upto[w - 1 : w - 1 + m])
    end = np.repeat(s.offsets[1:], np.diff(s.offsets))
    least = least[np.arange(m) + length <= end[:m]]
    at = np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return at, h[at]


def contexts(text: bytes, pos: int, length: int = LENGTH, k: int = K) -> tuple[bytes, bytes]:
    """What precedes an anchor, backwards, and what follows from it on, as far as strings of length bytes hold it."""
    return text[max(0, pos - length + k) : pos][::-1], text[pos : pos + length]


def _digest(*parts: bytes) -> int:
    h = hashlib.blake2b(digest_size=8, key=b"contexts")
    for p in parts:
        h.update(len(p).to_bytes(4, "little") + p)
    return int.from_bytes(h.digest(), "little", signed=True)


def occurrences(texts: DataFrame, length: int = LENGTH, k: int = K, classes: bool = True) -> DataFrame:
    """(anchor, cls, base, pos): every anchor of every text; cls is a digest of its contexts, 0 unless asked for."""

    def run(batch):
        base = np.asarray(batch.column("base"))
        for s in tv.slices(batch.column("text")):
            at, h = anchor_places(s, length, k)
            doc = np.searchsorted(s.offsets, at, "right") - 1
            pos = at - s.offsets[doc]
            cls = np.zeros(len(at), np.int64)
            if classes and len(at):
                raw = s.data.tobytes()
                lo, hi = s.offsets[doc], s.offsets[doc + 1]
                cls = [_digest(raw[max(a, p - length + k) : p], raw[p : min(b, p + length)]) for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            yield {"anchor": h.view(np.int64), "cls": cls, "base": base[s.lo + doc], "pos": pos.astype(np.int32)}

    return arrow_map(texts.select("base", "text"), run, OCCURRENCE)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] agrees, a[:hi] does not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of each interval of the common-prefix tree with value >= least; lcp[i] is that of i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, first = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > now:
            value, first = stack.pop()
            yield value, first, i - 1
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(left: list[bytes], right: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(l, r, members) of each maximal repeat of at least length bytes about one anchor.

    right is sorted.  All members agree on l bytes before and r bytes from the anchor on, and
    not all of them on one more on either side; every such set of two and more is put out once.
    """
    lcp = [0] + [_common(a, b) for a, b in zip(right, right[1:], strict=False)]
    for r, first, last in intervals(lcp, 1):
        most = max(len(left[i]) for i in range(first, last + 1))
        if r + most < length:
            continue
        members = sorted(range(first, last + 1), key=left.__getitem__)
        side = [0] + [_common(left[a], left[b]) for a, b in zip(members, members[1:], strict=False)]
        child, c = {}, 0
        for i in range(first, last + 1):
            c += i > first and lcp[i] == r
            child[i] = c
        for lo, a, b in intervals(side, max(0, length - r)):
            group = members[a : b + 1]
            if any(child[i] != child[group[0]] for i in group):  # else they agree on a longer right side
                yield lo, r, group


def _tree(rows: DataFrame, length: int) -> DataFrame:
    """(base, pos, l, r): how far repeats reach about each occurrence, of rows (anchor, left, right, base, pos)."""

    def solve(group: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
        best = [(0, 0)] * len(group)
        for lo, r, members in maximal_repeats([g[1] for g in group], [g[2] for g in group], length):
            for i in members:
                best[i] = max(best[i][0], lo), max(best[i][1], r)
        yield from ((g[3], g[4], lo, r) for g, (lo, r) in zip(group, best, strict=True) if r)

    def run(batches):
        group: list[tuple] = []
        for b in batches:
            done: list[tuple[int, int, int, int]] = []
            for row in zip(*(b.column(c).to_pylist() for c in ("anchor", "left", "right", "base", "pos")), strict=True):
                if group and row[0] != group[0][0]:
                    done += solve(group)
                    group = []
                group.append(row)
            yield batch_of(done)
            hand_back()
        if group:
            yield batch_of(list(solve(group)))

    def batch_of(done):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate(kinds)], names=["base", "pos", "l", "r"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "anchor").sortWithinPartitions("anchor", "right").mapInArrow(run, "base long, pos int, l int, r int")


def _counted(windows: DataFrame, length: int) -> DataFrame:
    """(base, pos, l, r) by counting the places of whole windows, for anchors of too many classes for one task."""
    start = F.col("base") + F.col("pos") - F.col("off")  # one window may hold its anchor twice
    often = windows.groupBy("anchor", "win").agg(F.min(start).alias("a"), F.max(start).alias("b")).where("a < b").select("anchor", "win")
    return windows.join(often, ["anchor", "win"]).groupBy("base", "pos").agg(F.max("off").alias("l"), (length - F.min("off")).cast("int").alias("r"))


def _asked(texts: DataFrame, asked: DataFrame, length: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of the asked occurrences (anchor, base, pos, hot), and windows of the hot ones."""
    part = F.shiftright("base", PART_BITS).alias("part")
    lists = asked.groupBy(part, "base", "hot").agg(F.collect_list(F.struct("pos", "anchor")).alias("marks"))

    def context(batch):
        for base, marks, text in zip(*(batch.column(c).to_pylist() for c in ("base", "marks", "text")), strict=True):
            both = [contexts(text, m["pos"], length, k) for m in marks]
            yield {"anchor": [m["anchor"] for m in marks], "left": [x for x, _ in both], "right": [x for _, x in both], "base": [base] * len(marks), "pos": [m["pos"] for m in marks]}

    def window(batch):
        for base, marks, text in zip(*(batch.column(c).to_pylist() for c in ("base", "marks", "text")), strict=True):
            for m in marks:
                off = [o for o in range(length - k + 1) if 0 <= m["pos"] - o <= len(text) - length]
                win = [_digest(text[m["pos"] - o : m["pos"] - o + length]) for o in off]
                yield {"anchor": [m["anchor"]] * len(off), "win": win, "base": [base] * len(off), "pos": [m["pos"]] * len(off), "off": off}

    def with_text(hot: bool) -> DataFrame:
        return texts.select("part", "base", "text").join(lists.where(F.col("hot") == hot), ["part", "base"]).select("base", "marks", "text")

    return arrow_map(with_text(False), context, "anchor long, left binary, right binary, base long, pos int"), arrow_map(with_text(True), window, "anchor long, win long, base long, pos int, off int")


def repeated_spans(texts: DataFrame, length: int = LENGTH, k: int = K, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """(base, pos, l, r): bytes pos - l to pos + r of the text at base are covered by strings of length bytes that repeat."""
    # anchors that stand at two places at least, then their occurrences with classes; both are
    # dealt out anew for the join, so that Spark can split an anchor that very many places share
    again = materialise(occurrences(texts, length, k, classes=False).groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    found = materialise(occurrences(texts, length, k).join(again, "anchor", "left_semi"), "occurrences")
    at = F.col("base") + F.col("pos")
    classes = materialise(found.groupBy("anchor", "cls").agg(F.count("*").alias("n"), F.min("base").alias("base"), F.min(at).alias("at")), "classes")
    many = classes.groupBy("anchor").agg(F.count("*").alias("n_cls")).where("n_cls > 1")
    asked = classes.join(many, "anchor").select("anchor", "base", (F.col("at") - F.col("base")).cast("int").alias("pos"), (F.col("n_cls") > hot_classes).alias("hot"))
    cold, hot = _asked(texts, asked, length, k)
    # all occurrences of a class that has two: their contexts are repeated as they are
    whole = found.join(classes.where("n > 1").select("anchor", "cls"), ["anchor", "cls"], "left_semi").select("base", "pos", F.lit(length - k).alias("l"), F.lit(length).alias("r"))
    spans = _tree(cold, length).unionByName(_counted(hot, length)).unionByName(whole)
    out = materialise(spans, "spans")
    discard(again)
    discard(found)
    discard(classes)
    return out


def merged(n: int, spans: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs covered by spans of a text of n bytes; spans are cut at its ends and count if length bytes remain."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, a), min(n, b)) for a, b in spans):
        if b - a < length:
            continue
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, hot_classes: int = HOT_CLASSES, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each text without the bytes of repeated strings.

    A byte goes if a string of length bytes that covers it also starts elsewhere, in any document,
    its own included; strings are judged on the input.  One row for each row of docs, repeated rows
    are documents of their own and repeat each other; null and short texts lose nothing; other
    columns are left out.  keep adds kept, the remaining bytes, which need not be whole characters.
    """
    texts = write_texts(docs)
    spans = repeated_spans(texts, length, k, hot_classes)
    lists = spans.groupBy(F.shiftright("base", PART_BITS).alias("part"), "base").agg(F.collect_list(F.struct((F.col("pos") - F.col("l")).alias("a"), (F.col("pos") + F.col("r")).alias("b"))).alias("spans"))

    def run(batch):
        out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep)}
        for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            gone = merged(len(text), [(x["a"], x["b"]) for x in own or ()], length)
            edges = [0, *(e for g in gone for e in g), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            for c, v in zip(out, (len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept), strict=False):
                out[c].append(v)
        yield out | {"doc_id": batch.column("doc_id")}

    both = texts.join(lists, ["part", "base"], "left").select("doc_id", "text", "spans")
    out = materialise(arrow_map(both, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep), "kept")
    discard(spans)
    drop_texts(texts)
    return out
