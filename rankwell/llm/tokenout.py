"""Token-id shards with a minimal perfect hash index.

A shard is one file, little-endian:

    magic ``RWTOK2\\0\\0`` | ids, 2 or 4 bytes each | header: 8 uint64 (rows, keys, ids, levels, id width, 3 spare)
    level sizes in bits (levels x uint64) | bit sets of all levels | their ranks per word
    fingerprints (keys x uint32) | entry of each key (keys x uint64) | rows of each key (keys x uint32)
    doc_ids (rows x int64) | null flags (rows x uint8) | first id of each row (rows + 1 x uint64)
    place of the header (uint64) | magic

The ids come first, so a task writes them as they are encoded and holds some 40 bytes for
each row, whatever the texts' lengths.  The hash is minimal and perfect by levels of bit
sets: a key alone in its bit stays, the others go on to the next level; its rank among the
bits set is its index.  A lookup finds the shard by its range of keys, tests an expected
constant number of bits, compares the stored fingerprint and seeks.  Rows lie in ascending
doc_id order in a shard and from shard to shard; rows of one doc_id may fill several shards.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm import textvec as tv
from rankwell.llm.common import arrow_map, bound_batches, fresh_folder, hand_back
from rankwell.llm.tokens import PieceEncoder, default_path

MAGIC = b"RWTOK2\0\0"
GAMMA = 2
#: Bytes of text of a shard at most and at least, about; between them they grow with the corpus's square root.
MOST_SHARD_BYTES, LEAST_SHARD_BYTES = 128 << 20, 1 << 20
#: Rows that are read back at a time.
READ_ROWS = 4096
MANIFEST = "path string, shard int, least long, most long, n_rows long, n_ids long"


def _level_hash(keys: np.ndarray, level: int) -> np.ndarray:
    return tv.mix(keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1)))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_level_hash(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct int64 keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        counts = np.bitwise_count(bits).astype(np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint64) if len(bits) else np.zeros(0, np.uint64)

    @staticmethod
    def build(keys: np.ndarray) -> "PerfectHash":
        sizes, sets = [], []
        while len(keys):
            size = -(-GAMMA * len(keys) // 64) * 64
            at = (_level_hash(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size // 64, np.uint64)
            np.bitwise_or.at(bits, at[alone] >> 6, np.uint64(1) << (at[alone] & 63).astype(np.uint64))
            sizes.append(size)
            sets.append(bits)
            keys = keys[~alone]
        return PerfectHash(sizes, np.concatenate(sets) if sets else np.zeros(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; of a key that was never added any index, or -1."""
        out, todo, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = (_level_hash(keys[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = base + (at >> 6), np.uint64(1) << (at & 63).astype(np.uint64)
            here = (self.bits[word] & bit) != 0
            w, b = word[here], bit[here]
            out[todo[here]] = (self.ranks[w] + np.bitwise_count(self.bits[w] & (b - np.uint64(1)))).astype(np.int64)
            todo, base = todo[~here], base + size // 64
        return out


def index_bytes(keys: np.ndarray, missing: np.ndarray, starts: np.ndarray, width: int) -> list[bytes]:
    """Header and index of rows in ascending key order; missing marks null keys, which have no index entry."""
    live = np.flatnonzero(~missing)
    own, first, n = np.unique(keys[live], return_index=True, return_counts=True)
    entry = live[first].astype(np.uint64) if len(own) else np.zeros(0, np.uint64)
    mph = PerfectHash.build(own)
    at = mph.index(own)
    table = [np.zeros(len(own), t) for t in (np.uint32, np.uint64, np.uint32)]
    for t, v in zip(table, (fingerprints(own), entry, n), strict=True):
        t[at] = v
    head = np.array([len(keys), len(own), starts[-1], len(mph.sizes), width, 0, 0, 0], "<u8")
    return [p.tobytes() for p in (head, np.array(mph.sizes, "<u8"), mph.bits.astype("<u8"), mph.ranks.astype("<u8"), *table, keys.astype("<i8"), missing.astype(np.uint8), starts.astype("<u8"))]


class Shard:
    """Random access to a shard: reads the index at once and ids by seeking."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        file.seek(file.tell() - 16)
        at = int(self._read("<u8", 1)[0])
        assert file.read(8) == MAGIC, "not a token shard"
        file.seek(at)
        self.n_rows, self.n_keys, self.n_ids, levels, self.width = map(int, self._read("<u8", 8)[:5])
        sizes = self._read("<u8", levels).tolist()
        words = sum(sizes) // 64
        self.mph = PerfectHash(sizes, self._read("<u8", words))
        self._read("<u8", words)
        self.prints, self.entry, self.copies = (self._read(t, self.n_keys) for t in ("<u4", "<u8", "<u4"))
        self.keys, self.missing, self.starts = self._read("<i8", self.n_rows), self._read("u1", self.n_rows).astype(bool), self._read("<u8", self.n_rows + 1).astype(np.int64)

    def _read(self, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read(np.dtype(kind).itemsize * n), kind)

    def ids(self, row: int, rows: int = 1) -> np.ndarray:
        """Ids of a row, or of some that follow each other."""
        lo, hi = self.starts[row], self.starts[row + rows]
        self.file.seek(len(MAGIC) + int(lo) * self.width)
        return self._read(f"<u{self.width}", int(hi - lo)).astype("<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row of each key and how many follow, by the hash index; none for an unknown key."""
        at = self.mph.index(keys)
        known = at >= 0
        known[known] = self.prints[at[known]] == fingerprints(keys[known])
        # one of 2^32 unknown keys has the right fingerprint: the stored doc_id decides
        first = np.where(known, self.entry[np.maximum(at, 0)] if self.n_keys else 0, 0).astype(np.int64)
        known &= (self.keys[first] == keys) if self.n_rows else False
        return first, np.where(known, self.copies[np.maximum(at, 0)] if self.n_keys else 0, 0).astype(np.int64)

    def rows_of(self, keys: np.ndarray) -> list[range]:
        return [range(f, f + n) for f, n in zip(*(x.tolist() for x in self.find(keys)), strict=True)]


def _store(uri: str):
    """A file system that executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _shards(docs: DataFrame) -> int:
    """Number of shards by bytes of text: one holds the square root of 64 KiB times the corpus, within the bounds."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = min(MOST_SHARD_BYTES, max(LEAST_SHARD_BYTES, int((size << 16) ** 0.5)))
    return max(1, -(-size // each))


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Encodes whole texts and writes shards below folder; returns their manifest, written by Spark.

    null text: the end id alone.  null doc_id: rows before all others, without an index
    entry.  Rows of equal doc_id are in order of a hash of their text, then the text, and
    may be cut between shards; columns other than doc_id and text are left out.
    """
    spark = docs.sparkSession
    path = path or default_path("byte_bpe_50k.json")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = shards or _shards(plain)
    key = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    ordered = plain.withColumn("h", F.xxhash64("text")).repartitionByRange(n, *key).sortWithinPartitions(*key, "text").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        enc = PieceEncoder.of(path)
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        keys, missing, lengths = [], [], []
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"{base}/shard-{task.partitionId():06d}.tok"
        mine = f"{name}.{task.taskAttemptId()}"
        # a lost or repeated attempt writes the same bytes; the last move is atomic
        with store.open_output_stream(mine) as out:
            out.write(MAGIC)
            for b in batches:
                k = b.column("doc_id")
                missing.append(np.asarray(k.is_null()))
                keys.append(np.asarray(k.fill_null(0)))
                for s in tv.slices(b.column("text")):
                    flat, first = enc.encode(s)
                    lengths.append(np.diff(first) + 1)
                    out.write(np.insert(flat, first[1:], end_id).astype(f"<u{width}").tobytes())
                hand_back()
            rows = sum(map(len, keys))
            if rows:
                keys, missing, lengths = map(np.concatenate, (keys, missing, lengths))
                starts = np.concatenate([[0], np.cumsum(lengths)])
                for part in index_bytes(keys, missing, starts, width):
                    out.write(part)
                out.write((len(MAGIC) + int(starts[-1]) * width).to_bytes(8, "little") + MAGIC)
        if not rows:
            store.delete_file(mine)
            return
        store.move(mine, name)
        live = keys[~missing]
        row = {"path": [name], "shard": [task.partitionId()], "least": [None if missing[0] else int(keys[0])], "most": [int(live[-1]) if len(live) else None], "n_rows": [rows], "n_ids": [int(starts[-1])]}
        kind = pa.schema([("path", pa.string()), ("shard", pa.int32()), ("least", pa.int64()), ("most", pa.int64()), ("n_rows", pa.int64()), ("n_ids", pa.int64())])
        yield pa.RecordBatch.from_pydict(row, schema=kind)

    bound_batches(spark)
    manifest = ordered.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard, found (by the hash index) of every row, read from the files."""
    n = max(1, manifest.count())  # a row per shard
    starts = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids"))

    def read(batch):
        store, _ = _store(folder)
        for name, shard, base in zip(*(batch.column(c).to_pylist() for c in ("path", "shard", "base")), strict=True):
            with store.open_input_file(name) as file:
                s = Shard(file)
                for lo in range(0, s.n_rows, READ_ROWS):
                    hi = min(lo + READ_ROWS, s.n_rows)
                    rows = np.arange(lo, hi)
                    first, copies = s.find(s.keys[lo:hi])
                    yield {
                        "doc_id": pa.array(s.keys[lo:hi], pa.int64(), mask=s.missing[lo:hi]), "start": s.starts[lo:hi] + base, "n_tokens": np.diff(s.starts[lo : hi + 1]),
                        "ids_crc32": [zlib.crc32(s.ids(r).tobytes()) for r in rows.tolist()], "shard": [shard] * len(rows), "found": ~s.missing[lo:hi] & (rows >= first) & (rows < first + copies),
                    }

    return arrow_map(starts.repartition(n, "shard"), read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, found boolean")


def token_output(docs: DataFrame, folder: str | None = None, path: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes the shards and reads every document back from them."""
    folder = folder or fresh_folder(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, folder, path, shards=shards), folder)


class Corpus:
    """Keyed access to all shards of a manifest: the shard by its range of keys, the row by the shard's hash."""

    def __init__(self, manifest: DataFrame, folder: str):
        rows = manifest.where("most is not null").orderBy("shard").select("path", "least", "most").collect()  # a row per shard
        self.store, _ = _store(folder)
        self.paths, self.most = [r["path"] for r in rows], [r["most"] for r in rows]
        self.open: dict[str, Shard] = {}

    def lookup(self, key: int) -> list[np.ndarray]:
        """Ids of all rows of a key, in order; none for an unknown key."""
        from bisect import bisect_left

        out = []
        for i in range(bisect_left(self.most, key), len(self.paths)):
            if self.paths[i] not in self.open:
                self.open[self.paths[i]] = Shard(self.store.open_input_file(self.paths[i]))
            s = self.open[self.paths[i]]
            out += [s.ids(r) for r in s.rows_of(np.array([key], np.int64))[0]]
            if self.most[i] > key:  # rows of one key may go on in the next shard
                break
        return out
