"""Near-duplicate documents by HyperMinHash.

A document's distinct k-word shingles go to buckets by their hash; each bucket keeps the
leading-zero count (6 bits) and the next 10 mantissa bits of its smallest second hash.
Documents whose compressed registers agree on a whole band become candidates.  Within a
candidate group, the collision-corrected Jaccard estimate of the registers rules pairs
out, and the rest is confirmed on the full sets.  Components of the links give groups.

Exact copies are one node from the start.  Identical groups (many bands give the same
one) are compared once.  A group too large for a task is cut into blocks: each is compared
within itself and with the group's first member, which ties the blocks of a true group
together at a cost that grows with its size, not its square.  Only members that are still
in different components are then compared across blocks, so no link is lost.  Tasks
return links to the smallest member they have reached, not pairs.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm import textvec as tv
from rankwell.llm.common import arrow_map, discard, hand_back, materialise, small
from rankwell.llm.components import connected_components

#: Registers, and how many make a band: 32 bands of 6.  A pair of similarity 0.85 shares
#: none of them with probability 3e-7.
REGISTERS, BAND = 192, 6
MANTISSA_BITS = 10
#: Most members and shingles of one block of a candidate group.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 500_000
#: Up to this many candidate nodes or groups (about 40 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Share of registers that agree by accident (for equal sizes), times 2^-MANTISSA_BITS.
ACCIDENT = 0.169919487159739 / 2**MANTISSA_BITS

_rng = np.random.Generator(np.random.PCG64(7))
#: For an empty register, the registers that may lend it a value, in turn.
_LENDERS = _rng.integers(0, REGISTERS, (96, REGISTERS))


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 56-bit hashes of k-word shingles; of fewer words the one whole sequence."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(tv.run_hashes(words, min(k, len(words))) >> np.uint64(8))


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: 0 where no shingle fell."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(24)  # rises with the hash
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        least = np.minimum.reduceat(tv.mix(shingles), first)
        mantissa, exponent = np.frexp(((least >> np.uint64(11)) | np.uint64(1)).astype(np.float64))
        zeros = np.minimum(54 - exponent, 62)
        out[bucket[first].astype(np.int64)] = (zeros << MANTISSA_BITS) | ((mantissa * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    return out


def densified(r: np.ndarray) -> np.ndarray:
    """Registers (rows x REGISTERS) whose empty ones borrow from others in a fixed order."""
    out = r.copy()
    for lender in _LENDERS:
        empty = out == 0
        if not empty.any():
            return out
        out = np.where(empty, r[:, lender], out)
    top = r.max(axis=1, keepdims=True)
    return np.where(out == 0, top, out)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and registers that count."""
    either = ((a | b) != 0).sum(-1)
    same = ((a == b) & (a != 0)).sum(-1)
    accident = ACCIDENT * either
    return np.maximum(0.0, same - accident) / np.maximum(either - accident, 1e-9), either


def least_estimate(either: np.ndarray, similarity: float) -> np.ndarray:
    """Estimates down to six standard deviations below the similarity go on to verification."""
    return similarity - 6 * np.sqrt(similarity * (1 - similarity) / np.maximum(either, 1)) - 1e-9


def _pack(shingles: np.ndarray) -> bytes:
    """Seven bytes each: four low, two middle, one high."""
    return shingles.astype("<u4").tobytes() + (shingles >> np.uint64(32)).astype("<u2").tobytes() + (shingles >> np.uint64(48)).astype(np.uint8).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // 7
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | (np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)) | (np.frombuffer(raw, np.uint8, n, 6 * n).astype(np.uint64) << np.uint64(48))


SKETCH = "doc_id long, n_shingles long, set_key binary, registers binary, shingles binary"


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set), registers and shingles of whole texts."""
    import hashlib

    def sketch(batch):
        keys = batch.column("doc_id")
        for s in tv.slices(batch.column("text")):
            starts, ends, first, data = tv.words(s, tv.NONWHITE, lower=True)
            h = tv.span_hashes(data, starts, ends)
            sets = [shingle_set(h[first[i] : first[i + 1]], k) for i in range(len(s))]
            raw = [_pack(x) for x in sets]
            yield {
                "doc_id": keys.slice(s.lo, len(s)),
                "n_shingles": [len(x) for x in sets],
                "set_key": pa.array([hashlib.blake2b(x, digest_size=16).digest() if x else None for x in raw], pa.binary()),
                "registers": pa.array([registers(x).tobytes() for x in sets], pa.binary()),
                "shingles": pa.array(raw, pa.binary()),
            }

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sketch, SKETCH)


def band_keys(nodes: DataFrame) -> DataFrame:
    """(band_key, node, n) for each band of each node."""

    def bands(batch):
        reg = np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        dense = densified(reg).astype(np.uint64)
        n_bands = REGISTERS // BAND
        keys = np.empty((len(dense), n_bands), np.uint64)
        for b in range(n_bands):
            h = np.full(len(dense), b + 1, np.uint64)
            for c in range(b * BAND, (b + 1) * BAND):
                h = tv.mix(h * np.uint64(0x9E3779B97F4A7C15) + dense[:, c])
            keys[:, b] = h
        yield {
            "band_key": keys.ravel().view(np.int64),
            "node": np.repeat(np.asarray(batch.column("node")), n_bands),
            "n": np.repeat(np.asarray(batch.column("n")), n_bands),
        }

    return arrow_map(nodes.select("node", "n", "registers"), bands, "band_key long, node long, n long")


def _all_shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, over the shingles that two members share."""
    c = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(c), [len(x) for x in sets])
    by = np.argsort(flat, kind="stable")
    f, o = flat[by], owner[by]
    start = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
    count = np.diff(np.append(start, len(f)))
    column = np.repeat(np.arange(len(start)), count)
    keep = np.repeat(count > 1, count)
    o, column = o[keep], np.unique(column[keep], return_inverse=True)[1]
    width = int(column.max()) + 1 if len(column) else 0
    shared = np.zeros((c, c), np.float32)
    step = max(64, 4_000_000 // c)
    for lo in range(0, width, step):
        here = (column >= lo) & (column < lo + step)
        m = np.zeros((c, min(step, width - lo)), np.float32)
        m[o[here], column[here] - lo] = 1
        shared += m @ m.T
    return shared


def _confirm(nodes: list[int], side: np.ndarray, known: np.ndarray, sets: list[np.ndarray], reg: np.ndarray, similarity: float):
    """Links (node, smallest node it reaches here) of a group.

    side tells two blocks apart, or is all 0; members of equal known component need no
    comparison, and none is made between members that are joined already.
    """
    c = len(nodes)
    label = np.unique(known, return_inverse=True)[1]
    n = np.array([len(x) for x in sets], np.int64)
    cross = bool(side.any())
    shared, compared, links = None, 0, []
    for i in range(c):
        later = np.arange(i + 1, c)
        later = later[label[later] != label[i]]
        if cross:
            later = later[side[later] != side[i]]
        # a link needs sizes within the similarity of each other
        small, large = np.minimum(n[i], n[later]), np.maximum(n[i], n[later])
        later = later[small >= similarity * large - 1e-9]
        if not len(later):
            continue
        guess, either = estimate(reg[i], reg[later])
        for j in later[guess >= least_estimate(either, similarity)].tolist():
            if label[i] == label[j]:
                continue
            compared += 1
            if shared is None and c > 24 and compared > 8 * c:
                shared = _all_shared(sets)
            both = int(shared[i, j]) if shared is not None else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= round(100 * similarity) * (int(n[i] + n[j]) - both):
                label[label == label[j]] = label[i]
                links.append((i, j))
    groups = defaultdict(list)
    touched = {x for link in links for x in link}
    for i in sorted(touched):
        groups[label[i]].append(nodes[i])
    return [(x, min(g)) for g in groups.values() for x in g if x != min(g)]


def _group_links(rows: DataFrame, similarity: float) -> DataFrame:
    """Links of each group; rows (grp, i, j, side, node, known, registers, shingles) come sorted by group."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        key, own, out = None, [], []

        def flush():
            if len(own) > 1:
                nodes = [r[1] for r in own]
                reg = np.frombuffer(b"".join(r[3] for r in own), np.uint16).reshape(-1, REGISTERS)
                out.extend(_confirm(nodes, np.array([r[0] for r in own]), np.array([r[2] for r in own]), [_unpack(r[4]) for r in own], reg, similarity))

        for b in batches:
            cols = [b.column(c) for c in ("grp", "i", "j", "side", "node", "known", "registers", "shingles")]
            for r in range(b.num_rows):
                now = tuple(c[r].as_py() for c in cols[:3])
                if now != key:
                    flush()
                    key, own = now, []
                own.append(tuple(c[r].as_py() for c in cols[3:]))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=kind)
                out.clear()
            hand_back()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], schema=kind)

    return rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side", "node").mapInArrow(run, "a long, b long")


def _dealt_within(part: DataFrame) -> DataFrame:
    """Each member in its own block; the group's first member, its pivot, in all of them."""
    own = part.select("node", F.col("band_key").alias("grp"), "own")
    first = part.where((F.col("node") == F.col("least")) & (F.col("blocks") > 1)).select("node", F.col("band_key").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own"), F.col("own").alias("home"))
    both = own.unionByName(first.where("own <> home").drop("home"))
    return both.select("node", "grp", F.col("own").alias("i"), F.col("own").alias("j"), F.lit(0).alias("side"), F.col("node").alias("known"))


def _dealt_across(part: DataFrame, comps: DataFrame) -> DataFrame | None:
    """Members of large groups that are still in several components, dealt as pairs of blocks; None if there are none.

    A component that fills blocks has blocks of its own, which are not compared with each
    other; small ones share blocks.
    """
    large = part.where("blocks > 1").join(comps, "node", "left").select("band_key", "node", "n", F.coalesce("component", "node").alias("known"))
    filled = lambda m, w: F.greatest(F.lit(1), F.ceil(m / BLOCK_MEMBERS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    sizes = large.groupBy("band_key", "known").agg(F.count("*").alias("m"), F.sum("n").alias("w")).withColumn("cuts", filled(F.col("m"), F.col("w")))
    few = lambda c: F.sum(F.when(F.col("cuts") == 1, F.col(c)).otherwise(0))
    open_groups = sizes.groupBy("band_key").agg(F.count("*").alias("k"), filled(few("m"), few("w")).alias("shared_cuts")).where("k > 1")
    sizes = materialise(sizes.join(open_groups, "band_key"), "open")
    if sizes.limit(1).count() == 0:
        discard(sizes)
        return None
    pure = F.col("cuts") > 1
    cuts = F.when(pure, F.col("cuts")).otherwise(F.col("shared_cuts"))
    own = large.join(sizes, ["band_key", "known"]).withColumn("slice", F.pmod(F.xxhash64("node", F.lit(2)), cuts).cast("int"))
    own = own.select("node", F.col("band_key").alias("grp"), "known", F.when(pure, F.col("known")).alias("alone"), "slice")
    own = materialise(own.withColumn("block", F.xxhash64(F.coalesce("alone", F.lit(-1)), "slice")), "cut")
    blocks = own.select("grp", "block", "alone").distinct()
    x, y = blocks.select("grp", F.col("block").alias("i"), F.col("alone").alias("ax")), blocks.select("grp", F.col("block").alias("j"), F.col("alone").alias("ay"))
    pairs = x.join(y, "grp").where("i <= j").where(~(F.col("ax").eqNullSafe(F.col("ay")) & F.col("ax").isNotNull())).select("grp", "i", "j")
    sides = pairs.select("grp", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))))).alias("s"))
    return own.join(sides.select("grp", "i", "j", "s.block", "s.side"), ["grp", "block"]).select("node", "grp", "i", "j", "side", "known")


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Words are [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased.  A text of fewer than k
    words is one shingle; null and empty texts have an empty set and are linked with
    nothing.  Rows of one doc_id count as one document.  A null doc_id is linked with
    nothing and kept, with a null component.  Further columns are ignored.
    """
    sketch = materialise(sketches(docs, k), "sketches")
    # a document's own sketch: the least set of its rows stands for them all
    live = sketch.where("set_key is not null and doc_id is not null")
    classes = materialise(live.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")), "classes")
    member = materialise(band_keys(classes), "bands")
    groups = member.groupBy("band_key").agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.min("node").alias("least")).where("c > 1")
    # bands that gave the same group are compared once
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_MEMBERS), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    once = materialise(groups.groupBy("c", "total", "sum", "least").agg(F.min("band_key").alias("band_key")).select("band_key", "least", blocks.alias("blocks")), "groups")
    part = materialise(member.join(small(once, BROADCAST_NODES), "band_key").select("node", "n", "band_key", "least", "blocks", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int").alias("own")), "dealt")
    for done in (member, once):
        discard(done)
    # full sets of the classes that are in a group: those of the rows which gave their nodes
    wanted = materialise(part.select("node").distinct().join(classes.select("node", "set_key"), "node"), "wanted").select(F.col("node").alias("doc_id"), "set_key")
    rows = live.select("doc_id", "set_key", "registers", "shingles").join(small(wanted, BROADCAST_NODES), ["doc_id", "set_key"], "left_semi")
    full = rows.groupBy(F.col("doc_id").alias("node"), "set_key").agg(F.first("registers").alias("registers"), F.first("shingles").alias("shingles")).drop("set_key")
    # sets of rows that share a doc_id are one document
    same = live.groupBy("doc_id").agg(F.min("set_key").alias("x"), F.max("set_key").alias("y")).where("x <> y").join(live.select("doc_id", "set_key").distinct(), "doc_id").join(classes, "set_key").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    links = materialise(_group_links(_dealt_within(part).join(full, "node"), similarity).unionByName(same), "pairs")
    comps = connected_components(links)
    if part.where("blocks > 1").limit(1).count() and (across := _dealt_across(part, comps)) is not None:
        more = _group_links(across.join(full, "node"), similarity)
        comps = connected_components(links.unionByName(more))
    slim = materialise(sketch.select("doc_id", "n_shingles", "set_key"), "sizes")
    for done in (sketch, part, links):
        discard(done)
    label = classes.join(comps, "node", "left").select("set_key", F.coalesce("component", "node").alias("found"))
    out = slim.join(label, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
