"""Prefix trie of conversations, with subtree sums by heavy-path decomposition.

A node is a distinct sequence of turns; its key is a digest of them, made of prefix sums
over digests of (place, role, text).  Each node's heavy child is the one that most
conversations pass through; heavy edges make up paths, and whoever walks up to the root
changes path at most log2(conversations) times.  Sums over subtrees are suffix sums along
the paths, deepest level of paths first; the total of a path whose top is a light child
is added to the top's parent before that one's path is summed.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm.common import bound_batches, discard, hand_back, materialise

#: Key of the root.
ROOT = "root"
#: Conversations share the opening of the smallest conversation of their family of so many ids.
FAMILY = 20
#: Ids of one family bucket that are joined to one text before they are hashed.
PIECE = 1000
#: A digest of a turn is cut into parts of 8 hex digits; sums of them, modulo 2^32, do not overflow a long.
PARTS = 8
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _places(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, sha, words) with pos from 1: turns by number, null first, then by role and text."""
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sha = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    return own.select("conv_id", F.row_number().over(by).alias("pos"), sha.alias("sha"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def _opening(conv: F.Column) -> F.Column:
    return F.crc32(conv.cast("string").cast("binary")) % 4


def rebuilt(placed: DataFrame) -> DataFrame:
    """(conv_id, d, sha, words) of placed turns: each conversation with its opening replaced by that of its family.

    The first h turns come from conversation c - c % 20, as far as it has so many; then follow
    the own turns after the first h; h is crc32 of the decimal id modulo 4.  d counts from 1.
    """
    convs = placed.select("conv_id").distinct()
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") <= 3)).withColumnRenamed("conv_id", "head")
    shared = convs.join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("head")).where(F.col("pos") <= _opening(F.col("conv_id")))
    own = placed.where(F.col("pos") > _opening(F.col("conv_id")))
    both = shared.select("conv_id", "pos", "sha", "words").unionByName(own)
    return both.withColumn("d", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos"))).drop("pos")


def _keyed(turns: DataFrame) -> DataFrame:
    """(conv_id, d, key, parent, last, words): the node of each prefix and its parent; last marks a whole conversation."""
    by = Window.partitionBy("conv_id").orderBy("d")
    own = F.sha2(F.concat(F.col("d").cast("string"), F.lit(":"), "sha").cast("binary"), 256)
    parts = [F.conv(F.substring(own, 8 * i + 1, 8), 16, 10).cast("long") for i in range(PARTS)]
    sums = [F.sum(f"p{i}").over(by) % (1 << 32) for i in range(PARTS)]
    cut = turns.select("conv_id", "d", "words", *[p.alias(f"p{i}") for i, p in enumerate(parts)])
    key = F.sha2(F.concat_ws(",", F.col("d").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(PARTS)]).cast("binary"), 256)
    keyed = cut.select("conv_id", "d", "words", *[s.alias(f"s{i}") for i, s in enumerate(sums)]).select("conv_id", "d", "words", key.alias("key"))
    return keyed.select("conv_id", "d", "key", F.coalesce(F.lag("key").over(by), F.lit(ROOT)).alias("parent"), F.lead("key").over(by).isNull().alias("last"), "words")


def _ends(whole: DataFrame) -> DataFrame:
    """(key, ends_sha256): digest of the ascending, comma-joined ids of the conversations that end at a node.

    Ids are joined to texts by ranges of PIECE ids first; a node's texts then pass one task as a
    stream, in order, as its digest is sequential.
    """
    span = F.expr(f"conv_id div {PIECE}")
    pieces = whole.groupBy("key", span.alias("at")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_set("conv_id")), lambda x: x.cast("string"))).alias("ids"))
    bound_batches(whole.sparkSession)

    def run(batches):
        key, sha = None, None
        for b in batches:
            done: list[tuple[str, str]] = []
            for k, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k != key:
                    if sha is not None:
                        done.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], names=["key", "ends_sha256"])
            hand_back()
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([sha.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "at").select("key", "ids").mapInArrow(run, "key string, ends_sha256 string")


def _with_paths(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with path (key of the path's top) and level (light edges above the path)."""
    heavy = nodes.where("parent is not null").groupBy("parent").agg(F.max(F.struct("n_convs", "key")).alias("m")).select(F.col("m.key").alias("key"), F.lit(True).alias("heavy"))
    light = nodes.where("depth > 0").join(heavy, "key", "left").select("key", F.col("conv_id").alias("smallest"), F.col("heavy").isNull().alias("light"))
    # a node's path is read off any conversation through it: its last light prefix, and how many there are
    by = Window.partitionBy("conv_id").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = members.select("conv_id", "d", "key").join(light, "key")
    walked = walked.select("conv_id", "smallest", "key", F.coalesce(F.last(F.when(F.col("light"), F.col("key")), ignorenulls=True).over(by), F.lit(ROOT)).alias("path"), F.sum(F.col("light").cast("long")).over(by).alias("level"))
    walked = walked.where("conv_id = smallest").select("key", "path", "level")
    top = nodes.where("depth = 0").select("key", F.lit(ROOT).alias("path"), F.lit(0).cast("long").alias("level"))
    return nodes.join(walked.unionByName(top), "key")


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """nodes (key, parent, depth, path, level and the columns in sums) with each of sums summed over its subtree.

    Levels are summed from the deepest up, each by suffix sums along its paths; there are at most
    1 + log2(conversations) of them.
    """
    deepest = nodes.agg(F.max("level")).first()[0]
    if deepest is None:
        return nodes.select("key", *sums)
    by = Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done, under = None, None
    for level in range(deepest, -1, -1):
        now = nodes.where(F.col("level") == level).select("key", "parent", "depth", "path", *sums)
        if under is not None:
            hung = under.groupBy(F.col("parent").alias("key")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
            now = now.join(hung, "key", "left").select("key", "parent", "depth", "path", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums])
        now = materialise(now.select("key", "parent", "path", *[F.sum(c).over(by).alias(c) for c in sums]), f"level{level}")
        under = now.where("key = path")
        part = now.select("key", *sums)
        done = part if done is None else done.unionByName(part)
    return done


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, rows with a null conv_id are left out, turns of equal number go by
    role and text, repeated rows are turns of their own, other columns are left out.  Without
    conversations there is no root.  A conversation is ordered and summed by one task, as a stream.
    """
    placed = materialise(_places(conversations), "turns")
    members = materialise(_keyed(rebuilt(placed)), "members")
    convs = placed.select("conv_id").distinct()
    empty = convs.join(members.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(ROOT).alias("key"))
    inner = members.groupBy("key").agg(F.first("parent").alias("parent"), F.first("d").cast("long").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "conv_id", "n_convs")
    nodes = materialise(inner.unionByName(root), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    ends = _ends(members.where("last").select("conv_id", "key").unionByName(empty))
    full = _with_paths(members, nodes).join(children, "key", "left").join(ends, "key", "left")
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")
    full = materialise(full.withColumns({"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "trie")
    discard(placed)
    discard(members)
    sums = subtree_sums(full, ["n_leaves", "saved_tokens"])
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = full.drop("n_leaves", "saved_tokens").join(sums, "key").join(above, "parent", "left")
    n_children, digest = F.coalesce("n_children", F.lit(0)).cast("long"), F.coalesce("ends_sha256", F.lit(NO_ENDS))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"), "n_leaves", "saved_tokens", digest.alias("ends_sha256"))

