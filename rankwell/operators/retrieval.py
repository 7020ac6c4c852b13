"""Exact cosine retrieval, rescoring, window and auto-merge strategies.

Queries are a stated set; every item is scored against all of them.  Queries are taken in
blocks of bounded size, items stay where they are, and each Arrow batch of items keeps only
its own best k (or its sums) for each query before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.sources.folders import scratch

#: Queries of a block on average: what the driver and a task hold at a time.
QUERY_BLOCK = 4096
#: Items that are scored at a time.
ITEM_ROWS = 1024


def stated(items: DataFrame, every: int = 20) -> DataFrame:
    """The query set of a search over items: every row whose id is divisible by every."""
    return items.where(F.pmod(F.col("id"), F.lit(every)) == 0)


def _rank(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null")


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of rows of q and v, 0 where either has no length; products are summed in index order, as a fold would."""
    qn, n = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
    s = np.zeros((len(q), len(v)))
    for d in range(v.shape[1]):
        s += q[:, d : d + 1] * v[None, :, d]
    scale = qn[:, None] * n[None, :]
    return np.where(scale == 0, 0.0, s / np.where(scale == 0, 1, scale))


def _units(v: np.ndarray, dtype: type) -> np.ndarray | None:
    """Rows at unit length, 0 where there is none; None where squares may over- or underflow."""
    n = np.sqrt((v * v).sum(1, keepdims=True))
    if ((n > 0) & ((n < 1e-140) | (n > 1e140))).any() or not np.isfinite(n).all():
        return None
    return np.where(n > 0, v / np.where(n > 0, n, 1), 0).astype(dtype)


class _Batch:
    """Items of a batch against a block of queries: near scores by one matrix product, exact ones of chosen pairs.

    near differs from the exact scores by less than slack; the score with an item of the
    query's own id is -inf if skip_self.
    """

    def __init__(self, ids, q, unit, own, v, skip_self):
        self.q, self.own, self.v = q, own, v
        other = _units(v, unit.dtype.type) if unit is not None else None
        self.near = _scores(q, v) if other is None else unit @ other.T
        # entries, products and sums each round by half an eps of at most 1
        self.slack = 0.0 if other is None else 2 * float(np.finfo(unit.dtype).eps) * (v.shape[1] + 16)
        if skip_self:
            at = np.flatnonzero(np.isin(own, ids))
            r, c = np.nonzero(ids[:, None] == own[None, at])
            self.near[r, at[c]] = -np.inf

    def exact(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Scores of the pairs (r, c) as _scores gives them."""
        out = np.zeros(len(r))
        qn, n = np.sqrt((self.q * self.q).sum(1)), np.sqrt((self.v * self.v).sum(1))
        for lo in range(0, len(r), 1 << 18):
            i, k = r[lo : lo + (1 << 18)], c[lo : lo + (1 << 18)]
            s = np.zeros(len(i))
            for d in range(self.v.shape[1]):
                s += self.q[i, d] * self.v[k, d]
            scale = qn[i] * n[k]
            out[lo : lo + (1 << 18)] = np.where(scale == 0, 0.0, s / np.where(scale == 0, 1, scale))
        return out


def by_blocks(queries: DataFrame, items: DataFrame, add: Callable, rows_of: Callable, schema: str, skip_self: bool = True, thin: Callable | None = None, dtype: type = np.float64) -> DataFrame:
    """Rows of what each task has kept of its items for each block of queries.

    add(kept, batch) takes a _Batch of items into what is kept (None at first), and
    rows_of(query ids, kept) is called once a task, so that what is shuffled follows the number
    of tasks and not of batches.  skip_self: a query's score with the item of its own id is -inf.
    thin(item ids, vectors) may name the items of a batch that are worth looking at, and dtype
    is the precision of near scores.  A block is collected
    by itself; of several blocks each one's rows are written to the shared folder before
    the next, so neither the driver nor the plan grows with the query set.
    """
    spark, queries, items = items.sparkSession, _typed(queries), _typed(items)
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    names = [x.split()[0] for x in schema.split(",")]
    out = None
    for b in range(n_blocks):
        part = queries if n_blocks == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b)
        rows = part.orderBy("id").collect()  # about QUERY_BLOCK rows
        if not rows:
            continue
        ids, q = np.array([r["id"] for r in rows]), np.array([r["vector"] for r in rows], float)

        def score(batches, ids=ids, q=q):
            kept, unit = None, _units(q, dtype)
            for whole in batches:
                for lo in range(0, whole.num_rows, ITEM_ROWS):
                    batch = whole.slice(lo, ITEM_ROWS)
                    own = np.asarray(batch.column("id"))
                    v = np.asarray(batch.column("vector").flatten()).reshape(len(own), -1)
                    if thin is not None:
                        at = thin(own, v)
                        own, v = own[at], v[at]
                    kept = add(kept, _Batch(ids, q, unit, own, v, skip_self))
            if kept is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows_of(ids, kept)], names=names)

        found = items.mapInArrow(score, schema)
        if n_blocks > 1:
            path = scratch(spark, "block")
            found.write.parquet(path)
            found = spark.read.schema(schema).parquet(path)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def _firsts(order: tuple, group: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group in an order (keys as np.lexsort takes them, below the group)."""
    at = np.lexsort((*order, group))
    g = group[at]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    return at[np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)])) < k]


def top_k(queries: DataFrame, items: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
    """query_id, item_id, score, rank: the k items of highest cosine, ties by the smaller id.

    queries and items are (id, vector); vectors without length score 0; k < 1 gives no rows.
    A product in single precision shows which pairs can be among the k; their scores are then
    summed exactly, in index order as a fold would, and decide.
    """

    def distinct(own, v):
        # of equal vectors only the k + 1 smallest ids can be among anybody's k others
        if v.shape[1] == 0 or len(np.unique(own)) < len(own):
            return np.arange(len(own))
        same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * v.itemsize))).ravel(), return_inverse=True)[1].ravel()
        return np.sort(_firsts((own,), same, k + 1))

    def taken(kept):
        """What is kept with the waiting candidates among it, at most k of each query, and each query's k-th score."""
        held, least, waiting, _ = kept
        r, own, s = (np.concatenate(x) for x in zip(held, *waiting, strict=True))
        at = _firsts((own, -s), r, k)
        r, own, s = r[at], own[at], s[at]
        full = np.flatnonzero(np.bincount(r, minlength=len(least)) == k)
        worst = np.full(len(least), np.inf)
        np.minimum.at(worst, r, s)
        least = np.full(len(least), -np.inf)
        least[full] = worst[full]
        return (r, own, s), least, [], 0

    def best(kept, batch):
        s, n = batch.near, len(batch.q)
        held, least, waiting, n_waiting = kept if kept is not None else ((np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)), np.full(n, -np.inf), [], 0)
        if not s.size:
            return held, least, waiting, n_waiting
        bar, open_ = least, np.isinf(least).any()
        if open_ and s.shape[1] > k:  # not all have k yet: the batch's own k-th is a bar as well
            bar = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        low = (bar - batch.slack).astype(s.dtype)
        # few queries find anything in a batch; exact scores may be no numbers, near ones are
        some = np.flatnonzero((np.fmax.reduce(s, 1) if batch.slack == 0 else s.max(1)) >= low)
        near = s[some] if len(some) < n else s
        at = np.flatnonzero((near >= low[some, None]) & (near > -np.inf))
        r, c = some[at // s.shape[1]], at % s.shape[1]
        exact = batch.exact(r, c)
        there = np.isfinite(exact)
        waiting = [*waiting, (r[there], batch.own[c[there]], exact[there])]
        n_waiting += int(there.sum())
        # candidates are sorted in once they are many: until then the bar is a little low, which only lets more in
        return taken((held, least, waiting, n_waiting)) if open_ or n_waiting > n * k // 4 else (held, least, waiting, n_waiting)

    def rows(ids, kept):
        r, own, s = taken(kept)[0]
        return ids[r], own, s

    schema = "query_id long, item_id long, score double"
    if k < 1:
        return items.sparkSession.createDataFrame([], schema + ", rank int")
    return _rank(by_blocks(queries, items, best, rows, schema, skip_self, distinct, np.float32), k)


def score_sums(queries: DataFrame, items: DataFrame, above: float = 0.0) -> DataFrame:
    """query_id, n, total, n_above: each query's scores with all items but itself, summed up."""

    def sums(kept, batch):
        s = batch.near
        r, c = np.nonzero(np.abs(s - above) <= batch.slack)
        s[r, c] = batch.exact(r, c)
        live = np.isfinite(s)
        new = live.sum(1), np.where(live, s, 0.0).sum(1), (live & (s > above)).sum(1)
        return new if kept is None else tuple(a + b for a, b in zip(kept, new, strict=True))

    parts = by_blocks(queries, items, sums, lambda ids, kept: (ids, *kept), "query_id long, n long, total double, n_above long")
    return parts.groupBy("query_id").agg(*[F.sum(c).alias(c) for c in ("n", "total", "n_above")])


def clamped(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def rescore(run: DataFrame, scores: DataFrame, keep: int) -> DataFrame:
    """Second stage: candidates by new score, ties by their old rank; post_rank is null for dropped ones."""
    order = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "rank")
    return run.join(scores, ["query_id", "item_id"]).withColumn("post", F.row_number().over(order)).withColumn("post_rank", F.when(F.col("post") <= keep, F.col("post"))).drop("post")


def window_dedup(run: DataFrame, w: int, k: int) -> DataFrame:
    """Greedy choice among ranked sentences: skips those inside a window already taken, stops at k.

    run: query_id, page, sentence, rank.  At most 3k candidates of a query are looked at.
    """
    c = run.where(F.col("rank") <= 3 * k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "page", "sentence"))).alias("c"))
    start = F.expr("cast(array() as array<struct<rank:int,page:string,sentence:int>>)")
    near = lambda acc, x: F.exists(acc, lambda y: (y["page"] == x["page"]) & (F.abs(y["sentence"] - x["sentence"]) <= w))
    take = F.aggregate("c", start, lambda acc, x: F.when((F.size(acc) >= k) | near(acc, x), acc).otherwise(F.concat(acc, F.array(F.struct(x["rank"].cast("int").alias("rank"), x["page"].alias("page"), x["sentence"].cast("int").alias("sentence"))))))
    return c.select("query_id", F.posexplode(take).alias("i", "x")).select("query_id", (F.col("i") + 1).alias("rank"), "x.page", "x.sentence", F.col("x.rank").alias("candidate_rank"))


def auto_merge(run: DataFrame, tree: DataFrame, threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """Replaces retrieved children by their parent where enough of them were found; score is their mean.

    run: query_id, node_id, score.  tree: node_id, parent_id.  One level of the tree.
    """
    size = tree.where("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("children"))
    r = run.join(tree.select("node_id", "parent_id"), "node_id", "left")
    found = r.where("parent_id is not null").groupBy("query_id", "parent_id").agg(F.count("*").alias("got"), F.avg("score").alias("mean")).join(size, "parent_id")
    share = F.col("got") / F.col("children")
    up = found.where(share > threshold if strict else share >= threshold).select("query_id", "parent_id", "mean")
    stay = r.join(up, ["query_id", "parent_id"], "left_anti").select("query_id", "node_id", "score")
    known = stay.select("query_id", "node_id")
    return stay.unionByName(up.select("query_id", F.col("parent_id").alias("node_id"), F.col("mean").alias("score")).join(known, ["query_id", "node_id"], "left_anti"))
