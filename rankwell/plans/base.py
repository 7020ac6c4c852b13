"""What the registered queries share: tables, the registry, and the relations that plans are tried on.

``run`` holds retrieval results: a question is a supplier's month, a strategy a line number,
a passage a part, ranked by price; a chapter is a supplier's quarter.  ``qrels`` holds
graded judgements of the pairs of large quantity.  Both grow with lineitem, whole lists
are kept.  The SQL twins state the same relations in their own words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = oracle
        return fn

    return keep


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def share(part: Column, whole: Column, none: float | None = None) -> Column:
    """part / whole as a double; none where whole is 0 or null."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(none).cast("double"))


def listed(values: Column) -> Column:
    """Sorted values of a group, joined by commas; empty for none."""
    return F.array_join(F.array_sort(F.collect_list(values.cast("string"))), ",")


def run(spark: SparkSession, d: str) -> DataFrame:
    """strategy, qid, chapter, passage, score, rank."""
    n = F.month("l_shipdate")
    rows = read(spark, d, "lineitem").where("l_shipdate is not null and l_suppkey is not null").select(
        F.col("l_linenumber").alias("strategy"), (F.col("l_suppkey") * 16 + n).alias("qid"), (F.col("l_suppkey") * 4 + F.quarter("l_shipdate") - 1).alias("chapter"),
        F.col("l_partkey").alias("passage"), F.col("l_extendedprice").alias("score"), "l_orderkey", "l_quantity", "l_shipdate",
    )
    # rows are sorted by the question first, as a strategy tells few apart
    by = Window.partitionBy("qid", "strategy").orderBy(F.desc("score"), "l_orderkey", "passage", "l_quantity", "l_shipdate")
    return rows.select("strategy", "qid", "chapter", "passage", "score", F.row_number().over(by).alias("rank"))


def qrels(spark: SparkSession, d: str) -> DataFrame:
    """qid, passage, grade of the judged pairs, each once."""
    q = F.max("l_quantity")
    rows = read(spark, d, "lineitem").where("l_quantity >= 25 and l_shipdate is not null and l_suppkey is not null")
    graded = F.when(q >= 46, 3).when(q >= 42, 2).when(q >= 38, 1).otherwise(0)
    return rows.groupBy((F.col("l_suppkey") * 16 + F.month("l_shipdate")).alias("qid"), F.col("l_partkey").alias("passage")).agg(graded.alias("grade"))


def raters(spark: SparkSession, d: str) -> DataFrame:
    """qid, item, a, b: grades of two annotators."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    shift = F.when(c % 3 == 0, 1).when(c % 11 == 0, 2).otherwise(0)
    return read(spark, d, "orders").where("o_orderkey is not null and o_custkey is not null").select(c.alias("qid"), o.alias("item"), (o % 4).cast("int").alias("a"), ((o + shift) % 4).cast("int").alias("b"))


def asks(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, question, answer: a user's turn and the assistant's that follows it."""
    t = read(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    answer = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question")).join(answer, ["conv_id", "turn"])


RUN_SQL = """run AS (SELECT l_linenumber AS strategy, l_suppkey * 16 + month(l_shipdate) AS qid, l_suppkey * 4 + quarter(l_shipdate) - 1 AS chapter, l_partkey AS passage, l_extendedprice AS score,
  row_number() OVER (PARTITION BY l_linenumber, l_suppkey, month(l_shipdate) ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_quantity, l_shipdate) AS rank
  FROM lineitem WHERE l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL)"""
QRELS_SQL = """qrels AS (SELECT qid, passage, CASE WHEN q >= 46 THEN 3 WHEN q >= 42 THEN 2 WHEN q >= 38 THEN 1 ELSE 0 END AS grade FROM (
  SELECT l_suppkey * 16 + month(l_shipdate) AS qid, l_partkey AS passage, max(l_quantity) AS q FROM lineitem WHERE l_quantity >= 25 AND l_shipdate IS NOT NULL AND l_suppkey IS NOT NULL GROUP BY ALL) j)"""
BASE_SQL = f"{RUN_SQL}, {QRELS_SQL}"
GOLD_SQL = "gold AS (SELECT qid, count(*) AS n_rel FROM qrels WHERE grade >= 1 GROUP BY qid)"
RATERS_SQL = """raters AS (SELECT o_custkey AS qid, o_orderkey AS item, o_orderkey % 4 AS a, (o_orderkey + CASE WHEN o_custkey % 3 = 0 THEN 1 WHEN o_custkey % 11 = 0 THEN 2 ELSE 0 END) % 4 AS b
  FROM orders WHERE o_orderkey IS NOT NULL AND o_custkey IS NOT NULL)"""
ASKS_SQL = """asks AS (SELECT u.conv_id, u.turn, coalesce(u.text, '') AS question, coalesce(a.text, '') AS answer FROM conversations u, conversations a
  WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""
#: Recall@3 and reciprocal rank of each list, found by correlated lists instead of joins.
METRIC_SQL = f"""{BASE_SQL}, {GOLD_SQL}, lists AS (SELECT strategy, qid, list(passage ORDER BY rank) AS seen FROM run GROUP BY strategy, qid),
firsts AS (SELECT strategy, qid, list_filter(seen, lambda x, i: list_position(seen, x) = i)[:3] AS top FROM lists),
good AS (SELECT qid, list(passage) AS ids FROM qrels WHERE grade >= 1 GROUP BY qid),
metric AS (SELECT strategy, f.qid, CASE WHEN ids IS NULL THEN NULL ELSE len(list_filter(top, lambda x: list_contains(ids, x)))::DOUBLE / len(ids) END AS recall,
  coalesce(1.0::DOUBLE / list_min(list_filter([CASE WHEN list_contains(ids, top[i]) THEN i END for i in range(1, len(top) + 1)], lambda x: x IS NOT NULL)), 0.0::DOUBLE) AS rr FROM firsts f LEFT JOIN good USING (qid))"""
