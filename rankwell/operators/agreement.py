"""Agreement of two raters and paired comparison of strategies.

pairs is (a, b, ...): the two grades of each item, both present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRADES = 4


def contingency(pairs: DataFrame) -> DataFrame:
    """a, b, n: how often each pair of grades was given."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def _margins(pairs: DataFrame) -> DataFrame:
    """One row: cells (array of a, b, n), total.  There are as many cells as pairs of grades."""
    cells = F.collect_list(F.struct("a", "b", F.col("n").cast("double").alias("n")))
    return contingency(pairs).agg(cells.alias("cells"), F.sum("n").cast("double").alias("total"))


def _sum(cells: Column, of) -> Column:
    return F.aggregate(cells, F.lit(0.0), lambda s, c: s + of(c))


def _both(cells: Column, of) -> Column:
    """Sum over all pairs of cells: a from the first, b from the second."""
    return F.aggregate(cells, F.lit(0.0), lambda s, x: s + F.aggregate(cells, F.lit(0.0), lambda t, y: t + x["n"] * y["n"] * of(x["a"], y["b"])))


def kappa(pairs: DataFrame, sentinels: bool = False) -> DataFrame:
    """kappa, status of categories: 1 where chance alone explains all.

    With sentinels, an empty sample and one of a single class have no value but a status;
    without, an empty sample has 0.
    """
    c, n = F.col("cells"), F.col("total")
    po = _sum(c, lambda x: F.when(x["a"] == x["b"], x["n"]).otherwise(0.0)) / n
    pe = _both(c, lambda a, b: (a == b).cast("double")) / (n * n)
    value = F.when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe))
    classes = F.size(F.array_distinct(F.concat(F.transform(c, lambda x: x["a"]), F.transform(c, lambda x: x["b"]))))
    empty = F.size(c) == 0
    status = F.when(empty, "EMPTY_SAMPLE").when(classes == 1, "SINGLE_CLASS").otherwise("COMPUTED")
    if not sentinels:
        return _margins(pairs).select(F.when(empty, 0.0).otherwise(value).alias("kappa"))
    return _margins(pairs).select(F.when(status == "COMPUTED", value).alias("kappa"), status.alias("status"))


def weighted_kappa(pairs: DataFrame, power: int = 1, grades: int = GRADES) -> DataFrame:
    """kappa with disagreements weighted by their distance (power 1) or its square (2); 1 where none is expected, 0 for no pairs."""
    c, n = F.col("cells"), F.col("total")
    weight = lambda a, b: F.pow(F.abs(a - b).cast("double") / (grades - 1), F.lit(float(power)))
    seen = _sum(c, lambda x: weight(x["a"], x["b"]) * x["n"])
    expected = _both(c, weight) / n
    return _margins(pairs).select(F.when(F.size(c) == 0, 0.0).when(expected == 0, 1.0).otherwise(1 - seen / expected).alias("kappa"))


def report(pairs: DataFrame) -> DataFrame:
    """One row: agreement counts and rates, distances, and the 2 x 2 table of relevant against not."""
    a, b = F.col("a"), F.col("b")
    gap, n = F.abs(a - b), F.count("*")
    ra, rb = a >= 1, b >= 1
    return pairs.agg(
        n.alias("pairs"), F.count_if(gap == 0).alias("exact"), F.round(F.count_if(gap == 0) / n, 4).alias("exact_rate"), F.count_if(gap != 0).alias("disagreements"), F.count_if(gap == 1).alias("adjacent"), F.count_if(gap >= 2).alias("severe"),
        F.count_if(gap == 2).alias("distance_2"), F.count_if(gap == 3).alias("distance_3"), F.round(F.count_if(ra == rb) / n, 4).alias("binary_rate"),
        F.count_if(~ra & ~rb).alias("neither"), F.count_if(~ra & rb).alias("only_b"), F.count_if(ra & ~rb).alias("only_a"), F.count_if(ra & rb).alias("both"),
    )


def confusion(pairs: DataFrame, grades: int = GRADES) -> DataFrame:
    """a, b, n, distance for every pair of grades, given or not."""
    g = pairs.sparkSession.range(grades)
    all_pairs = g.select(F.col("id").cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(grades - 1))).alias("b"))
    return all_pairs.join(contingency(pairs), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.abs(F.col("a") - F.col("b")).alias("distance"))


def disagreements(pairs: DataFrame) -> DataFrame:
    gap = F.abs(F.col("a") - F.col("b"))
    return pairs.where(gap > 0).withColumn("gap", gap).withColumn("severity", F.when(gap == 1, "ADJACENT").otherwise("SEVERE"))


def calibration(graded: DataFrame, least: int = 30, recall: float = 0.95, error: float = 0.05) -> DataFrame:
    """One row: how well silver grades stand for human ones.  graded is (human, silver), a missing silver grade counts as 0."""
    h, s = F.col("human"), F.coalesce("silver", F.lit(0))
    done = graded.where("human is not null").agg(F.count("*").alias("n"), F.count_if(h == s).alias("same"), F.count_if(h >= 1).alias("relevant"), F.count_if((h >= 1) & (s == 0)).alias("missed"))
    fnr = F.col("missed") / F.greatest(F.lit(1), F.col("relevant"))
    passed = ((1 - fnr) >= recall) & (fnr <= error)
    status = F.when(F.col("n") == 0, "CALIBRATION_NOT_EXECUTED").when(F.col("n") < least, "NOT_COMPUTABLE_INSUFFICIENT_SAMPLE").when(passed, "CALIBRATION_PASSED").otherwise("CALIBRATION_FAILED")
    enough = F.col("n") >= least
    return done.select(status.alias("status"), "n", *[F.round(F.when(enough, v), 4).alias(c) for v, c in ((F.col("same") / F.col("n"), "agreement"), (fnr, "fnr"), (1 - fnr, "relevant_recall"))])


def deltas(scores: DataFrame, pairs: list[tuple]) -> DataFrame:
    """sb, sa, metric, qid, a, b, delta of each pair (b, a) of strategies and each question that either answered.

    scores is (strategy, metric, qid, score): the few strategies of a question meet in one
    row, so no table is joined with itself.  delta is null where a score is missing.
    """
    met = scores.groupBy("metric", "qid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("strategy").cast("string").alias("k"), "score"))).alias("m"))
    which = F.explode(F.array(*[F.struct(F.lit(str(b)).alias("sb"), F.lit(str(a)).alias("sa")) for b, a in pairs])).alias("p")
    j = met.select("metric", "qid", "m", which).where(F.map_contains_key("m", F.col("p.sb")) | F.map_contains_key("m", F.col("p.sa")))
    b, a = F.try_element_at("m", F.col("p.sb")), F.try_element_at("m", F.col("p.sa"))
    return j.select(F.col("p.sb").alias("sb"), F.col("p.sa").alias("sa"), "metric", "qid", a.alias("a"), b.alias("b"), F.round(b - a, 4).alias("delta"))


def outcome(delta: Column) -> Column:
    return F.when(delta.isNull(), "MISSING").when(delta > 0, "BENEFITED").when(delta < 0, "HARMED").otherwise("TIED")


def paired(rows: DataFrame, by: list[str]) -> DataFrame:
    """wins, ties, losses, missing, n and mean, median and standard deviation of deltas."""
    d = F.col("delta")
    std = F.when(F.count(d) == 1, 0.0).otherwise(F.stddev_samp(d))
    return rows.groupBy(*by).agg(F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.count_if(d.isNull()).alias("missing"), F.count("*").alias("n"),
        F.round(F.avg(d), 4).alias("mean_delta"), F.round(F.median(d), 4).alias("median_delta"), F.round(std, 4).alias("std_delta"))


def cohens_d(delta: Column) -> Column:
    """Of paired differences; 0 without spread."""
    sd = F.stddev_samp(delta)
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise(F.avg(delta) / sd)
