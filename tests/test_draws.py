"""Draws against Python's random module, on given lists and on the registered queries' tables."""

import hashlib
import random
from collections import defaultdict

import pytest

from rankwell.operators import agreement, draws
from rankwell.plans import base, pooling, registry, seeded

SF = "/root/testdata/sf0.001"


def bootstrap(values, seed=42, resamples=1000):
    rng = random.Random(seed)
    means = sorted(sum(rng.choice(values) for _ in values) / len(values) for _ in range(resamples))
    return round(means[int(0.025 * resamples)], 4), round(means[int(0.975 * resamples)], 4)


@pytest.mark.parametrize("seed", [0, 1, 42, 2**32 - 1, 2**32, 10**30])
def test_stream_is_pythons(seed):
    rng, own = random.Random(seed), draws.Twister(seed)
    for n, count in ((7, 5), (8, 1000), (1, 3), (2**31, 70_000), (1000, 1), (3, 0), (2**32 - 1, 10)):
        assert own.below(n, count).tolist() == [rng._randbelow(n) for _ in range(count)]


def test_interval_of_published_differences(spark):
    """Seven questions of which the window won two: the interval as published is [0, 0.5714]."""
    values = [1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)] + [(99, None, "x")], "i long, v double, low string")
    got = draws.interval(df, "i", "v", index="i").first()
    assert (got.low, got.high) == bootstrap(values) == (0.0, 0.5714)
    d = df.where("v is not null").agg(agreement.cohens_d(df.v).alias("d")).first().d
    assert round(d, 4) == 0.5855  # the report prints 0.5976, which no sample of these seven differences gives


@pytest.mark.parametrize("n", [1, 2, 64, 1000, 250_000])
def test_interval_of_many(spark, n):
    r = random.Random(n)
    values = [float(r.randrange(-3, 4)) for _ in range(n)]
    resamples = 1000 if n < 2000 else 20
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(3)
    got = draws.interval(df, "i", "v", resamples=resamples, index="i").first()
    assert (got.low, got.high) == bootstrap(values, resamples=resamples)
    none = draws.interval(df.limit(0), "i", "v").first()
    assert (none.low, none.high) == (0.0, 0.0)


def seed_of(text):
    return int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)


def lists(df):
    out = defaultdict(set)
    for r in df.collect():
        out[r.qid].add(r.passage)
    return {q: sorted(p) for q, p in out.items()}


def test_queries_draw_as_python_does(spark):
    pool = pooling.pooled(spark, SF).collect()
    outside = lists(pooling.P.outside(pooling.evidence(spark, SF), pooling.pooled(spark, SF)))
    want = {(q, x) for q, p in outside.items() for x in random.Random(seed_of(f"{q}:{seeded.PROTOCOL}")).sample(p, -(-len(p) // 10))}
    assert {tuple(r) for r in registry.QUERIES["pol04_seeded_sample"](spark, SF).collect()} == want and want

    qrels = base.qrels(spark, SF).collect()
    package, negatives = defaultdict(set), defaultdict(set)
    for r in qrels:
        (package if r.grade >= 2 else negatives)[r.qid].add(r.passage)
    for q, p in negatives.items():
        package[q] |= set(random.Random(seed_of(f"neg_control:{q}")).sample(sorted(p), min(len(p), max(2, min(5, len(p))))))
    want = set()
    for q, p in package.items():
        order = sorted(p)
        random.Random(seed_of(f"blind_order:{q}")).shuffle(order)
        want |= {(q, i, x) for i, x in enumerate(order, 1)}
    assert {(r.qid, r.position, r.passage) for r in registry.QUERIES["pol08_seeded_package"](spark, SF).collect()} == want

    risky, calm, every = set(), defaultdict(list), defaultdict(list)
    for r in pool:
        every[r.qid].append(r.passage)
        risky.add((r.qid, r.passage, True)) if r.n_strategies > 1 else calm[r.qid].append(r.passage)
    drawn = {(q, x, False) for q, p in calm.items() for x in random.Random(seed_of(f"{q}:random_negative_control_seed")).sample(sorted(p), min(len(p), max(1, round(0.2 * len(every[q])))))}
    assert {(r.qid, r.passage, r.risky) for r in registry.QUERIES["ann01_seeded_queues"](spark, SF).collect()} == risky | drawn

    want = set()
    for q, p in every.items():
        order = sorted(p)
        random.Random(seed_of(f"{q}:annotator_a")).shuffle(order)
        want |= {(q, i, x) for i, x in enumerate(order, 1)}
    assert {(r.qid, r.priority_rank, r.passage) for r in registry.QUERIES["ann02_seeded_order"](spark, SF).collect()} == want


def test_draws_of_nothing(spark):
    none = spark.createDataFrame([], "qid long, passage long")
    g = draws.gathered(none, ["qid"], "passage")
    assert draws.shuffle(g, ["qid"], "passage", draws.seed_of(g.qid)).count() == 0 and draws.sample(g, ["qid"], "passage", draws.seed_of(g.qid), g.n).count() == 0
