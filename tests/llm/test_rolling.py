"""Rolling medians against plain Python."""

import datetime
import math
import random
from collections import defaultdict

import pytest

from rankwell.llm import rolling

CLICKS = "click_id long, ts timestamp_ntz, kind string, value double, n long, t string"
START = datetime.datetime(2024, 3, 31)


def doubled(values):
    v = sorted(values)
    return v[(len(v) - 1) // 2] + v[len(v) // 2]


def plain(rows, minutes=360):
    """click_id -> (kind, n, median2, mad4, far) in plain Python."""
    one = {}
    for i, ts, kind, value, *_ in rows:
        if ts is not None:
            cents = None if value is None or math.isnan(value) or abs(value) > 1e15 else math.floor(100 * value + 0.5)
            key = (ts, kind is not None, kind or "", cents is not None, cents or 0)
            if i not in one or key < one[i][0]:
                one[i] = (key, ts, kind, cents)
    series = defaultdict(list)
    for _, ts, kind, cents in one.values():
        series[kind].append((ts, cents))
    out = {}
    for i, (_, ts, kind, cents) in one.items():
        w = [c for t, c in series[kind] if c is not None and ts - datetime.timedelta(minutes=minutes) <= t <= ts]
        m = mad = far = None
        if len(w) >= 5:
            m = doubled(w)
            mad = doubled(abs(2 * c - m) for c in w)
            far = None if cents is None else 2 * abs(2 * cents - m) > 5 * mad
        out[i] = (kind, len(w), m, mad, far)
    return out


def clicks(n, seed, hours=40):
    """Ties of time and value, nulls, repeated and differing rows of an id, times at exactly the window's edge."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        minute = r.randrange(hours * 60) if r.random() < 0.9 else 600 + 360 * r.randrange(3)
        ts = None if r.random() < 0.02 else START + datetime.timedelta(minutes=minute, microseconds=r.choice([0, 0, 1, 999_999]))
        value = None if r.random() < 0.1 else r.choice([r.gauss(0, 50), r.randrange(5) / 2, 1e6, -0.005, 0.005])
        rows.append((i, ts, r.choice(["a", "a", "a", "b", None]), value, 3, "x"))
    return rows + r.sample(rows, n // 10) + [(0, START, "b", 9.0, 3, "x"), (None, START, "b", 1.0, 3, "x"), (n, START, "b", float("nan"), 3, "x"), (n + 1, START, "b", 1e18, 3, "x")]


@pytest.mark.parametrize("block_rows", [2, 20, 10**6])
def test_rolling_against_plain(spark, block_rows):
    rows = clicks(700, block_rows)
    got = {r.click_id: tuple(r)[1:] for r in rolling.flag_clicks(spark.createDataFrame(rows, CLICKS), block_rows=block_rows).collect()}
    assert got == plain(rows)


def test_rolling_hot_time(spark):
    """A time that most rows share, in a stretch that is cut into parts; few and many equal values."""
    rows = [(i, START, "a", float(i % 7), 0, "") for i in range(600)] + [(1000 + i, START + datetime.timedelta(minutes=i), "a", 2.0, 0, "") for i in range(400)]
    got = {r.click_id: tuple(r)[1:] for r in rolling.flag_clicks(spark.createDataFrame(rows, CLICKS), block_rows=10).collect()}
    assert got == plain(rows)


def test_rolling_zone_and_empty(spark):
    """The clock alone counts, also across a change to summer time; empty tables give no rows."""
    rows = [(i, START + datetime.timedelta(minutes=20 * i), "a", float(i * i % 11), 0, "") for i in range(40)]
    df = spark.createDataFrame(rows, CLICKS)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = {r.click_id: tuple(r)[1:] for r in rolling.flag_clicks(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == plain(rows)
    assert rolling.flag_clicks(df.limit(0)).count() == 0
