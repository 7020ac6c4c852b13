"""The walker against a plain recursion, and normalisation against the standard library."""

import json
import random
import re
import unicodedata

from pyspark.sql import functions as F

from rankwell.operators import filters as G
from rankwell.operators import walker as W

RECORDS = "id int, t string, path string, name string"


def grown(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.3:
        return r.choice([None, True, 3, -2.5, "", "ps_1", "ps_a_rank2", "UNMAPPED_NEEDS_REVIEW", 'a"]}[{\\', "é\u2028𝒳"])
    if kind < 0.6:
        return [grown(r, depth - 1) for _ in range(r.randrange(0, 4))]
    return {k: grown(r, depth - 1) for k in r.sample(["a", "b", "passage_id", "canonical_passage_id", "x.y", "z]", "Token"], r.randrange(0, 4))}


def plain(value, path="", name=None):
    """(path, name) of everything below value."""
    if isinstance(value, dict):
        for k, v in value.items():
            p = f"{path}.{k}" if path else k
            yield p, k
            yield from plain(v, p, k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield f"{path}[{i}]", name
            yield from plain(v, f"{path}[{i}]", name)


def plain_bad(value, path=""):
    if isinstance(value, dict):
        for k, v in value.items():
            p = f"{path}.{k}" if path else k
            if k in W.ID_KEYS:
                if not isinstance(v, str) or "_rank" in v or not v.startswith("ps_") and v != W.UNMAPPED:
                    yield p
            else:
                yield from plain_bad(v, p)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from plain_bad(v, f"{path}[{i}]")


def test_walk_against_recursion(spark):
    r = random.Random(4)
    values = {i: grown(r, 6) for i in range(150)}
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0), "p", "n") for i, v in values.items()] + [(500, None, "p", "n"), (501, "{\"a\": ", "p", "n"), (502, "", "p", "n"), (503, "7", "p", "n")]
    df = spark.createDataFrame(rows, RECORDS)
    got, bad = {}, {}
    for x in W.walk(df, "t", ["id"]).collect():
        got.setdefault(x.id, []).append((x.path, x["name"]))
    for i, v in values.items():
        assert sorted(got.get(i, []), key=repr) == sorted(plain(v), key=repr), rows[i]
    assert got[501] == got[502] == [("", None)] and 500 not in got and 503 not in got
    for x in W.bad_ids(df, "t", ["id"]).collect():
        bad.setdefault(x.id, []).append(x.path)
    for i, v in values.items():
        assert sorted(bad.get(i, [])) == sorted(plain_bad(v)), rows[i]
    assert W.walk(df.limit(0), "t", ["id"]).count() == 0


def test_walk_deep_and_wide(spark):
    deep = "[" * 60 + "1" + "]" * 60
    wide = json.dumps({"rows": [{"token": i} for i in range(5000)]})
    df = spark.createDataFrame([(1, wide, "", "")], RECORDS)
    assert W.forbidden_keys(df, "t", ["id"], ["token"]).count() == 5000
    assert [x.m for x in spark.createDataFrame([(1, deep, "", ""), (2, '{"[[[": "}}}"}', "", "")], RECORDS).select(W.depth(F.col("t")).alias("m")).collect()] == [60, 1]


def test_inert_characters_are_inert():
    """Every character that skips Python is its own compatibility form and joins with nothing that follows it there."""
    safe = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and re.match(f"[{G.INERT}]", chr(c))]
    assert len(safe) > 300
    for c in safe:
        assert unicodedata.normalize("NFKC", c) == c and unicodedata.combining(c) == 0
        assert all(unicodedata.normalize("NFKC", b + c) == b + c for b in "aeionucsAEZ|é")


def test_nfkc_of_every_character(spark):
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    rows = [(i, "x" + "".join(points[i : i + 256]) + "e\u0301", "p", "n") for i in range(0, len(points), 256)] + [(-1, None, "p", "n"), (-2, "", "p", "n"), (-3, "plain é", "p", "n")]
    got = {x.id: x.t for x in G.nfkc(spark.createDataFrame(rows, RECORDS), "t").collect()}
    assert got == {i: t if t is None else unicodedata.normalize("NFKC", t) for i, t, *_ in rows}


def test_tasks_follow_the_records(spark, monkeypatch):
    """More records make more tasks, not larger ones, and what is grouped by record needs no further shuffle."""
    monkeypatch.setattr(W, "TASK_RECORDS", 10)
    df = spark.range(400).select("id", F.format_string('{"a": [{"b": %d}, {"b": null}], "c": "x"}', "id").alias("t"))
    found = W.walk(df, "t", ["id"])
    assert found.rdd.getNumPartitions() == 40
    per = found.groupBy("path").agg(F.count_distinct("id").alias("n"), F.count("*").alias("all"))
    assert {r.path: (r.n, r.all) for r in per.collect()} == {p: (400, 400) for p in ("a", "a[0]", "a[0].b", "a[1]", "a[1].b", "c")}
