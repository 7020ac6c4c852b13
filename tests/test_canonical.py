"""Canonical JSON against the standard library."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from rankwell.operators import canonical

KIND = "id int, r struct<z:string,a:struct<n:bigint,f:double,ok:boolean>,l:array<array<double>>,m:map<string,array<string>>,s:array<struct<y:int,x:string>>>"


def dumped(v):
    return json.dumps(v, sort_keys=True, ensure_ascii=True, separators=(",", ":"))


def test_nested_rows(spark):
    r = random.Random(7)
    word = lambda: r.choice([None, "", "plain", 'q"\\/', "é 𝒳\U0010ffff", "\x00\x1f\x7f\x80\n\r\t\b\f", "a" * 50, "日本"])
    num = lambda: r.choice([None, 0.0, -0.0, 1.0, 0.1, 1e16, 1e15, 123456789.125, 1e-5, 0.0001, -2.5e-10, 1 / 3, r.random() * 10 ** r.randrange(-30, 30), float(r.randrange(10**9))])
    rows = []
    for i in range(200):
        m = {k: r.choice([None, [word(), word()], []]) for k in r.sample(["b", "a", "é", 'k"', "Z", "𝒳", "￮"], r.randrange(0, 5))}
        rows.append((i, {"z": word(), "a": {"n": r.choice([None, 0, -(2**63), 7]), "f": num(), "ok": r.choice([None, True, False])}, "l": r.choice([None, [], [[num(), num()], [], None]]), "m": r.choice([None, m]), "s": r.choice([None, [{"y": 1, "x": word()}, None]])}))
    df = spark.createDataFrame(rows, KIND)
    got = {x.id: x.j for x in df.select("id", canonical.json(F.col("r"), df.schema["r"].dataType).alias("j")).collect()}
    for i, v in rows:
        assert got[i] == dumped(v), (got[i], dumped(v))


def test_floats_are_the_shortest(spark):
    r = random.Random(1)
    values = [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(20_000)] + [r.uniform(-1e6, 1e6) for _ in range(20_000)] + [5e-324, 1.7976931348623157e308, 2e-3, 2.2250738585072014e-308, 9007199254740993.0, 1e22, 1e23, float("inf"), float("-inf")]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double").repartition(8)
    got = dict(df.select("i", canonical.number(F.col("v")).alias("s")).collect())
    wrong = [(values[i], s) for i, s in got.items() if s != dumped(values[i])]
    assert all(float(s) == v for v, s in wrong) and len(wrong) <= len(values) // 1000, wrong[:5]


def test_hash_and_refusals(spark):
    df = spark.createDataFrame([({"b": 1.5, "a": None},)], "m map<string,double>")
    assert df.select(canonical.json(F.col("m"), df.schema["m"].dataType)).first()[0] == '{"a":null,"b":1.5}'
    for kind in ("map<int,int>", "binary"):
        field = spark.createDataFrame([], f"x {kind}")
        with pytest.raises(TypeError):
            canonical.json(F.col("x"), field.schema["x"].dataType)
