"""Column functions on arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, na: Column | None = None, nb: Column | None = None) -> Column:
    """0 where either vector has no length."""
    na, nb = norm(a) if na is None else na, norm(b) if nb is None else nb
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def hash_embedding(t: Column, dim: int = 64) -> Column:
    """Bytes of the sha256 of a text, repeated to dim and scaled to unit length."""
    h = F.sha2(t, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substr(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double"))
    once = F.array(F.struct(raw.alias("v"), norm(raw).alias("n")))  # binds the norm, which each element needs
    return F.transform(once, lambda s: F.transform(s["v"], lambda x: F.when(s["n"] == 0, x).otherwise(x / s["n"])))[0]
