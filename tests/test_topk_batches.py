"""What a task keeps of its batches for a block of queries: the right ones, sorted seldom, whatever vectors are no numbers."""

import numpy as np
import pytest

from rankwell.operators import retrieval as R


@pytest.mark.parametrize("odd", [False, True])
def test_candidates_are_sorted_seldom(spark, monkeypatch, odd):
    r, k, n = np.random.default_rng(4), 5, 64
    v = np.round(r.normal(size=(40 * 256, 8)), 1)  # some scores are equal
    v[7::1000] = v[3]
    if odd:
        v[11::900, 2] = np.nan
        v[12::900] = 0
    own, got, calls = np.arange(len(v)) * 3, {}, []
    items = spark.createDataFrame([], "id long, vector array<double>")

    def caught(queries, items, add, rows_of, schema, *more):
        got["add"], got["rows"] = add, rows_of
        return items.sparkSession.createDataFrame([], schema)

    monkeypatch.setattr(R, "by_blocks", caught)
    R.top_k(items, items, k)
    firsts = R._firsts
    monkeypatch.setattr(R, "_firsts", lambda *a: calls.append(1) or firsts(*a))
    q, ids = v[:n], own[:n]
    kept, unit = None, R._units(q, np.float32)
    for lo in range(0, len(v), 256):
        kept = got["add"](kept, R._Batch(ids, q, unit, own[lo : lo + 256], v[lo : lo + 256], True))
    kept = got["add"](kept, R._Batch(ids, q, unit, own[:0], v[:0], True))
    found = sorted(zip(*(x.tolist() for x in got["rows"](ids, kept)), strict=True))
    s = R._scores(q, v)
    s[np.arange(n), np.arange(n)] = -np.inf
    want = []
    for i in range(n):
        best = sorted((-s[i, j], own[j]) for j in np.flatnonzero(np.isfinite(s[i])))[:k]
        want += [(int(ids[i]), int(o), float(-x)) for x, o in best]
    assert found == sorted(want)
    if not odd:
        assert len(calls) <= 15  # and not once for each of 40 batches
