"""Repeated passages against brute force over all strings."""

import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest

from rankwell.llm import queries, suffixes

DOCS = "doc_id long, text string, part long, base int, lang string"


def plain(rows, length):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256) from the set of all strings."""
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df, *args):
    return sorted((tuple(r) for r in suffixes.remove_repeats(df, *args).collect()), key=repr)


def corpus(seed, alphabet, n=60):
    """Shared pieces with edits, runs of one letter, copies, nulls, short texts, repeated rows."""
    r = random.Random(seed)
    word = lambda m: "".join(r.choice(alphabet) for _ in range(m))
    pool = [word(r.randrange(8, 60)) for _ in range(8)] + ["a" * 40]
    rows = []
    for i in range(n):
        text = "".join(r.choice(pool) if r.random() < 0.5 else word(r.randrange(0, 30)) for _ in range(r.randrange(0, 7)))
        if text and r.random() < 0.3:
            p = r.randrange(len(text))
            text = text[:p] + r.choice(alphabet) + text[p + 1 :]
        rows.append((i, text, 1, 2, "x"))
    return rows + rows[:4] + [(n, None, 1, 2, None), (n + 1, "", 1, 2, None), (None, pool[0] * 2, 1, 2, None), (n + 2, "ab" * 300, 1, 2, None)]


@pytest.mark.parametrize("hot", [10**6, 2])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh\x00é"])
def test_repeats_against_plain(spark, alphabet, hot):
    rows = corpus(len(alphabet), alphabet)
    assert removed(spark.createDataFrame(rows, DOCS), 14, 5, hot) == plain(rows, 14)


def test_maximal_repeats():
    """Each set of occurrences once, with all of them: neighbours in the array alone would miss the pair 0 and 2."""
    left, right = [b"xyz", b"qqq", b"xyw"], [b"abcd1", b"abcd2", b"abce"]
    found = {(lo, r, tuple(sorted(m))) for lo, r, m in suffixes.maximal_repeats(left, right, 3)}
    assert found == {(0, 4, (0, 1)), (0, 3, (0, 1, 2)), (2, 3, (0, 2))}
    assert sorted(suffixes.intervals([0, 3, 3, 1, 2], 1)) == [(1, 0, 4), (2, 3, 4), (3, 0, 2)]
    assert list(suffixes.maximal_repeats([b""] * 2, [b"abc"] * 2, 3)) == [(0, 3, [0, 1])]


def test_repeats_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted((tuple(r) for r in queries.QUERIES["op13_repeated_passages"](spark, sf).collect()), key=repr)
    assert got == plain([(d["doc_id"], d["text"]) for d in docs], 400) and any(g[2] for g in got)


def test_repeats_empty(spark):
    assert removed(spark.createDataFrame([], DOCS)) == []
    assert removed(spark.createDataFrame([(1, None, 1, 1, "")], DOCS)) == plain([(1, None)], 400)


def test_texts_stay_in_place(spark):
    """The join of marks with texts deals out the marks only."""
    texts = suffixes.write_texts(spark.createDataFrame(corpus(1, "ab"), DOCS))
    marks = texts.groupBy("part", "base").count().repartition(7, "base")
    plan = texts.join(marks.hint("merge"), ["part", "base"])._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("count")]
    assert "Bucketed: true" in plan and above.count("Exchange") <= 1, plan
    suffixes.drop_texts(texts)
