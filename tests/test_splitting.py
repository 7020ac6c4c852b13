"""The sentence-aware splitter: budget, overlap, sentences kept whole, parents that cover their children."""

import random
import re

import pytest

from rankwell.operators import splitting as S

PAGES = "document_id string, page_number int, text string, ordinal int, c string"


def joined(counts, size, overlap):
    """Spans of tokens in plain Python: fill, then start again with the last whole pieces that fit."""
    out, held = [], []
    for n in counts:
        if sum(held) + n > size:
            end = out[-1][0] + out[-1][1] if out else 0
            out.append((out[-1][2] if out else 0, sum(held), 0))
            start = out[-1][0] + out[-1][1]
            while sum(held) > overlap or sum(held) + n > size:
                held = held[1:]
            out[-1] = (out[-1][0], out[-1][1], start - sum(held))
            assert end <= start
        held = [*held, n]
    return [(a, n) for a, n, _ in out] + ([(out[-1][2] if out else 0, sum(held))] if held else [])


def text_of(r, words):
    out = []
    for i in range(words):
        out.append(r.choice(["a", "bc", "déf", "Dr.", "e.g.", "x,", "y;"]) + ("." if r.random() < 0.1 else ""))
        out.append(r.choice([" ", " ", "  ", "\n", "\n\n\n" if r.random() < 0.2 else " "]))
    return "".join(out)


@pytest.mark.parametrize("size,overlap", [(1, 0), (7, 3), (20, 19), (50, 0)])
def test_spans_fill_the_budget(spark, size, overlap):
    r = random.Random(size)
    rows = [([r.randrange(1, size + 1) for _ in range(r.randrange(0, 40))],) for _ in range(60)]
    df = spark.createDataFrame(rows, "c array<int>")
    got = [([(x.first, x.n) for x in row.s], row.c) for row in df.select("c", S.spans(df.c, size, overlap).alias("s")).collect()]
    assert [x for x, _ in got] == [joined(c, size, overlap) for _, c in got]


def test_split_properties(spark):
    r = random.Random(1)
    rows = [(f"d{i}", 1, text_of(r, r.choice([0, 3, 40, 400])), 0, "x") for i in range(40)] + [("n", 1, None, 0, "x"), ("e", 1, "", 0, "x"), ("b", 1, " \n\t ", 0, "x"), ("long", 1, "w " * 30_000, 0, "x"), ("d1", 1, "again", 0, "x")]
    df = spark.createDataFrame(rows, PAGES)
    got = {}
    for c in sorted(S.split(df.where("document_id != 'd1'"), 30, 8).collect(), key=lambda c: c.ordinal):
        got.setdefault(c.document_id, []).append(c)
    assert not {"n", "e", "b"} & set(got) and len(got["long"]) > 1300
    for doc, _, text, *_ in rows:
        if doc not in got:
            continue
        words, end = text.split(), 0
        for i, c in enumerate(got[doc]):
            assert c.ordinal == i and c.n_tokens <= 30 and c.text.split() == words[c.first_token : c.first_token + c.n_tokens] and c.text in text
            assert c.first_token <= end <= c.first_token + 8  # no gap, and at most the overlap
            end = c.first_token + c.n_tokens
        assert end == len(words)


def test_sentences_that_fit_stay_whole(spark):
    sentences = [" ".join(["Aa"] + ["b"] * n) + "." for n in (5, 9, 4, 7, 9, 3, 8)]
    df = spark.createDataFrame([("d", 1, " ".join(sentences), 0, "x")], PAGES)
    for c in S.split(df, 12, 6).collect():
        assert re.fullmatch(r"(Aa( b)+\.\s?)+", c.text), c.text
    with pytest.raises(ValueError):
        S.split(df, 10, 10)


def test_tree_parents_cover_children(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(f"d{i}", 1, text_of(r, 500), 0, "x") for i in range(8)] + [("n", 1, None, 0, "x")], PAGES)
    nodes = {n.node_id: n for n in S.tree(df, (100, 40, 15), 5).collect()}
    assert {n.level for n in nodes.values()} == {0, 1, 2}
    inner = {}
    for n in nodes.values():
        if n.parent_id:
            p = nodes[n.parent_id]
            assert p.level == n.level - 1 and n.text in p.text and n.text.split() == p.text.split()[n.first_token : n.first_token + n.n_tokens]
            inner.setdefault(p.node_id, []).append(n)
    for p in nodes.values():
        if p.level < 2:
            own = sorted(inner[p.node_id], key=lambda n: n.ordinal)
            assert [n.ordinal for n in own] == list(range(len(own))) and own[0].first_token == 0 and own[-1].first_token + own[-1].n_tokens == p.n_tokens
    with pytest.raises(ValueError):
        S.tree(df, (10, 20))
