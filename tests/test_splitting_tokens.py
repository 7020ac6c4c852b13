"""The splitter's tokens and cuts against plain regular expressions on the strings themselves, level by level."""

import random
import re

from rankwell.functions import text as T
from rankwell.operators import splitting as S

ABBR = re.compile(r"\b(" + "|".join(T.ABBREVIATIONS) + r")\.[ \t\n\r\f\v]+", re.IGNORECASE)
PAGES = "document_id string, page_number int, text string"


def count(s):
    return len(re.findall(r"\S+", s, re.ASCII))


def pieces(text, size):
    """Each step cuts strings, as the splitter is told to."""

    def fine(s, steps):
        if count(s) <= size:
            return [count(s)]
        return [n for part in steps[0](s) for n in fine(part, steps[1:])] if steps else [1] * count(s)

    def sentences(s):
        return [x.replace("\x02", " ") for x in re.split(r"(?<=[.!?])[ \t\n\r\f\v]+", ABBR.sub(lambda m: m[1] + ".\x02", ABBR.sub(lambda m: m[1] + ".\x02", s)))]

    return [n for n in fine(text, [lambda s: s.split("\n\n\n"), sentences, lambda s: re.split(r"(?<=[,.;。？！])[ \t\n\r\f\v]+", s)]) if n]


def nodes(root, text, sizes, overlap, level=0):
    tokens = re.findall(r"\S+\s*", text, re.ASCII)
    for k, (first, n) in enumerate(S._spans(pieces(text, sizes[level]), sizes[level], overlap)):
        own = "".join(tokens[first : first + n]).rstrip(" \t\n\r\f\v")
        yield f"{root}/{k}", level, first, n, own
        if level + 1 < len(sizes):
            yield from nodes(f"{root}/{k}", own, sizes, overlap, level + 1)


def test_tree_as_by_strings(spark):
    r, words = random.Random(7), ["a", "Sra.", "xDr.", "déf", "e.g.", "nº.", "x,", "y;", "fim.", "Ok!", "eh?", " ", " ", "à。", "x-fig.", "..", "𝄞"]
    rows = [(f"d{i}", i, r.choice(["", "\n\n\n", " "]) + "".join(r.choice(words) + r.choice([" ", " ", "  ", "\n", "\t", "\n\n\n", "\n\n\n\n\n\n"]) for _ in range(r.choice([0, 1, 5, 60, 300])))) for i in range(80)]
    got = sorted((n.node_id, n.level, n.first_token, n.n_tokens, n.text) for n in S.tree(spark.createDataFrame(rows, PAGES), (40, 15, 4), 3).collect())
    assert got == sorted(x for d, p, text in rows for x in nodes(f"{d}_p{p}", text, (40, 15, 4), 3))


def test_texts_as_they_are(spark):
    """A blank before a separator that is no blank stays; keys may be null; without texts the rest is the same."""
    df = spark.createDataFrame([("d", 1, "a b  "), (None, 2, "c d")], PAGES)
    assert sorted((n.node_id or "", n.page_number, n.text) for n in S.tree(df, (9,), 1).collect()) == [("", 2, "c d"), ("d_p1/0", 1, "a b  ")]
    assert S.split(df, 9, 1).where("document_id = 'd'").first().text == "a b  "
    assert S.tree(df, (9,), 1).drop("text").collect() == S.tree(df, (9,), 1, texts=False).drop("text").collect()
