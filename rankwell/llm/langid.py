"""Language identification by rank-order profiles of n-grams.

A profile lists the most frequent letter n-grams (1 to 3 code points, words padded by a
blank) of a language in order of frequency.  A document's own list is compared with each
by the out-of-place distance: the sum of rank differences, with the profile's length for
n-grams that it lacks.  The language of the least distance wins, ties by name.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm import textvec as tv
from rankwell.llm.common import arrow_map, materialise

#: N-grams of a profile and of a document's list.
PROFILE = 400
#: Training rows of each language at most: those of the smallest hashed doc_id.
TRAIN_ROWS = 1500
UNKNOWN = "und"


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower case (of one code point)."""
    n = 0x110000
    letter, lower = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for c in range(0x323B0):  # the planes that hold letters
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            if len(y := x.lower()) == 1:
                lower[c] = ord(y)
    return letter, lower


def ngram_ranks(s: tv.Slice, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, rank from 0, count) of each text's most frequent n-grams, ties by n-gram.

    An n-gram is its code points at 21 bits each; blanks pad words.
    """
    letter, lower = _letters()
    cps, first = tv.code_points(s)
    n = len(s)
    is_letter = letter[cps]
    own = tv.owner_of(first)
    c = np.where(is_letter, lower[cps], 0).astype(np.uint64)
    keys, owners = [c[is_letter]], [own[is_letter]]
    padded, powner = np.insert(c, first[1:], 0), np.insert(own, first[1:], np.arange(n))  # a blank after each text
    padded, powner = np.insert(padded, 0, 0), np.insert(powner, 0, 0)
    for k in (2, 3):
        if len(padded) < k:
            continue
        m = len(padded) - k + 1
        g = np.zeros(m, np.uint64)
        for i in range(k):
            g = (g << np.uint64(21)) | padded[i : i + m]
        if k == 2:
            live = (padded[:m] != 0) | (padded[1:] != 0)
        else:  # the middle is a letter: blanks only at the ends
            live = padded[1 : m + 1] != 0
        # an n-gram belongs to the text of its letters; the first blank may be the last one's
        mid = powner[k - 1 : k - 1 + m] if k == 2 else powner[1 : m + 1]
        if k == 2:
            mid = np.where(padded[:m] != 0, powner[:m], powner[1 : m + 1])
        keys.append(g[live] | np.uint64(1 << (60 + k)))  # n-grams of different lengths differ
        owners.append(mid[live])
    key, own = np.concatenate(keys), np.concatenate(owners)
    if not len(key):
        z = np.zeros(0, np.int64)
        return z, key, z, z
    # one sort of (text, hashed n-gram) counts all of them
    bits = max(1, int(n).bit_length())
    packed = (own.astype(np.uint64) << np.uint64(64 - bits)) | (tv.mix(key) >> np.uint64(bits))
    order = np.argsort(packed)
    packed, key, own = packed[order], key[order], own[order]
    at = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
    count, key, own = np.diff(np.append(at, len(packed))), key[at], own[at]
    order = np.lexsort((key, -count, own))
    key, own, count = key[order], own[order], count[order]
    begin = np.searchsorted(own, np.arange(n))
    rank = np.arange(len(own)) - begin[own]
    top = rank < (most or len(rank) + 1)
    return own[top], key[top], rank[top], count[top]


def train(docs: DataFrame, rows: int = TRAIN_ROWS, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language from rows with text and lang; at most `rows` of a language.

    lang names are few; the result holds `size` numbers for each.
    """
    usable = docs.where("text is not null and lang is not null and doc_id is not null").select("lang", "text", "doc_id")
    space = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000.0
    n = usable.groupBy("lang").agg(F.count("*").alias("n"))
    # rows of the smallest hashes, without a sort of any language's rows: a share of hash space first
    share = F.least(F.lit(1.0), F.lit(2.0 * rows) / F.col("n"))
    # where equal rows crowd the share leaves too few, and the language's rows are all looked at
    got = usable.join(F.broadcast(n), "lang").where(space < share).groupBy("lang").agg(F.count("*").alias("got"))
    few = F.coalesce("got", F.lit(0)) < F.least(F.lit(rows), F.col("n"))
    cut = materialise(n.join(got, "lang", "left").select("lang", F.when(few, 1.0).otherwise(share).alias("share")), "languages")
    some = usable.join(F.broadcast(cut), "lang").where((space < F.col("share")) | (F.col("share") >= 1)).select("lang", "text", space.alias("h"), "doc_id")
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= rows)

    def count(batch):
        lang = np.array(batch.column("lang").to_pylist(), object)
        for s in tv.slices(batch.column("text")):
            own, key, _, n = ngram_ranks(s, None)
            yield {"lang": lang[s.lo + own].tolist(), "gram": key.view(np.int64), "n": n}

    total = arrow_map(some.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= size)
    got = top.select("lang", "gram", "r").toArrow().to_pandas().sort_values(["lang", "r"])
    return {k: g["gram"].to_numpy(np.int64).view(np.uint64) for k, g in got.groupby("lang")}


def classify(s: tv.Slice, profiles: dict[str, np.ndarray], size: int = PROFILE) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: 1 less its distance as a share of the largest possible."""
    own, key, rank, _ = ngram_ranks(s, size)
    n = len(s)
    have = np.bincount(own, minlength=n)
    names = sorted(profiles)
    distance = np.full((len(names), n), np.inf)
    for i, name in enumerate(names):
        p = profiles[name]
        order = np.argsort(p)
        at = np.minimum(np.searchsorted(p[order], key), len(p) - 1)
        found = p[order][at] == key
        d = np.where(found, np.abs(order[at] - rank), size)
        distance[i] = np.bincount(own, np.minimum(d, size), minlength=n)
    if not names:
        return [UNKNOWN] * n, np.zeros(n)
    best = distance.argmin(0)
    score = np.where(have > 0, 1 - distance[best, np.arange(n)] / np.maximum(1, have * size), 0.0)
    return [names[b] if h else UNKNOWN for b, h in zip(best, have, strict=True)], np.clip(score, 0, 1)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score; und (score 0) for null text or text without a letter."""

    def run(batch):
        for s in tv.slices(batch.column("text")):
            lang, score = classify(s, profiles)
            yield {"doc_id": batch.column("doc_id").slice(s.lo, len(s)), "lang_pred": lang, "score": pa.array(score)}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double")
