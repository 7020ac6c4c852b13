"""Deterministic embeddings of texts, and checks that strategies embed alike."""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers (of four bytes) in the vectors of the words that a worker keeps; beyond them it drops the less used half, unless one text has more words.
MOST_VALUES = 30_000_000
#: Fields that must agree between embedders. Fixed values.
FINGERPRINT = ["model", "revision", "dimension", "pooling", "normalized", "dtype", "max_tokens"]


# Fixed formula: a value is the first eight hex digits of a SHA-256 over the word and its place, scaled to -1 to 1.
def word_vector(word: str, dim: int) -> np.ndarray:
    return _scaled(_word_numbers(word, [b"%d" % i for i in range(dim)]))


def _word_numbers(word: str, places: list[bytes]) -> np.ndarray:
    sha, lead = hashlib.sha256, f"w:{word}:".encode()
    return np.frombuffer(b"".join([sha(lead + i).digest()[:4] for i in places]), ">u4")


def _scaled(numbers: np.ndarray) -> np.ndarray:
    return numbers / 0xFFFFFFFF * 2.0 - 1.0


def words_of(text: str) -> list[str]:
    own = [w for w in (x.strip(string.punctuation) for x in re.split(r"[ \t\n\x0b\f\r]+", text.lower())) if w]
    return own or [text.lower().strip()]


def _most_used(place: dict[str, int], numbers: np.ndarray, uses: np.ndarray, most: int):
    """The words that most texts used, at most so many, with their rows; uses are counted anew."""
    stay = sorted(place, key=lambda w: -uses[place[w]])[:most]
    kept = numbers[[place[w] for w in stay]]
    size = max(1024, len(stay))
    rows = np.zeros((size, numbers.shape[1]), np.uint32)
    rows[: len(stay)] = kept
    return {w: i for i, w in enumerate(stay)}, rows, np.zeros(size, np.int64)


def word_sum(docs: DataFrame, key: str, text: str = "text", dim: int = 64) -> DataFrame:
    """id, vector: the sum of word vectors, of unit length; blank and null texts have the zero vector."""

    places = [b"%d" % i for i in range(dim)]

    def run(batches):
        place, numbers, uses = {}, np.zeros((1024, dim), np.uint32), np.zeros(1024, np.int64)  # of the words met so far, a row each
        for b in batches:
            out = np.zeros((b.num_rows, dim))
            for r, t in enumerate(b.column(1).to_pylist()):
                if not t or not t.strip():
                    continue
                counts = Counter(words_of(t))
                if len(place) + len(counts) > MOST_VALUES // dim:
                    place, numbers, uses = _most_used(place, numbers, uses, max(0, MOST_VALUES // dim // 2 - len(counts)))
                for w in counts:
                    if w not in place:
                        if len(place) == len(numbers):
                            numbers, uses = np.concatenate([numbers, np.zeros_like(numbers)]), np.concatenate([uses, np.zeros_like(uses)])
                        numbers[len(place)] = _word_numbers(w, places)
                        place[w] = len(place)
                at = np.fromiter((place[w] for w in counts), np.int64, len(counts))
                uses[at] += 1
                for lo in range(0, len(at), 4096):  # a very long text in parts
                    out[r] += np.fromiter(counts.values(), float, len(at))[lo : lo + 4096] @ _scaled(numbers[at[lo : lo + 4096]])
            n = np.sqrt((out * out).sum(1, keepdims=True))
            out = np.where(n > 0, out / np.where(n > 0, n, 1), out)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["id", "vector"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(run, "id long, vector array<double>")


def fingerprint(**fields: Column) -> Column:
    """Hash of the seven fields that decide whether two embedders are one."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(fields[f].cast("string"), F.lit("?")) for f in FINGERPRINT]), 256)


def parity(prints: DataFrame, by: str) -> DataFrame:
    """prints (by, fingerprint) with whether it agrees with the first by name, and whether all do."""
    from pyspark.sql import Window

    w = Window.orderBy(by)  # a row for each strategy
    every = Window.partitionBy(F.lit(1))
    return prints.withColumn("agrees", F.col("fingerprint") == F.first("fingerprint").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("parity", F.min("fingerprint").over(every) == F.max("fingerprint").over(every))


def canary(vector: Column, dim: int) -> Column:
    """Whether a vector has the dimension and only finite numbers."""
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull()
    return F.coalesce((F.size(vector) == dim) & ~F.exists(vector, bad), F.lit(False))


class Bridge:
    """Any embedder behind one face: a function of texts, or an object that says its size or shows it."""

    def __init__(self, embedder):
        self.embedder = embedder

    def embed(self, texts: list[str]) -> list[list[float]]:
        fn = getattr(self.embedder, "embed_texts", None) or getattr(self.embedder, "embed", None) or self.embedder
        return [list(map(float, v)) for v in fn(texts)]

    def dimension(self) -> tuple[int, str]:
        """(size, how it was found): an attribute dimension, dim or embedding_dim, else the vector of a probe."""
        for name in ("dimension", "dim", "embedding_dim"):
            if isinstance(n := getattr(self.embedder, name, None), int) and n > 0:
                return n, name
        return len(self.embed(["probe"])[0]), "probe"
