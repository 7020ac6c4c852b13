"""Quality rules: base counts and a calibrated logistic regression on hashed n-grams.

Features are word unigrams and character trigrams hashed into ``2 * HALF`` columns, as
log counts of unit length.  The model is trained on labelled rows, by Nesterov descent
with an L2 penalty, and Platt-scaled on rows held out from it.  Documents are scored in
Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankwell.llm import textvec as tv
from rankwell.llm.common import arrow_map

HALF = 1024
#: Labelled rows used for training at most: those of the smallest hashed doc_id.
TRAIN_ROWS = 4000
#: Documents whose calibrated probability of good quality is below this are rejected.
THRESHOLD = 0.5
#: Base limits.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def features(s: tv.Slice) -> np.ndarray:
    """One row of unit length per text (zeros for an empty one)."""
    n = len(s)
    starts, ends, first, data = tv.words(s, tv.NONWHITE, lower=True)
    h = tv.span_hashes(data, starts, ends)
    x = np.zeros((n, 2 * HALF), np.float32)
    x[:, :HALF] = np.bincount(tv.owner_of(first) * HALF + (h >> np.uint64(54)).astype(np.int64), minlength=n * HALF).reshape(n, HALF)
    cps, at = tv.code_points(s)
    if len(cps) > 2:
        c = cps.astype(np.uint64)
        gram = tv.mix(c[:-2] | (c[1:-1] << np.uint64(21)) | (c[2:] << np.uint64(42)))
        own = tv.owner_of(at)
        same = own[:-2] == own[2:]
        x[:, HALF:] = np.bincount(own[:-2][same] * HALF + (gram[same] >> np.uint64(54)).astype(np.int64), minlength=n * HALF).reshape(n, HALF)
    np.log1p(x, out=x)
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    return x


def base_counts(s: tv.Slice) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    starts, ends, first, data = tv.words(s, tv.NONWHITE)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    out = {"n_words": np.diff(first), "word_chars": tv.sums_by(first, lead[ends] - lead[starts])}
    sym = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=sym[1:])
    out["n_symbols"] = sym[s.offsets[1:]] - sym[s.offsets[:-1]]
    # lines with a word
    edge = np.union1d(np.flatnonzero(data == 0x0A) + 1, s.offsets[:-1][np.diff(s.offsets) > 0])
    edge = edge[edge < len(data)]
    stop = np.append(edge[1:], len(data)) if len(edge) else edge
    stop = stop - (data[stop - 1] == 0x0A) if len(edge) else stop
    worded = np.searchsorted(starts, stop) > np.searchsorted(starts, edge)
    a, b = edge[worded], stop[worded]
    own = np.searchsorted(s.offsets, a, "right") - 1
    out["n_dup_lines"] = np.bincount(own, minlength=len(s)) - np.bincount(own[_first(_keyed(tv.span_hashes(data, a, b), own))], minlength=len(s))
    # words in 3-word windows found twice or more
    h = tv.span_hashes(data, starts, ends)
    marked = np.zeros(len(h) + 3, np.int64)
    if len(h) >= 3:
        own = tv.owner_of(first)
        inside = np.flatnonzero(own[:-2] == own[2:])
        key = _keyed(tv.run_hashes(h, 3)[inside], own[inside])
        order = np.argsort(key)
        k = key[order]
        twin = np.zeros(len(k), bool)
        if len(k) > 1:
            equal = k[1:] == k[:-1]
            twin[1:] |= equal
            twin[:-1] |= equal
        again = inside[order[twin]]
        for d in range(3):
            marked[again + d] = 1
    out["n_repeat_words"] = tv.sums_by(first, marked[: len(h)])
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    return out


def _keyed(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    return tv.mix(h ^ tv.mix(own.astype(np.uint64) + np.uint64(1)))


def _first(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_index=True)[1]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -60, 60)))


def _descend(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int, step: float) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weigh = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    w = look = np.zeros(x.shape[1], np.float32)
    for i in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -60, 60)))
        grad = x.T @ (weigh * (p - y)) + penalty * look
        new = look - step * grad
        look = new + i / (i + 3) * (new - w)
        w = new
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Model | None:
    """None where the labels hold one class only."""
    if len(set(y.tolist())) < 2:
        return None
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    w = _descend(x[~held], y[~held], 1e-4, 400, 4.0)
    model = Model(w[:-1], float(w[-1]), 1.0, 0.0)
    # Platt: a line through the scores of held-out rows, fitted by Newton steps on smoothed targets
    rows = held if held.any() else ~held
    z, t = x[rows] @ model.weights + model.bias, y[rows]
    good, bad = t.sum(), len(t) - t.sum()
    t = np.where(t > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    ab = np.array([1.0, 0.0])
    design = np.stack([z, np.ones_like(z)], 1).astype(np.float64)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ ab, -60, 60)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        ab = ab - np.linalg.solve(h, design.T @ (p - t) + 1e-6 * ab)
    return Model(model.weights, model.bias, float(ab[0]), float(ab[1]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fits on at most `rows` labelled documents.

    Null labels are left out; of repeated labels of a document the least counts, and of
    repeated rows of a document the least text.
    """
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def rows_of(batch):
        y = batch.column("quality")
        for s in tv.slices(batch.column("text")):
            yield {"key": batch.column("doc_id").slice(s.lo, len(s)), "y": y.slice(s.lo, len(s)), "x": pa.array([v.tobytes() for v in features(s)], pa.binary())}

    # at most `rows` ids: a bound that makes the broadcast safe
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = arrow_map(joined, rows_of, "key long, y int, x binary").toArrow().combine_chunks().sort_by([("key", "ascending"), ("x", "ascending")])
    if not len(got):
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(len(got), 2 * HALF)
    return fit(x, np.asarray(got["y"]).astype(np.float32))


SCORES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_good double, kept boolean"


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs' columns (documents' own) with the base counts, p_good and kept.

    Null and empty texts have no words and fail the base rules.  Without a model (no
    labels, or of one class) p_good is null and the base rules alone decide.
    """
    own = docs.select(*[c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns])

    names = own.columns

    def run(batch):
        for s in tv.slices(batch.column("text")):
            c = base_counts(s)
            p = model.probability(features(s)).astype(np.float64) if model else None
            c["p_good"] = pa.nulls(len(s), pa.float64()) if p is None else pa.array(p)
            c["kept"] = ~c["base_failed"] & (True if p is None else p >= threshold)
            yield {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in c.items()} | {c: batch.column(c).slice(s.lo, len(s)) for c in names}

    return arrow_map(own, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + ", " + SCORES)
