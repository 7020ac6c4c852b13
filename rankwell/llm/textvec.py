"""Vectorised text primitives over Arrow string buffers (numpy, one pass per byte).

All functions see the UTF-8 bytes of a whole batch at once.  Separators of the word
classes used here are ASCII, so byte-wise classification is exact for UTF-8 text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)

#: Bytes of one slice; a longer text is a slice of its own.
SLICE_BYTES = (1 << 19) - 64
#: Texts of one slice at most.
SLICE_ROWS = 256


def class_table(separators: bytes) -> np.ndarray:
    """Boolean table: true for bytes that belong to words."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: words [^\x20\x09-\x0D]+
NONWHITE = class_table(WHITE)
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text with A-Z lower-cased
ALNUM = class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_pow", _P), ("_inv", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, U64)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _pow[:n], _inv[:n]


#: Spans of more bytes than this are hashed whole by a keyed block hash.
LONG_SPAN = 64
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def loads(data: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each start, as little-endian numbers; n[i] of them count, or all."""
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))
    return words[starts] & _LOW[np.clip(n, 0, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes have equal hashes wherever they stand.

    Eight bytes at a time pass a mixer that has no algebraic structure, so no family of texts
    collides by construction, as sums of powers do.
    """
    if not len(starts):
        return np.zeros(0, U64)
    n = ends - starts
    h = mix(n.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(_P))
    rest = np.arange(len(starts))
    for off in range(0, LONG_SPAN, 8):
        rest = rest[n[rest] > off] if off else np.flatnonzero(n > 0)
        if not len(rest):
            return h
        h[rest] = mix((h[rest] ^ loads(data, starts[rest] + off, n[rest] - off)) * U64(_P))
    for i in np.flatnonzero(n > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=b"spans").digest(), "little")
    return h


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k bytes from each place on, as sums of powers: for choices that bytes confirm, not for equality."""
    n = len(data)
    if n < k:
        return np.zeros(0, U64)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1] ^ U64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive entries (order matters): len(h) - k + 1 values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(k):
        out = out * U64(0x9FB21C651E98DF25) + h[i : i + n]
        out ^= out >> U64(29)
    return mix(out + U64(k))


class Slice:
    """Some consecutive texts: lo and hi rows of the batch, their bytes and offsets into them."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> str:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into slices of about limit bytes and SLICE_ROWS texts; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offs, raw = column.buffers()[:3]
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, lo + SLICE_ROWS, max(hi, lo + 1))
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def words(s: Slice, table: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, first word of each text (len + 1 entries) and the bytes used."""
    data = LOWER[s.data] if lower else s.data
    n = len(data)
    inside = table[data]
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = False
    if n:
        edge[0], edge[n] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:n])
    # a word also ends where its text ends, though the next text goes on at once
    cut = s.offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    cut = cut[inside[cut - 1] & inside[cut]] if len(cut) else cut
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, s.offsets), data


def sums_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of values of each text, given the first entry of each (len + 1 entries)."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def code_points(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice (uint32) and the first of each text (len + 1 entries)."""
    lead = (s.data & 0xC0) != 0x80
    before = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum(lead, out=before[1:])
    cps = np.frombuffer(s.data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    return cps, before[s.offsets]


def owner_of(first: np.ndarray) -> np.ndarray:
    """Text of each entry, given the first entry of each."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
