"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once.

No pre-tokenizer of the two vocabularies joins what stands before a space and the space
that precedes a visible character, or an ASCII letter and the ASCII punctuation after it,
so a text may be cut there and the ids of its pieces concatenated.  Pieces repeat, so
each worker keeps the ids of those that it has met, up to a bound that only limits memory.
Kept pieces are found by their bytes: up to 15 of them and their number are two numbers,
which are the key itself; longer ones are keys of a dictionary.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

from rankwell.llm import textvec as tv

#: Slots of a worker's table of pieces; it starts over when 60 % are taken.
SLOTS = 1 << 20
#: Bytes of a piece whose key is two numbers, and how many longer ones are kept at most.
SHORT, LONGER = 15, 50_000
#: A space or line feed followed by one of these stays inside its piece: white space, or
#: the first byte of a longer white space character.
_STAYS = np.zeros(256, bool)
_STAYS[[*tv.WHITE, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

_open: dict[str, "PieceEncoder"] = {}


def default_path(name: str) -> str:
    """Place of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.size = self.tok.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.tok.to_str())
        #: whether the normalizer folds case and drops spaces
        self.folds = spec["normalizer"] is not None
        self.alphabet = _byte_alphabet()
        self._reset()
        self.longer: dict[bytes, list[int]] = {}

    def _reset(self) -> None:
        self.low, self.high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.uint32)
        self.n = np.zeros(SLOTS, np.uint16)
        self.ids = np.zeros(1 << 16, np.uint16)
        self.used = self.taken = 0

    @staticmethod
    def of(path: str) -> "PieceEncoder":
        """The worker's encoder of that file."""
        if path not in _open:
            _open[path] = PieceEncoder(path)
        return _open[path]

    def _plain_word(self, raw: bytes) -> bool:
        """One pre-token for certain: letters of the Latin-1 range, after one space or none."""
        body = raw.decode("utf-8", "replace").removeprefix(" ")
        return body.isalpha() and max(body) <= "ÿ" and (not self.folds or unicodedata.is_normalized("NFC", body))

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one piece.  A plain word needs no splitting, only the library's model."""
        spaced = raw[:1] == b" "
        body = raw[1:] if spaced else raw
        if body.isalpha():  # ASCII letters only
            word = body.lower().decode() if self.folds else ("Ġ" if spaced else "") + body.decode()
            return [t.id for t in self.tok.model.tokenize(word)]
        if self._plain_word(raw):
            if self.folds:
                raw = raw.removeprefix(b" ").decode().lower().encode()
            return [t.id for t in self.tok.model.tokenize(raw.decode("latin-1").translate(self.alphabet))]
        return self.tok.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids

    @staticmethod
    def _slot(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (tv.mix(low ^ tv.mix(high)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it is not known.  high holds the number of bytes, so no key is 0."""
        slot = self._slot(low, high)
        out = np.full(len(low), -1, np.int64)
        todo = np.arange(len(low))
        while len(todo):
            at = slot[todo]
            hit = (self.low[at] == low[todo]) & (self.high[at] == high[todo])
            out[todo[hit]] = at[hit]
            todo = todo[~hit & (self.high[at] != 0)]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
        return out

    def _learn(self, low: np.ndarray, high: np.ndarray, pieces: list[bytes]) -> None:
        got = [self.encode_piece(p) for p in pieces]
        n = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((x for g in got for x in g), np.int64, int(n.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint16)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        self.taken += len(low)
        slot = self._slot(low, high)
        todo = np.arange(len(low))
        while len(todo):
            # of keys that want one free slot, the last gets it whole
            s = slot[todo]
            free = todo[self.high[s] == 0]
            self.low[slot[free]], self.high[slot[free]] = low[free], high[free]
            won = (self.low[s] == low[todo]) & (self.high[s] == high[todo])
            self.at[s[won]], self.n[s[won]] = at[todo[won]], n[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)

    def _encode_long(self, raw: bytes) -> list[int]:
        """Ids of a piece of more than SHORT bytes."""
        ids = self.longer.get(raw)
        if ids is None:
            ids = self.encode_piece(raw)
            if len(raw) <= 256:
                if len(self.longer) >= LONGER:
                    self.longer.clear()
                self.longer[raw] = ids
        return ids

    def encode(self, s: tv.Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the slice, end to end, and the first of each (len + 1 entries)."""
        data, n = s.data, len(s.data)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(len(s) + 1, np.int64)
        begin = np.zeros(n, bool)
        now, nxt = data[:-1], data[1:]
        begin[:-1] = ((now == 0x20) | (now == 0x0A)) & ~_STAYS[nxt]
        begin[1:] |= _LETTER[now] & _PUNCT[nxt]
        begin[s.offsets[:-1][np.diff(s.offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
        size = ends - starts
        long = size > SHORT
        low = tv.loads(data, starts, size)
        high = tv.loads(data, np.minimum(starts + 8, n), size - 8) | (np.minimum(size, SHORT).astype(np.uint64) << np.uint64(56))
        if self.taken > SLOTS * 6 // 10:
            self._reset()
        slot = np.full(len(starts), -1, np.int64)
        short = np.flatnonzero(~long)
        slot[short] = self._find(low[short], high[short])
        new = short[slot[short] < 0]
        if len(new):
            both = np.stack([low[new], high[new]])
            order = np.lexsort(both)
            first = np.ones(len(new), bool)
            first[1:] = (both[:, order[1:]] != both[:, order[:-1]]).any(0)
            at, raw = new[order[first]], data.tobytes()
            for lo in range(0, len(at), SLOTS // 4):
                part = at[lo : lo + SLOTS // 4]
                if self.taken + len(part) > SLOTS * 9 // 10:
                    break
                self._learn(low[part], high[part], [raw[a:b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)])
            slot[new] = self._find(low[new], high[new])
        n_ids = np.where(slot >= 0, self.n[slot], 0).astype(np.int64)
        other: dict[int, list[int]] = {}
        for i in np.flatnonzero(slot < 0).tolist():
            other[i] = self._encode_long(data[starts[i] : ends[i]].tobytes())
            n_ids[i] = len(other[i])
        stop = np.cumsum(n_ids)
        where = self.at[slot].astype(np.int64)
        where[slot < 0] = 0
        ids = self.ids[np.minimum(np.repeat(where - (stop - n_ids), n_ids) + np.arange(int(stop[-1])), len(self.ids) - 1)]
        for i, x in other.items():
            ids[stop[i] - n_ids[i] : stop[i]] = x
        upto = np.concatenate([[0], stop])
        return ids, upto[np.searchsorted(starts, s.offsets)]


class ByteDecoder:
    """Bytes of ids of a byte-level vocabulary; ids from size on are reserved ones, without bytes."""

    _open: dict[str, "ByteDecoder"] = {}

    def __init__(self, path: str):
        enc = PieceEncoder.of(path)
        if enc.folds:
            raise ValueError("texts can't be read back from ids of a vocabulary that folds them")
        self.size = enc.size
        back = {c: b for b, c in enc.alphabet.items()}
        pieces = [b""] * (self.size + 16)
        for token, i in enc.tok.get_vocab(with_added_tokens=True).items():
            pieces[i] = bytes(back[c] for c in token)
        self.n = np.array([len(p) for p in pieces])
        self.at = np.cumsum(self.n) - self.n
        self.data = np.frombuffer(b"".join(pieces), np.uint8)

    @classmethod
    def of(cls, path: str) -> "ByteDecoder":
        """The worker's decoder of that file."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, end to end, and the first byte of each (len + 1 entries)."""
        n = self.n[ids]
        edge = np.concatenate([[0], np.cumsum(n)])
        return self.data[np.repeat(self.at[ids] - edge[:-1], n) + np.arange(edge[-1])], edge


def encode_texts(texts: pa.Array, path: str):
    """(row, ids) of each text of an Arrow column, by slices of bounded size."""
    enc = PieceEncoder.of(path)
    for s in tv.slices(texts):
        ids, first = enc.encode(s)
        for i in range(len(s)):
            yield s.lo + i, ids[first[i] : first[i + 1]]
