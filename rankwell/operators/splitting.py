"""Sentence-aware splitting to a budget of tokens, with overlap, and the tree of nested splits.

A text is first cut only as finely as it must be: paragraphs that exceed the budget into
sentences, those into clauses, those into words.  The pieces are then joined again, in a fold
over their token counts, to chunks that fill the budget.  Each chunk but the first begins with
the last whole pieces of the one before, as far as the overlap allows and the next piece still
fits.  A token is a run of non-blanks.

All cuts lie between tokens and depend on the token before and the blanks after it, so a text's
tokens and cuts are found once and hold for every level of its tree.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankwell.functions import text as T
from rankwell.operators.chunking import KEYS

#: What parts paragraphs, and what ends a sentence or a clause. Fixed values.
PARAGRAPH, SENTENCE_ENDS, CLAUSE_ENDS = "\n\n\n", ".!?", ",.;。？！"
#: Overlap of the levels of a tree unless told otherwise. Fixed value.
TREE_OVERLAP = 20
#: Characters of text of a batch that a task puts out.
OUT_CHARS = 4_000_000
_KNOWN = re.compile(r"\b(?:" + "|".join(T.ABBREVIATIONS) + r")\.\Z", re.IGNORECASE)
_BLANKS = np.zeros(128, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True


class _Tokens:
    """Where a text's tokens start and end, and before which tokens paragraphs, sentences and clauses begin."""

    def __init__(self, text: str, least: int):
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        full = np.r_[False, ~((code < 128) & _BLANKS[np.minimum(code, 127)]), False].view(np.int8)
        edge = np.diff(full)
        self.text, self.starts, self.ends = text, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.cuts: list[list[int]] = [[], [], []]
        if len(self.starts) > least:  # else no level cuts it
            last = code[self.ends - 1]
            at = lambda marks: np.flatnonzero(np.isin(last, [ord(c) for c in marks]))
            paragraphs = np.unique(np.searchsorted(self.starts, [m.start() for m in re.finditer(PARAGRAPH, text)]))
            whole = [i for i in at(SENTENCE_ENDS).tolist() if last[i] != 46 or not _KNOWN.search(text[self.starts[i] : self.ends[i]])]
            self.cuts = [paragraphs.tolist(), [i + 1 for i in whole], (at(CLAUSE_ENDS) + 1).tolist()]

    def pieces(self, lo: int, hi: int, size: int, depth: int = 0) -> Iterator[int]:
        """Token counts of the pieces of tokens lo to hi, in order, none above size."""
        if hi - lo <= size:
            yield hi - lo
        elif depth == len(self.cuts):
            yield from (1 for _ in range(lo, hi))
        else:
            own = self.cuts[depth]
            inner = own[bisect_right(own, lo) : bisect_left(own, hi)]
            for a, b in zip([lo, *inner], [*inner, hi], strict=True):
                yield from self.pieces(a, b, size, depth + 1)

    def chunks(self, lo: int, hi: int, size: int, overlap: int) -> list[tuple[int, int]]:
        return _spans(self.pieces(lo, hi, size), size, overlap) if hi > lo else []

    def between(self, lo: int, hi: int) -> str:
        return self.text[self.starts[lo] : self.ends[hi - 1]]


def _spans(counts: Iterable[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """(first, n) of each chunk.

    The fold keeps where the pieces of the open chunk start; when the next piece does not fit,
    the chunk is closed, and of its pieces those stay that start late enough.
    """
    out, first, end, starts = [], 0, 0, deque()
    for n in counts:
        if end + n - first > size:
            out.append((first, end - first))
            while starts and starts[0] < max(end - overlap, end + n - size):
                starts.popleft()
            first = starts[0] if starts else end
        starts.append(end)
        end += n
    return out + ([(first, end - first)] if end > first else [])


def spans(counts: Column, size: int, overlap: int) -> Column:
    """(first, n) of each chunk, in tokens, of the token counts of pieces."""
    return F.udf(lambda c: _spans(c, size, overlap), "array<struct<first:int,n:int>>")(counts)


def _rows(pages: DataFrame, nodes: Callable[[str | None, str], Iterator[tuple]], columns: str) -> DataFrame:
    """Keys of pages with the rows that nodes gives for a page's name and text; the last column is a text or null."""
    kind = StructType([pages.schema[c] for c in KEYS] + StructType.fromDDL(columns).fields)
    names, own = kind.fieldNames(), [{"string": pa.string(), "int": pa.int32()}[c.split()[1]] for c in columns.split(", ")]

    def run(batches):
        out, held, kinds = [], 0, own
        for b in batches:
            cols = [b.column(c) for c in (*KEYS, "root", "text")]
            kinds = [c.type for c in cols[: len(KEYS)]] + own
            for i in range(b.num_rows):
                *keys, root, text = (c[i].as_py() for c in cols)
                for row in nodes(root, text):
                    out.append((*keys, *row))
                    held += 100 + len(row[-1] or "")
                    if held > OUT_CHARS:
                        yield batch(out, kinds)
                        out, held = [], 0
        if out:
            yield batch(out, kinds)

    def batch(rows, kinds):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    root = F.concat("document_id", F.lit("_p"), "page_number").alias("root")
    return pages.where("text is not null").select(*KEYS, root, "text").mapInArrow(run, kind)


def _checked(sizes: tuple[int, ...], overlap: int) -> None:
    if not all(0 <= overlap < size for size in sizes):
        raise ValueError("the overlap must be less than the size")


def split(pages: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Pages to chunks: chunk_id by ordinal, first token, tokens, text; blanks inside a chunk stay as they are. None for a text without tokens."""
    _checked((size,), overlap)

    def nodes(root, text):
        t = _Tokens(text, size)
        for k, (first, n) in enumerate(t.chunks(0, len(t.starts), size, overlap)):
            yield (None if root is None else f"{root}_n{k}"), k, first, n, t.between(first, first + n)

    return _rows(pages, nodes, "chunk_id string, ordinal int, first_token int, n_tokens int, text string")


def tree(pages: DataFrame, sizes: tuple[int, ...] = (1024, 512, 256), overlap: int = TREE_OVERLAP, texts: bool = True) -> DataFrame:
    """Nodes of nested splits: node_id, level (0 the largest), parent_id, ordinal in the parent, first_token in it, n_tokens, text.

    Each level is split from the chunks of the one above, in passing; a child's id is its parent's and its ordinal.
    Without texts, text is null.
    """
    if list(sizes) != sorted(set(sizes), reverse=True):
        raise ValueError("sizes must fall")
    _checked(sizes, overlap)

    def nodes(root, text):
        t = _Tokens(text, min(sizes))

        def below(up, lo, hi, level):
            for k, (first, n) in enumerate(t.chunks(lo, hi, sizes[level], overlap)):
                own, a = None if up is None else f"{up}/{k}", lo + first
                yield own, level, up if level else None, k, first, n, t.between(a, a + n) if texts else None
                if level + 1 < len(sizes):
                    yield from below(own, a, a + n, level + 1)

        return below(root, 0, len(t.starts), 0)

    return _rows(pages, nodes, "node_id string, level int, parent_id string, ordinal int, first_token int, n_tokens int, text string")
