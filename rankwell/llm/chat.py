"""Chat formatting by token-level assembly.

Each turn's role and text are encoded as segments of their own; reserved ids, which no
text can encode to, mark where a turn, its content and its end lie.  A turn's place in
its conversation and its loss mask are prefix sums of segment lengths.  In the rendered
form the reserved ids are the strings below; where content holds one of them, or the
escape character, it is escaped, reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankwell.llm import textvec as tv
from rankwell.llm.common import arrow_map, bound_batches, hand_back
from rankwell.llm.tokens import ByteDecoder, PieceEncoder, default_path

ESCAPE, OPEN, HEAD, CLOSE = "\\", "### ", ": ", " </turn>\n"
#: What is escaped in content: the escape character itself and the marks, less their blanks.
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
#: Reserved ids follow the vocabulary: start of a turn, start of its text, its end.
RESERVED = ("turn", "text", "end")
#: Characters of a text that order it among turns of equal number and role, before its hash.
HEAD_CHARS = 64
SEGMENTS = "conv_id long, turn long, role string, head string, rest binary, ids binary, n_ids long, role_ids long, n_chars long, loss boolean"


def escape(text: str, colon: bool = False) -> str:
    out = CONTROL.sub(lambda m: ESCAPE + m[0], text)
    return out.replace(":", ESCAPE + ":") if colon else out


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    return OPEN + escape(role, colon=True) + HEAD + escape(text) + CLOSE


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    token = re.compile(r"\\(?:\\|###|</turn>|:)|### |: | </turn>\n")
    out, state, role, start, at = [], "out", "", 0, 0
    while m := token.search(rendered, at):
        at = m.end()
        if m[0][0] == ESCAPE:
            continue
        if state == "out" and m[0] == OPEN:
            state, start = "role", at
        elif state == "role" and m[0] == HEAD:
            role, state, start = unescape(rendered[start : m.start()]), "text", at
        elif state == "text" and m[0] == CLOSE:
            out.append((role, unescape(rendered[start : m.start()])))
            state = "out"
    return out


def with_control_case(conversations: DataFrame) -> DataFrame:
    """conversations plus conversation -7, whose two texts hold every control string."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = own.sparkSession.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return own.unionByName(more)


def _escaped(texts: pa.Array) -> pa.Array:
    """escape of a whole column."""
    import pyarrow.compute as pc

    return pc.replace_substring_regex(texts, r"(\\|###|</turn>)", r"\\\1")


def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] of them, for each i in turn."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _id_type(top: int) -> str:
    """Little-endian type of ids up to the last reserved one."""
    return "<u2" if top + len(RESERVED) <= 1 << 16 else "<u4"


def segments(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Turns with their ids, as bytes: [turn] role [text] content [end].  Null text and role are empty.

    Texts are encoded in slices of bounded bytes; of a text itself only what orders it
    among turns of equal number and role is kept.
    """
    import pyarrow.compute as pc

    path = path or default_path("byte_bpe_50k.json")

    def run(batch):
        enc = PieceEncoder.of(path)
        top = enc.size
        text = batch.column("text").fill_null("")
        for whole in tv.slices(text):
            safe = _escaped(text.slice(whole.lo, len(whole)))
            for s in tv.slices(safe):
                lo, n = whole.lo + s.lo, len(s)
                role = batch.column("role").slice(lo, n).fill_null("").dictionary_encode()
                names, which = role.dictionary.to_pylist(), np.asarray(role.indices)
                heads = [np.array(enc.tok.encode(escape(r, colon=True), add_special_tokens=False).ids, np.int64) for r in names]
                ids, first = enc.encode(s)
                n_text, n_role = np.diff(first), np.array([len(h) for h in heads])[which]
                n_ids = 3 + n_role + n_text
                start = np.cumsum(n_ids) - n_ids
                flat = np.empty(int(n_ids.sum()), _id_type(top))
                flat[start], flat[start + 1 + n_role], flat[start + n_ids - 1] = top, top + 1, top + 2
                flat[_places(start + 1, n_role)] = np.concatenate([heads[i] for i in which])
                flat[_places(start + 2 + n_role, n_text)] = ids
                edges = np.append(start, len(flat)) * flat.itemsize
                chars = np.array([len(OPEN + escape(r, colon=True) + HEAD + CLOSE) for r in names])[which] + np.asarray(pc.utf8_length(safe.slice(s.lo, n)))
                own = text.slice(lo, n)
                yield {
                    "conv_id": batch.column("conv_id").slice(lo, n), "turn": batch.column("turn").slice(lo, n), "role": batch.column("role").slice(lo, n).fill_null(""), "head": pc.utf8_slice_codeunits(own, 0, HEAD_CHARS),
                    "rest": [hashlib.sha256(t.as_buffer()).digest() for t in own],
                    "ids": pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(flat)]),
                    "n_ids": n_ids, "role_ids": n_role, "n_chars": chars, "loss": pc.equal(batch.column("role").slice(lo, n).fill_null(""), "assistant"),
                }

    return arrow_map(conversations.select("conv_id", "turn", "role", "text"), run, SEGMENTS)


def assemble(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """Each turn's segment with its place: token_start, char_start, and the ids [loss_start, loss_end) under the mask.

    Turns are ordered by turn, then role and text (texts that agree in their first
    HEAD_CHARS characters by their hash); rows with a null conv_id are one conversation.
    Columns other than conv_id, turn, role and text are left out, repeated rows are turns
    of their own, an empty table gives no rows.  Places count from the conversation's start.
    """
    seg = segments(conversations, path)
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "head", "rest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = seg.withColumn("token_start", F.sum("n_ids").over(by) - F.col("n_ids")).withColumn("char_start", F.sum("n_chars").over(by) - F.col("n_chars")).drop("head", "rest")
    start = F.col("token_start") + F.col("role_ids") + 2
    return out.withColumn("loss_start", F.when(F.col("loss"), start).otherwise(F.col("token_start"))).withColumn("loss_end", F.when(F.col("loss"), F.col("token_start") + F.col("n_ids") - 1).otherwise(F.col("token_start")))


def _turns(ids: pa.Array, loss_lo: np.ndarray, loss_hi: np.ndarray, path: str):
    """(role, text, masked, ids under the mask) of each segment of a column, read from ids and spans alone.

    role and text are unescaped strings, masked the unescaped text of the masked ids.
    """
    decoder = ByteDecoder.of(path)
    top = decoder.size
    plain = lambda raw: unescape(text) if ESCAPE in (text := raw.decode("utf-8", "replace")) else text
    for s in tv.slices(ids):
        flat = np.frombuffer(s.data.tobytes(), _id_type(top)).astype(np.int64)
        start = s.offsets // (s.data.itemsize * np.dtype(_id_type(top)).itemsize)
        n = np.diff(start)
        assert (flat[start[:-1]] == top).all() and (flat[start[1:] - 1] == top + 2).all(), "segments are not whole"
        cut = np.flatnonzero(flat == top + 1)
        assert len(cut) == len(n), "segments are not whole"
        mask = loss_mask(len(flat), np.stack([start[:-1] + loss_lo[s.lo : s.hi], start[:-1] + loss_hi[s.lo : s.hi]], 1))
        data, edge = decoder.decode(flat)
        kept = np.concatenate([[0], np.cumsum(np.where(mask, np.diff(edge), 0))])
        under = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        masked = data[np.repeat(mask.astype(bool), np.diff(edge))].tobytes()
        raw = data.tobytes()
        for i, (a, c, b) in enumerate(zip(start[:-1].tolist(), cut.tolist(), start[1:].tolist(), strict=True)):
            yield plain(raw[edge[a + 1] : edge[c]]), plain(raw[edge[c + 1] : edge[b - 1]]), plain(masked[kept[a] : kept[b]]), int(under[b] - under[a])


def _in_batches(conversations: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over assembled rows in bounded batches; they come in order of conversation and place."""

    def run(batches):
        for out in fn(batches):
            yield out
            hand_back()

    bound_batches(conversations.sparkSession)
    return conversations.select("conv_id", "token_start", "char_start", "loss_start", "loss_end", "ids", "n_chars").mapInArrow(run, schema)


def render_conversations(assembled: DataFrame, path: str | None = None) -> DataFrame:
    """conv_id, char_start, formatted: the rendered turn of each segment, which stands at char_start of its conversation.

    A conversation is the pieces in order of char_start; they are left apart, as a whole
    conversation need not fit a row.
    """
    path = path or default_path("byte_bpe_50k.json")

    def run(batches):
        for b in batches:
            none = np.zeros(b.num_rows, np.int64)
            pieces = [render(role, text) for role, text, _, _ in _turns(b.column("ids"), none, none, path)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("char_start"), pa.array(pieces, pa.string())], names=["conv_id", "char_start", "formatted"])

    return _in_batches(assembled, run, "conv_id long, char_start long, formatted string")


def read_back(assembled: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each conversation from its ids and mask alone.

    Rows come from assemble, so those of a conversation follow each other in order; they
    are streamed, and a conversation of any length takes the memory of one slice.
    """
    path = path or default_path("byte_bpe_50k.json")
    names = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64())]
    kind = pa.schema(names)

    def run(batches):
        done: list[tuple] = []
        key, state = None, None
        width = np.dtype(_id_type(ByteDecoder.of(path).size)).itemsize

        def end():
            if state:
                done.append((key, state["n"], state["turns"].hexdigest(), state["loss"], state["loss_sha"].hexdigest(), state["chars"], state["at"], state["masked"]))

        def ready():
            out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, (_, t) in enumerate(names)], schema=kind)
            done.clear()
            return out

        for b in batches:
            at, char, lo, hi = (np.asarray(b.column(c)) for c in ("token_start", "char_start", "loss_start", "loss_end"))
            n = np.asarray(pc.binary_length(b.column("ids"))) // width
            rows = zip(b.column("conv_id").to_pylist(), at.tolist(), char.tolist(), n.tolist(), strict=True)
            for (conv, place, piece, size), (role, text, masked, under) in zip(rows, _turns(b.column("ids"), lo - at, hi - at, path), strict=True):
                if state is None or conv != key or place == 0:
                    end()
                    key, state = conv, {"n": 0, "turns": hashlib.sha256(), "loss": 0, "loss_sha": hashlib.sha256(), "chars": 0, "at": 0, "masked": 0}
                assert place == state["at"] and piece == state["chars"], "segments are not in order"
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["loss_sha"].update(masked.encode())
                state["n"] += 1
                state["loss"] += len(masked)
                state["chars"] += len(render(role, text))
                state["at"] += size
                state["masked"] += under
            if len(done) > 5000:
                yield ready()
        end()
        yield ready()

    import pyarrow.compute as pc

    return _in_batches(assembled, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


def loss_mask(n_ids: int, spans: np.ndarray) -> np.ndarray:
    """0/1 mask of n_ids ids by a prefix sum over the edges of spans that do not overlap."""
    edges = np.zeros(n_ids + 1, np.int64)
    np.add.at(edges, np.asarray(spans)[:, 0], 1)
    np.add.at(edges, np.asarray(spans)[:, 1], -1)
    return np.cumsum(edges)[:-1].astype(np.uint8)


def format_conversations(conversations: DataFrame, path: str | None = None) -> DataFrame:
    return read_back(assemble(conversations, path), path)
