"""Derivatives of WARC responses: linked metadata and plain-text conversion records.

Each response gives a metadata record (what its source said: HTTP headers, digest, title,
number of links) and a conversion record (its text).  Both refer to the response and keep
its target, date, source headers and payload digest; identifiers are derived from the
response's, so a repeated run gives the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm.common import arrow_map
from rankwell.llm.htmltext import ATTRIBUTES

SPACE = re.compile(r"[ \t\r\f\v]+")
SILENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|head)\b" + ATTRIBUTES + r"(?:>|\Z).*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b" + ATTRIBUTES + r"(?:>|\Z)", re.I)
TAG = re.compile(r"<[!/?a-zA-Z]" + ATTRIBUTES + r"(?:>|\Z)")
TITLE = re.compile(r"<title\b" + ATTRIBUTES + r">(.*?)</title\s*>", re.S | re.I)
LINK = re.compile(r"<a\b(?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?)*?\shref\s*=", re.I)
LINES = re.compile(r"\s*\n\s*")
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RESPONSES = "key long, record_id string, target_uri string, warc_date string, http_headers string, payload binary"
RECORDS = "key long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, payload_digest string, block_digest string, content_length long, http_headers string, block string"


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def urn(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, chr(31).join(parts))}>"


def page_text(page: str) -> str:
    """All visible text, one block to a line."""
    text = TAG.sub("", BREAK.sub("\n", SILENT.sub(" ", page)))
    return LINES.sub("\n", SPACE.sub(" ", html.unescape(text))).strip()


def page_responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", position: Column | None = None) -> DataFrame:
    """Response records of pages(page_id, url, html): null html is an empty payload, null url an empty target.

    position tells rows apart that are equal otherwise (source_position of a table that is
    read from files), so each record has an id of its own; without it equal rows have one id.
    """

    def run(batch):
        out = {c: [] for c in ("key", "record_id", "target_uri", "warc_date", "http_headers", "payload")}
        for key, url, page, at in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "position")), strict=True):
            raw = (page or "").encode()
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(raw)}\r\n\r\n"
            for c, v in zip(out, (key, urn("response", str(key), url or "", digest(raw), at or ""), url or "", date, head, raw), strict=True):
                out[c].append(v)
        yield out

    return arrow_map(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", (F.lit("") if position is None else position).alias("position")), run, RESPONSES)


def source_position() -> Column:
    """File and row of a table that is read from files: the same on every run, however the files are split."""
    return F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))


def derive(responses: DataFrame) -> DataFrame:
    """Two records of each response.  payload_digest is the source's.

    Payloads that are no text (or null) convert to what their decodable bytes say; one
    response's records are as unique as its id, and a response without an id is named by
    its target, date and headers besides its digest.  Further columns are left out, an
    empty table gives no records.
    """

    def run(batch):
        rows = []
        for key, rid, uri, date, head, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "record_id", "target_uri", "warc_date", "http_headers", "payload")), strict=True):
            raw = raw or b""
            source = digest(raw)
            charset = re.search(r"charset=[\"']?([\w.-]+)", head or "", re.I)
            try:
                page = raw.decode(charset[1] if charset else "utf-8", "replace")
            except LookupError:
                page = raw.decode("utf-8", "replace")
            title = TITLE.search(page)
            status, _, fields = (head or "").partition("\r\n")
            meta = [("via", rid or ""), ("http-status", status)]
            meta += [(f"http-{k.strip().lower()}", v.strip()) for k, c, v in (x.partition(":") for x in fields.split("\r\n")) if c]
            meta += [("title", " ".join(html.unescape(title[1]).split()) if title else ""), ("outlinks", str(len(LINK.findall(page))))]
            for kind, content, block in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in meta)), ("conversion", "text/plain; charset=utf-8", page_text(page))):
                b = block.encode("utf-8", "replace")
                rows.append((key, kind, urn(kind, rid or "", source) if rid else urn(kind, "", uri or "", date or "", head or "", source), rid, uri, date, content, source, digest(b), len(b), head, b.decode()))
        names = [x.split()[0] for x in RECORDS.split(", ")]
        yield {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return arrow_map(responses.select(*[x.split()[0] for x in RESPONSES.split(", ")]), run, RECORDS)


def record_bytes(r) -> bytes:
    """A record as WARC/1.1 bytes, one gzip member."""
    head = {
        "WARC-Type": r["warc_type"], "WARC-Record-ID": r["record_id"], "WARC-Refers-To": r["refers_to"], "WARC-Target-URI": r["target_uri"], "WARC-Date": r["warc_date"],
        "WARC-Payload-Digest": r["payload_digest"], "WARC-Block-Digest": r["block_digest"], "X-Source-HTTP-Headers": base64.b64encode((r["http_headers"] or "").encode()).decode(),
        "Content-Type": r["content_type"], "Content-Length": str(r["content_length"]),
    }
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None) + "\r\n"
    return gzip.compress(raw.encode() + (r["block"] or "").encode() + b"\r\n\r\n", 6, mtime=0)


def parse_records(raw: bytes):
    """Headers (dict) and block (bytes) of each record of a WARC file, gzipped or not."""
    file = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BufferedReader(io.BytesIO(raw))
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while (line := file.readline().rstrip(b"\r\n")):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip()] = v.strip()
        yield head, file.read(int(head.get("Content-Length", 0)))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, a file to a task."""

    def run(batch):
        out = {c: [] for c in ("key", "record_id", "target_uri", "warc_date", "http_headers", "payload")}
        for raw in batch.column("content"):
            for head, block in parse_records(raw.as_py()):
                if head.get("WARC-Type") == "response":
                    http, _, payload = block.partition(b"\r\n\r\n")
                    for c, v in zip(out, (None, head.get("WARC-Record-ID"), head.get("WARC-Target-URI"), head.get("WARC-Date"), http.decode("latin-1") + "\r\n\r\n", payload), strict=True):
                        out[c].append(v)
        yield out

    return arrow_map(spark.read.format("binaryFile").load(path).select("content"), run, RESPONSES)


def write_records(records: DataFrame, folder: str) -> DataFrame:
    """Writes a .warc.gz file for each partition below a shared folder; returns (path, n)."""
    kind = pa.schema([("path", pa.string()), ("n", pa.int64())])

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, n = f"{base}/derived-{task.partitionId():06d}.warc.gz", 0
        with store.open_output_stream(f"{name}.{task.taskAttemptId()}", compression=None) as out:
            for b in batches:
                for r in b.to_pylist():
                    out.write(record_bytes(r))
                    n += 1
        store.move(f"{name}.{task.taskAttemptId()}", name)
        yield pa.RecordBatch.from_pydict({"path": [name], "n": [n]}, schema=kind)

    return records.mapInArrow(run, "path string, n long")
