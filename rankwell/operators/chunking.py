"""Chunkers: pages (document_id, page_number, text) to chunks, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.functions import text as T

KEYS = ["document_id", "page_number"]


def pages_of(documents: DataFrame) -> DataFrame:
    """documents as one-page documents."""
    return documents.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("document_id"), F.lit(1).alias("page_number"), "text")


def cuts(text: Column, width: int, step: int) -> Column:
    """(offset, text) of each stretch of a text, blank ones too."""
    at = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.transform(at, lambda i: F.struct(i.alias("offset"), F.substr(text, i + 1, F.lit(width)).alias("text")))


def _cut(pages: DataFrame, width: int, step: int) -> DataFrame:
    return pages.select(*KEYS, F.posexplode(cuts(F.col("text"), width, step)).alias("ordinal", "c")).select(*KEYS, "ordinal", "c.offset", "c.text").where(F.trim("text") != "")


def _page_id(suffix: Column) -> Column:
    return F.concat(F.col("document_id"), F.lit("_p"), F.col("page_number"), suffix).alias("chunk_id")


def fixed(pages: DataFrame, width: int = 512, by_ordinal: bool = False) -> DataFrame:
    """Non-overlapping chunks, named by offset (and stripped) or by ordinal (as they are)."""
    c = _cut(pages, width, width)
    if by_ordinal:
        return c.select(*KEYS, _page_id(F.concat(F.lit("_c"), F.col("ordinal"))), "text")
    return c.select(*KEYS, _page_id(F.concat(F.lit("_c"), F.col("offset"))), F.trim("text").alias("text"))


def overlapping(pages: DataFrame, width: int = 512, step: int = 448) -> DataFrame:
    return _cut(pages, width, step).select(*KEYS, _page_id(F.concat(F.lit("_c"), F.col("offset"))), "text")


def sentence_windows(pages: DataFrame, w: int = 3) -> DataFrame:
    """A node for each sentence with the sentences around it, within its page.

    Windows are made inside the row before it is exploded, so no row carries all sentences.
    """
    s = F.col("s")
    lo = lambda i: F.greatest(i - w, F.lit(0))
    hi = lambda i: F.least(i + w, F.size(s) - 1)
    node = lambda x, i: F.struct(i.alias("sentence_index"), x.alias("anchor_text"), F.array_join(F.slice(s, lo(i) + 1, hi(i) - lo(i) + 1), " ").alias("window_text"), lo(i).alias("lo"), hi(i).alias("hi"))
    n = pages.select(*KEYS, T.sentences(F.col("text")).alias("s")).select(*KEYS, F.explode(F.transform(s, node)).alias("n"))
    return n.select(*KEYS, _page_id(F.concat(F.lit("_s"), F.col("n.sentence_index"))), "n.*")


def sentence_anchors(pages: DataFrame) -> DataFrame:
    s = pages.select(*KEYS, F.posexplode(T.sentences(F.col("text"))).alias("i", "text"))
    return s.select(*KEYS, _page_id(F.concat(F.lit("_s"), F.col("i"), F.lit("_anchor"))), F.col("i").alias("sentence_index"), "text")


def hierarchy(pages: DataFrame, sizes: tuple[int, ...] = (1024, 512, 256)) -> DataFrame:
    """Nodes of nested token chunks: node_id, level (0 the largest), parent_id, text, in one pass over the pages.

    Tokens are runs of non-blanks.  A child's id is its parent's and its ordinal in it.
    """
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    tree = pages.select(*KEYS, F.concat("document_id", F.lit("_p"), "page_number").alias("id"), words.alias("w")).where(F.size("w") > 0)

    def cut(up: Column, w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(n)), lambda i, k: F.struct(up.alias("up"), F.concat(up, F.lit("/"), k.cast("string")).alias("id"), F.slice(w, i + 1, n).alias("w")))

    tree = tree.select(*KEYS, cut(F.col("id"), F.col("w"), sizes[0]).alias("l0"))
    below = lambda size: lambda p: cut(p["id"], p["w"], size)
    for depth, size in enumerate(sizes[1:], 1):  # each level is cut from the one above, in the row
        tree = tree.withColumn(f"l{depth}", F.flatten(F.transform(f"l{depth - 1}", below(size))))
    node = lambda d: F.transform(f"l{d}", lambda p: F.struct(p["id"].alias("node_id"), F.lit(d).alias("level"), (F.lit(None).cast("string") if d == 0 else p["up"]).alias("parent_id"), F.array_join(p["w"], " ").alias("text")))
    return tree.select(*KEYS, F.explode(F.concat(*[node(d) for d in range(len(sizes))])).alias("n")).select(*KEYS, "n.*")


def hierarchy_nodes(nodes: DataFrame) -> DataFrame:
    """Adds running offsets in reading order of each level, fingerprint and estimated tokens."""
    by = Window.partitionBy("document_id", "level").orderBy("page_number", F.length("node_id"), "node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("text")).over(by)
    return nodes.select("*", (end - F.length("text")).alias("char_start"), end.alias("char_end"), F.substring(F.sha2("text", 256), 1, 16).alias("fingerprint"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int").alias("token_count"))


def passages(pages: DataFrame, least: int = 50) -> DataFrame:
    """One passage a page (the segmentation pattern swallows blank lines), with its id and offsets."""
    t = F.trim("text")
    p = pages.select(*KEYS, t.alias("text"), F.lit(0).alias("start_char"), F.length(t).alias("end_char"), F.sha2(t, 256).alias("content_sha256")).where(F.col("text") != "")
    return p.withColumn("passage_id", T.passage_id(F.col("document_id"), F.col("page_number"), F.col("start_char"), F.col("end_char"), F.col("content_sha256"))).withColumn("is_short", F.length("text") < least)


def token_chunks(pages: DataFrame, width: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of width tokens (runs of non-blanks) that share overlap with the one before; a rest that is all overlap is none."""
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    step = width - overlap
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1 - overlap), F.lit(step))
    c = pages.select(*KEYS, words.alias("w")).where(F.size("w") > 0)
    parts = F.transform(at, lambda i: F.struct(i.alias("first_token"), F.array_join(F.slice("w", i + 1, width), " ").alias("text")))
    return c.select(*KEYS, F.explode(parts).alias("c")).select(*KEYS, _page_id(F.concat(F.lit("_t"), F.col("c.first_token"))), "c.text")


def as_pages(chunks: DataFrame) -> DataFrame:
    """Chunks that may span pages (document_id, chunk_id, start_page, text) as pages: the start page counts."""
    return chunks.select("document_id", F.col("start_page").alias("page_number"), "chunk_id", "text")
