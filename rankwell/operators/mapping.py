"""Mapping chunks to canonical passages by six rules in order, and candidates to canonical records.

chunks: chunk_id, document_id, page_number, text and, where known, passage_id, start_char,
end_char, content_sha256.  passages: passage_id, document_id, page_number, start_char,
end_char, content_sha256, text, registry_pos (their order).  All rules but containment are
equi joins on aggregated keys; containment looks at the passages of the chunk's own page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.operators.chunking import KEYS, cuts

UNMAPPED = "UNMAPPED_NEEDS_REVIEW"
SECRET = r"(?i)(api[_-]?key|authorization|bearer|password|secret|token)\s*[:=]"


def collapsed(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def contains_either(a: Column, b: Column, flat: Column | None = None) -> Column:
    """One of two texts holds the other, as they are or with blanks collapsed; flat is the second one collapsed, if known.

    Spark evaluates what occurs twice in a row beforehand, so a long text that meets many rows should be collapsed before.
    """
    x, y = collapsed(a), collapsed(b) if flat is None else flat
    return F.contains(a, b) | F.contains(b, a) | F.contains(x, y) | F.contains(y, x)


def holders(pages: DataFrame, passages: DataFrame, width: int, step: int) -> DataFrame:
    """document_id, chunk (its offset), holders: passages of the page that hold a chunk of it or are held by it.

    Pages meet passages whole and are cut in the row, so that no text travels with each chunk
    and blanks of a passage are collapsed once.
    """
    both = pages.select(*KEYS, "text").join(passages.select(*KEYS, F.col("text").alias("whole")), KEYS)
    parts = F.filter(cuts(F.col("text"), width, step), lambda c: F.trim(c["text"]) != "")
    held = lambda w: F.transform(parts, lambda c: F.struct(c["offset"].alias("chunk"), contains_either(c["text"], w["whole"], w["flat"]).alias("hit")))
    bound = F.array(F.struct("whole", collapsed(F.col("whole")).alias("flat")))
    each = both.select("document_id", F.explode(F.get(F.transform(bound, held), F.lit(0))).alias("c"))
    return each.groupBy("document_id", "c.chunk").agg(F.count_if("c.hit").alias("holders"))


def map_chunks(chunks: DataFrame, passages: DataFrame) -> DataFrame:
    """chunk_id, passage_id, status, confidence: one row for each chunk.

    By passage id, then document, page and offsets, then a text hash that only one passage
    has; then the one passage of the page that holds the chunk or is held by it (0.9), a
    chunk without text takes the page's only passage (0.85), several are ambiguous and the
    first counts (0.5).
    """
    first = F.min(F.struct("registry_pos", "passage_id"))["passage_id"]
    by_id = passages.select(F.col("passage_id").alias("known")).distinct()
    by_place = passages.groupBy("document_id", "page_number", "start_char", "end_char").agg(first.alias("by_place"))
    by_sha = passages.groupBy(F.col("content_sha256").alias("sha")).agg(first.alias("by_sha"), F.count("*").alias("of_sha")).where("of_sha = 1").drop("of_sha")
    text = F.trim(F.coalesce("text", F.lit("")))
    c = chunks.withColumn("text", text).withColumn("asked", F.coalesce("passage_id", "chunk_id")).withColumn("sha", F.coalesce("content_sha256", F.when(F.col("text") != "", F.sha2("text", 256))))
    c = c.join(by_id, F.col("asked") == F.col("known"), "left").join(by_place, ["document_id", "page_number", "start_char", "end_char"], "left").join(by_sha, "sha", "left")
    sure = F.coalesce("known", F.when(F.col("page_number") > 0, F.col("by_place")), "by_sha")
    status = F.when(F.col("known").isNotNull(), "EXACT_PASSAGE_ID").when((F.col("page_number") > 0) & F.col("by_place").isNotNull(), "EXACT_OFFSETS").otherwise("EXACT_CONTENT_SHA256")
    c = c.withColumn("sure", sure).select("chunk_id", "document_id", "page_number", "text", "sure", status.alias("rule"))
    done = c.where("sure is not null").select("chunk_id", F.col("sure").alias("passage_id"), F.col("rule").alias("status"), F.lit(1.0).alias("confidence"))
    # only what no equality settled is compared with its page's passages
    p = passages.select("document_id", "page_number", F.col("text").alias("whole"), collapsed(F.col("text")).alias("flat"), F.struct("registry_pos", "passage_id").alias("p"))
    open_ = c.where("sure is null").join(p, ["document_id", "page_number"], "left")
    hit = (F.col("text") != "") & contains_either(F.col("text"), F.col("whole"), F.col("flat")) & (F.col("page_number") > 0)
    g = open_.groupBy("chunk_id", "text").agg(F.count("p").alias("of_page"), F.min("p").alias("only"), F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("p"))).alias("best"))
    lone = (F.col("text") == "") & (F.col("of_page") == 1)
    found = F.when(F.col("n") > 0, F.col("best.passage_id")).when(lone, F.col("only.passage_id"))
    word = F.when((F.col("n") == 1) | lone, "EXACT_SUBSTRING").when(F.col("n") > 1, "AMBIGUOUS_NEEDS_REVIEW").otherwise(UNMAPPED)
    sureness = F.when(F.col("n") == 1, 0.9).when(lone, 0.85).when(F.col("n") > 1, 0.5).otherwise(0.0)
    return done.unionByName(g.select("chunk_id", found.alias("passage_id"), word.alias("status"), sureness.alias("confidence")))


def redacted(text: Column, most: int = 80) -> Column:
    return F.when(text.rlike(SECRET), "[REDACTED]").otherwise(F.substring(text, 1, most))


def canonical_records(candidates: DataFrame, mapped: DataFrame, qrels: DataFrame) -> DataFrame:
    """Candidates (qid, rank, chunk_id, text) as records: evidence id, passage or the sentinel, judgement, hash, preview."""
    j = candidates.join(mapped, "chunk_id", "left").join(qrels.select("qid", "passage_id", "grade"), ["qid", "passage_id"], "left")
    return j.select(
        "qid", F.concat(F.lit("E"), "rank").alias("evidence_id"), "chunk_id", F.coalesce("passage_id", F.lit(UNMAPPED)).alias("passage_id"), "status",
        F.when(F.col("passage_id").isNull(), "UNMAPPED").when(F.col("grade").isNull(), "UNJUDGED").otherwise("JUDGED").alias("judged"), F.coalesce("grade", F.lit(0)).alias("grade"),
        F.sha2("text", 256).alias("content_sha256"), redacted(F.col("text")).alias("preview"),
    )


PAGE = r"(?i)(?:_p|page_|^p|page)([0-9]+)"


def page_of(chunk_id: Column, explicit: Column) -> tuple[Column, Column]:
    """(page, error) from an explicit number and the one in an id; both known and different is an error."""
    raw = F.regexp_extract(chunk_id, PAGE, 1)
    own = F.expr("try_cast(NULL AS int)") if raw is None else F.when(raw != "", raw.try_cast("int"))
    own = F.when(own >= 1, own)
    known = F.when(explicit >= 1, explicit)
    clash = known.isNotNull() & own.isNotNull() & (known != own)
    return F.when(~clash, F.coalesce(known, own)), F.when(clash, "PAGE_NUMBER_MISMATCH")
