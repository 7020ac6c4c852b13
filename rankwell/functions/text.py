"""Column functions on text: normalisation, sentences, tokens, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations after which a sentence goes on, whatever their case, as patterns. Fixed values.
ABBREVIATIONS = [r"e\.g", r"i\.e", "ex", "pág", "pag", "fig", "cap", "tab", "vs", "art", "sec", "seção", "vol", "dr", "prof", "sr", "sra", "pp", "nº"]
PASSAGE_PREFIX = "ps_"


def normalize_whitespace(t: Column) -> Column:
    """Rejoins hyphenated line ends, collapses blanks and tabs, drops empty lines."""
    joined = F.regexp_replace(t, r"(?i)([a-zà-ÿ])-\s*\n\s*([a-zà-ÿ])", "$1$2")
    lines = F.transform(F.split(F.regexp_replace(joined, r"[ \t]+", " "), "\n"), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def sentences(t: Column, abbreviations: list[str] | None = None) -> Column:
    """Sentences of a text, trimmed; one that would end with an abbreviation goes on after a single blank."""
    mark = "\uffff"  # no character of any text
    known = r"((?iU)\b(?:" + "|".join(abbreviations or ABBREVIATIONS) + r")\.)" + mark
    ends = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"([.!?])\s+", "$1" + mark)
    pieces = F.split(F.regexp_replace(ends, known, "$1 "), mark)
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")


def tokens(t: Column, longer_than: int = 3) -> Column:
    """Distinct lower-case tokens of more than a few characters."""
    return F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda x: F.length(x) > longer_than))


def passage_id(doc: Column, page: Column, start: Column, end: Column, sha: Column) -> Column:
    return F.concat(F.lit(PASSAGE_PREFIX), F.substring(F.sha2(F.concat_ws(":", doc, page.cast("string"), start.cast("string"), end.cast("string"), sha), 256), 1, 16))
