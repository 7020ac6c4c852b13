"""Chunks and the passages of their page: texts are not multiplied by their chunks, and blanks are compared collapsed."""

import re

from rankwell.operators import mapping
from rankwell.plans import registry


def plain(pages, width, step):
    """Holders in plain Python, by pairs of rows of one page."""
    out, flat = {}, lambda s: re.sub(r"\s+", " ", s, flags=re.ASCII).strip(" ")
    for doc, page, text in pages:
        for o in range(0, max(len(text or ""), 1), step):
            c = (text or "")[o : o + width]
            wholes = [t.strip(" ") for d, p, t in pages if (d, p) == (doc, page) and t is not None and t.strip(" ")]
            if c.strip(" ") and wholes:
                out[doc, o] = out.get((doc, o), 0) + sum(c in w or w in c or flat(c) in flat(w) or flat(w) in flat(c) for w in wholes)
    return sorted((*k, v) for k, v in out.items())


def test_holders_of_odd_pages(spark):
    pages = [("a", 1, "  one  two\n three   " * 9), ("a", 1, "one two three " * 12), ("a", 2, "alone"), ("b", 1, None), ("c", 1, "   "), ("d", 1, ""), ("e", 1, "x" * 70 + " " * 40 + "y" * 70), ("a", 1, None), ("f", 1, "é\t" * 50)]
    df = spark.createDataFrame(pages, "document_id string, page_number int, text string")
    got = mapping.holders(df, df.withColumn("text", mapping.F.trim("text")).where("text != ''"), 30, 20)
    assert sorted(tuple(r) for r in got.collect()) == plain(pages, 30, 20)


def test_pages_are_cut_after_the_join(spark):
    plan = registry.QUERIES["jon04_page_containment"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
