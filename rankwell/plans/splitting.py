"""Queries on sentence-aware splits; the twins join pieces by a recursion over their starts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import chunking as C
from rankwell.operators import splitting as S
from rankwell.plans.base import read, register
from rankwell.plans.frames import _ABBR

#: Texts of the table as they are, with paragraphs, abbreviations, a sentence without full stops and blanks of every kind.
_TEXT = """CASE doc_id % 4 WHEN 0 THEN 'See e.g. this.  O Dr. Silva, a SRA. Costa; Fig. 2! ' || text WHEN 1 THEN replace(text, chr(10), chr(10) || chr(10) || chr(10))
  WHEN 2 THEN replace(replace(text, '.', ''), ' a', ', a') ELSE '  ' || replace(text, '. ', '.  ') || ' ' END"""
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _prose(spark, d):
    text = F.col("text")
    lead = F.concat(F.lit("See e.g. this.  O Dr. Silva, a SRA. Costa; Fig. 2! "), text)
    flat = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(" a"), F.lit(", a"))
    loose = F.concat(F.lit("  "), F.replace(text, F.lit(". "), F.lit(".  ")), F.lit(" "))
    k = F.col("doc_id") % 4
    return C.pages_of(read(spark, d, "documents").withColumn("text", F.when(k == 0, lead).when(k == 1, F.replace(text, F.lit("\n"), F.lit("\n\n\n"))).when(k == 2, flat).otherwise(loose)))


def _split_sql(name: str, source: str, size: int, overlap: int) -> str:
    """CTEs that split source (id, text) into name (id, k, first, n, text)."""
    n = lambda x: f"len(regexp_extract_all({x}, '\\S+'))"
    sent = f"regexp_replace(regexp_replace(trim(p, {_TRIM}), '{_ABBR}', '\\1\\2.' || chr(2), 'g'), '{_ABBR}', '\\1\\2.' || chr(2), 'g')"
    return f"""
{name}_p AS (SELECT id, i, p, {n('p')} AS n FROM (SELECT id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM (
  SELECT id, CASE WHEN {n('text')} <= {size} THEN [text] ELSE string_split(text, chr(10) || chr(10) || chr(10)) END AS ps FROM {source}))),
{name}_s AS (SELECT id, i, j, s, {n('s')} AS n FROM (SELECT id, i, unnest(range(len(ss))) AS j, unnest(ss) AS s FROM (
  SELECT id, i, CASE WHEN n <= {size} THEN [p] ELSE list_transform(string_split(regexp_replace({sent}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: replace(x, chr(2), ' ')) END AS ss FROM {name}_p))),
{name}_c AS (SELECT id, i, j, l, c, {n('c')} AS n FROM (SELECT id, i, j, unnest(range(len(cs))) AS l, unnest(cs) AS c FROM (
  SELECT id, i, j, CASE WHEN n <= {size} THEN [s] ELSE string_split(regexp_replace(s, '([,.;。？！])\\s+', '\\1' || chr(1), 'g'), chr(1)) END AS cs FROM {name}_s))),
{name}_w AS (SELECT id, i, j, l, m, CASE WHEN n <= {size} THEN n ELSE 1 END AS n FROM (SELECT *, unnest(range(CASE WHEN n = 0 THEN 0 WHEN n <= {size} THEN 1 ELSE n END)) AS m FROM {name}_c)),
{name}_e AS (SELECT id, i, j, l, m, n, sum(n) OVER (PARTITION BY id ORDER BY i, j, l, m) AS e FROM {name}_w),
{name}_l AS (SELECT id, list(e - n ORDER BY e) AS starts, list(e ORDER BY e) AS ends FROM {name}_e GROUP BY id),
{name}_r AS (
  SELECT id, starts, ends, 0 AS k, CAST(0 AS HUGEINT) AS first, len(list_filter(ends, lambda x: x <= {size})) AS upto FROM {name}_l
  UNION ALL
  SELECT id, starts, ends, k + 1, f, len(list_filter(ends, lambda x: x - f <= {size})) FROM (
    SELECT *, list_min(list_filter(starts, lambda x: x >= greatest(starts[upto + 1] - {overlap}, ends[upto + 1] - {size}))) AS f FROM {name}_r WHERE upto < len(ends))),
{name} AS (SELECT r.id, r.k, CAST(r.first AS INTEGER) AS first, CAST(ends[upto] - r.first AS INTEGER) AS n,
  regexp_replace(array_to_string(regexp_extract_all(t.text, '\\S+\\s*')[r.first + 1 : ends[upto]], ''), '\\s+$', '') AS text FROM {name}_r r JOIN {source} t USING (id))"""


_PAGES = f"pg AS (SELECT concat('doc_', doc_id, '_p1') AS id, {_TEXT} AS text FROM documents WHERE text IS NOT NULL)"


def _tree_sql(sizes: tuple[int, ...], overlap: int) -> str:
    parts, source = [], "pg"
    for d, size in enumerate(sizes):
        parts += [_split_sql(f"t{d}", source, size, overlap), f"n{d} AS (SELECT concat(id, '/', k) AS id, id AS up, k, first, n, text FROM t{d})"]
        source = f"n{d}"
    rows = " UNION ALL ".join(f"SELECT id AS node_id, {d} AS level, {'NULL' if d == 0 else 'up'} AS parent_id, k, first, n, text FROM n{d}" for d in range(len(sizes)))
    return f"WITH RECURSIVE {_PAGES}, {', '.join(parts)}, nodes AS ({rows})"


@register("chk07_sentence_split", f"WITH RECURSIVE {_PAGES}, {_split_sql('t', 'pg', 512, 64)} SELECT concat(id, '_n', k) AS chunk_id, first AS first_token, n AS n_tokens, text FROM t")
def chk07_split(spark, d):
    """The notebook's baseline: 512 tokens, 64 of overlap."""
    return S.split(_prose(spark, d)).select("chunk_id", "first_token", "n_tokens", "text")


@register("chk07_sentence_tree", f"{_tree_sql((1024, 512, 256), 20)} SELECT node_id, CAST(level AS INTEGER) AS level, parent_id, CAST(k AS INTEGER) AS ordinal, first AS first_token, n AS n_tokens, text FROM nodes")
def chk07_tree(spark, d):
    return S.tree(_prose(spark, d)).select("node_id", "level", "parent_id", "ordinal", "first_token", "n_tokens", "text")


@register("chk07_notebook_tree", f"{_tree_sql((2048, 768, 256), 20)} SELECT CAST(level AS INTEGER) AS level, count(*) AS n, CAST(sum(n) AS BIGINT) AS tokens, count(DISTINCT parent_id) AS parents FROM nodes GROUP BY level")
def chk07_notebook(spark, d):
    """Sizes of the notebook's tree, by level; tokens shared by neighbours count for each."""
    n = S.tree(_prose(spark, d), (2048, 768, 256), texts=False)
    return n.groupBy("level").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"), F.count_distinct("parent_id").alias("parents"))
