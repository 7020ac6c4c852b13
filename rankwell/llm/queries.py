"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.llm import chat, decontam, htmltext, langid, minhash, packing, pii, prefixtrie, quality, rolling, suffixes, tokenout, warc
from rankwell.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.format_conversations(chat.with_control_case(table(spark, sf_dir, "conversations")))
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.replace_entities(table(spark, sf_dir, "documents"), pii.session_key(spark))
    return done.select("doc_id", "text", "n_chars", "n_entities", F.concat_ws(",", "kinds").alias("kinds"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.token_output(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32", "found")


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = lambda: F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    found = langid.identify(docs, langid.train(docs.where(~held())))
    return found.select("doc_id", held().alias("held_out"), "lang_pred", "score")


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.page_responses(table(spark, sf_dir, "pages"), position=warc.source_position())).withColumnRenamed("key", "page_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.flag_clicks(table(spark, sf_dir, "clicks"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_chat_format, op2_decontamination, op3_packing, op4_pii_surrogates, op5_near_dedup, op6_token_shards, op7_page_text, op8_quality_rules, op9_language_id, op10_warc_derivatives, op11_prefix_trie, op12_rolling_median, op13_repeated_passages, pipeline)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *,
    replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS etext,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS erole
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || erole || ': ' || etext || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes)
),
hits AS (SELECT doc_id, i, dw.n, item FROM dw JOIN win ON dw.win = win.win AND dw.n = win.n),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""",
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda u, z: xor(u >> 1, 3988292384 * (u & 1))))) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT k.c, pos, role, text FROM k JOIN t ON t.c = k.c - k.c % 20 AND pos <= h
  UNION ALL SELECT k.c, pos, role, text FROM k JOIN t ON t.c = k.c AND pos > h
), s AS (
  SELECT k.c, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS seq,
    list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY pos) FILTER (pos IS NOT NULL) AS w
  FROM k LEFT JOIN r USING (c) GROUP BY k.c
), n AS (
  SELECT list_slice(seq, 1, d) AS node, d, min(c) AS c, count(*) AS n, coalesce(any_value(w[d]), 0) AS words,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = len(seq)), '')) AS ends
  FROM (SELECT c, seq, w, unnest(range(0, len(seq) + 1)) AS d FROM s) GROUP BY 1, 2
), kids AS (
  SELECT list_slice(node, 1, d - 1) AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1
), f AS (
  SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN kids USING (node)
), below AS (
  SELECT list_slice(node, 1, i) AS node, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * words) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM f) GROUP BY 1
)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.kids AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN below USING (node) LEFT JOIN n AS p ON f.d > 0 AND p.node = list_slice(f.node, 1, f.d - 1)
""",
    "op12_rolling_median": """
WITH one AS (
  SELECT click_id, min(struct_pack(ts, kind, cents := CAST(floor(100 * value + 0.5) AS BIGINT))) AS r
  FROM clicks WHERE ts IS NOT NULL GROUP BY click_id
), p AS (
  SELECT click_id, r.kind AS kind, r.cents AS cents,
    list(r.cents) FILTER (r.cents IS NOT NULL) OVER (PARTITION BY r.kind ORDER BY r.ts RANGE BETWEEN INTERVAL 360 MINUTES PRECEDING AND CURRENT ROW) AS w
  FROM one
), m AS (
  SELECT click_id, kind, cents, w, CAST(coalesce(len(w), 0) AS BIGINT) AS n,
    CASE WHEN len(w) >= 5 THEN list_sort(w)[(len(w) + 1) // 2] + list_sort(w)[len(w) // 2 + 1] END AS median2 FROM p
), d AS (
  SELECT *, CASE WHEN n >= 5 THEN list_sort(list_transform(w, lambda x: abs(2 * x - median2))) END AS d FROM m
)
SELECT click_id, kind, n, median2, d[(n + 1) // 2] + d[n // 2 + 1] AS mad4,
  2 * abs(2 * cents - median2) > 5 * (d[(n + 1) // 2] + d[n // 2 + 1]) AS far
FROM d
""",
}
