"""Queries that look into nested records and whole texts: ids, blinding, forbidden keys, leakage.

Records are made of the shop's property texts, some of them broken, and of values that a digest
of the row's id picks, so that kinds, depths and spellings mix.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import filters as G
from rankwell.operators import walker as W
from rankwell.plans.base import read, register
from rankwell.sources import sinks

#: JSON values under id keys, by a hex digit; {h} is the row's digest, {k} its kind.
_VALUES = {
    "0123": '"ps_{h}"', "4": '"ps_{h}_rank3"', "5": '"doc_p3"', "6": "null", "7": "12", "8": '"UNMAPPED_NEEDS_REVIEW"', "9": '""', "a": '{{"passage_id": "ps_x"}}',
    "b": '["ps_1"]', "cd": '"ps_{k} \\"é\\u00e9"', "e": '"PS_{h}"', "f": "true",
}


def _picked(h, k, at: int):
    """The value that the digest's hex digit at a place picks."""
    out = None
    for digits, value in _VALUES.items():
        before, _, after = value.replace("{{", "{").replace("}}", "}").replace("{k}", "\0k\0").replace("{h}", "\0h\0").partition("\0")
        col = F.lit(before)
        if after:
            name, _, rest = after.partition("\0")
            col = F.concat(col, {"h": F.substring(h, 1, 8), "k": k}[name], F.lit(rest))
        hit = F.substring(h, at, 1).isin(*digits)
        out = F.when(hit, col) if out is None else out.when(hit, col)
    return out


def _picked_sql(at: int) -> str:
    parts = []
    for digits, value in _VALUES.items():
        text = "'" + value.replace("{{", "{").replace("}}", "}").replace("{h}", "' || substr(h, 1, 8) || '").replace("{k}", "' || k || '") + "'"
        parts.append(f"WHEN substr(h, {at}, 1) IN ({', '.join(repr(x) for x in digits)}) THEN {text}")
    return f"CASE {' '.join(parts)} END"


def _artefacts(spark, d):
    """click_id, artefact: nested results as JSON, around the properties of each click."""
    c = read(spark, d, "clicks").dropDuplicates(["click_id"]).select("click_id", "props", F.coalesce("kind", F.lit("none")).alias("k"), F.md5(F.col("click_id").cast("string").cast("binary")).alias("h"))
    pick = lambda at: _picked(F.col("h"), F.col("k"), at)
    key = F.when(F.substring("h", 4, 1) < "8", "passage_id").otherwise("passage_ids")
    text = F.concat(
        F.lit('{"run": {"passage_id": '), pick(1), F.lit(', "rows": [['), F.coalesce("props", F.lit("null")), F.lit(', {"canonical_passage_id": '), pick(2), F.lit("}], 3]}, \""), key, F.lit('": '), pick(3), F.lit(', "note": "passage_id: [{"}')
    )
    return c.select("click_id", "h", text.alias("artefact"))


_ARTEFACT_SQL = f"""c AS (SELECT click_id, any_value(props) AS props, any_value(coalesce(kind, 'none')) AS k, md5(click_id::VARCHAR) AS h FROM clicks GROUP BY click_id),
a AS (SELECT click_id, h, '{{"run": {{"passage_id": ' || {_picked_sql(1)} || ', "rows": [[' || coalesce(props, 'null') || ', {{"canonical_passage_id": ' || {_picked_sql(2)} || '}}], 3]}}, "' || CASE WHEN substr(h, 4, 1) < '8' THEN 'passage_id' ELSE 'passage_ids' END || '": ' || {_picked_sql(3)} || ', "note": "passage_id: [{{"}}' AS j FROM c),
ok AS (SELECT * FROM a WHERE json_valid(j))"""


@register("flt03_canonical_ids", f"""WITH {_ARTEFACT_SQL}
SELECT click_id, substr(t.fullkey, 3) AS path, t.type = 'VARCHAR' AS is_text, CASE WHEN t.type = 'VARCHAR' THEN t.value ->> '$' END AS value FROM ok, json_tree(ok.j) AS t
WHERE t.key IN ('passage_id', 'canonical_passage_id') AND NOT regexp_matches(t.path, '(^|[.])(canonical_)?passage_id($|[.\\[])')
  AND (t.type <> 'VARCHAR' OR contains(t.value ->> '$', '_rank') OR NOT starts_with(t.value ->> '$', 'ps_') AND t.value ->> '$' <> 'UNMAPPED_NEEDS_REVIEW')
UNION ALL SELECT click_id, '', false, NULL FROM a WHERE NOT json_valid(j)""")
def flt03(spark, d):
    """Ids at any depth of an artefact, in lists of lists too, that are not canonical, with their paths; artefacts that can't be read."""
    bad = W.bad_ids(_artefacts(spark, d), "artefact", ["click_id"])
    text = F.col("kind") == "STRING"
    return bad.select("click_id", "path", text.alias("is_text"), F.when(text, F.col("value")).alias("value"))


@register("flt03_walk", f"""WITH {_ARTEFACT_SQL} SELECT regexp_replace(substr(t.fullkey, 3), '\\[[0-9]+\\]', '[]', 'g') AS path, count(*) AS n, count(DISTINCT click_id) AS records,
  CAST(sum(CASE WHEN t.type = 'VARCHAR' THEN length(t.value ->> '$') ELSE 0 END) AS BIGINT) AS chars FROM ok, json_tree(ok.j) AS t WHERE t.fullkey <> '$' GROUP BY 1""")
def flt03_walk(spark, d):
    """How often each place of the artefacts' shapes occurs, in how many of them, and the length of its texts."""
    found = W.walk(_artefacts(spark, d), "artefact", ["click_id"]).where("kind != 'INVALID'")
    chars = F.when(F.col("kind") == "STRING", F.length("value")).otherwise(0)
    return found.groupBy(F.regexp_replace("path", r"\[[0-9]+\]", "[]").alias("path")).agg(F.count("*").alias("n"), F.count_distinct("click_id").alias("records"), F.sum(chars).cast("long").alias("chars"))


def _list(values: list[str]) -> str:
    return "['" + "', '".join(values) + "']"


#: What an item may be found to hold, forbidden or not, and what is said in its reasons.
_FIELDS = [*G.BLINDED, "item_id", "text", "Strategy", "gold", "rank"]
_SAID = ["the Silver grade", "JUDGE said no", "unPredicted", "low_confidence", "low confidence", "positive!", "plain", "pre-judged"]


@register("flt04_blinding", f"""WITH b AS (SELECT conv_id, turn, text, md5(conv_id || ':' || turn) AS h FROM conversations WHERE text IS NOT NULL),
i AS (SELECT conv_id, turn, {_list(_FIELDS)}[('0x' || substr(h, 1, 6))::BIGINT % {len(_FIELDS)} + 1] AS f, {_list(_FIELDS)}[('0x' || substr(h, 7, 6))::BIGINT % {len(_FIELDS)} + 1] AS g, {_list(_SAID)}[('0x' || substr(h, 13, 6))::BIGINT % {len(_SAID)} + 1] || ' ' || text AS said, text FROM b),
w AS (SELECT unnest(['silver', 'judge', 'predicted', 'low_confidence', 'positive']) AS w),
bad AS (SELECT unnest({_list(G.BLINDED)}) AS f)
SELECT conv_id, turn, 'payload.' || f AS path, f AS what FROM i WHERE f IN (SELECT f FROM bad)
UNION ALL SELECT conv_id, turn, 'payload.deep[0][1].' || g, g FROM i WHERE g IN (SELECT f FROM bad)
UNION ALL SELECT conv_id, turn, 'routing_reasons[0][0]', w FROM i, w WHERE contains(lower(said), w)
UNION ALL SELECT conv_id, turn, 'routing_reasons[1]', w FROM i, w WHERE contains(lower(text), w)""")
def flt04(spark, d):
    """Items with forbidden fields at any depth, and revealing words in their reasons; other texts may say what they like."""
    c = read(spark, d, "conversations").where("text is not null").withColumn("h", F.md5(F.concat_ws(":", "conv_id", "turn").cast("binary")))
    pick = lambda at, of: F.get(F.array(*map(F.lit, of)), (F.conv(F.substring("h", at, 6), 16, 10).cast("long") % len(of)).cast("int"))
    deep = F.array(F.array(F.create_map(F.lit("ok"), F.lit(1)), F.create_map(pick(7, _FIELDS), F.lit(2))))
    own = F.concat(F.lit('{"payload": {"deep": '), F.to_json(deep), F.lit(', "'), pick(1, _FIELDS), F.lit('": "silver judge"}, "routing_reasons": '))
    said = F.concat(pick(13, _SAID), F.lit(" "), "text")
    reasons = F.concat(F.lit("["), F.to_json(F.array(said)), F.lit(", "), F.substring(F.to_json(F.array("text")), 2, 1 << 30))
    items = c.select("conv_id", "turn", F.concat(own, reasons, F.lit("}")).alias("item"))
    return W.revealing(items, "item", ["conv_id", "turn"], G.BLINDED, G.REVEALING, "routing_reasons")


#: Tails of texts in forms that look like plain letters only once they are normalised.
_TAILS = ["the Gold_Answer", "see /QRELS/x", "ＨＯＬＤＯＵＴ", "answer-key", "relevant", "𝐡𝐨𝐥𝐝𝐨𝐮𝐭", "ⓗⓞⓛⓓⓞⓤⓣ", "𝓆𝓇ℯ𝓁", "rele­vant", "hold out", "ﬁn", "relevant　page", "gold answer", "h o l d", "ℌ𝔬𝔩𝔡𝔬𝔲𝔱"]


@register("flt05_leakage", f"""WITH f AS (SELECT doc_id, coalesce(text, '') || {_list(_TAILS)}[('0x' || substr(md5(doc_id::VARCHAR), 1, 6))::BIGINT % {2 * len(_TAILS)} + 1] AS t0, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, coalesce(t0, t) AS t, lower(translate(coalesce(t0, t), 'ＨＯＬＤＵＴ𝐡𝐨𝐥𝐝𝐮𝐭ⓗⓞⓛⓓⓤⓣ𝓆𝓇ℯ𝓁ℌ𝔬𝔩𝔡𝔲𝔱　 ', 'HOLDUTholdutholdutqrelHoldut  ')) AS x FROM f)
SELECT doc_id, regexp_matches(regexp_replace(x, '[_./\\\\\\s-]+', '', 'g'), 'qrel|goldanswer|answerkey|relevantpage|holdout') OR regexp_matches(t, '(?i)/(qrels?|gold[_.-]?answers?|holdout)/') AS leaks FROM n""")
def flt05(spark, d):
    """Whole texts, half of them with a tail that leaks or nearly does, in plain and in compatibility forms."""
    at = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % (2 * len(_TAILS))).cast("int")
    t = F.concat(F.coalesce("text", F.lit("")), F.coalesce(F.get(F.array(*map(F.lit, _TAILS)), at), F.lit("")))
    return G.leakage(read(spark, d, "documents").select("doc_id", t.alias("text")), "text").select("doc_id", "leaks")


#: Keys of a ledger's records, forbidden in any case or not.
_KEYS = [*sinks.LEDGER_FORBIDDEN, "steps", "Token", "tokens", "API_KEY", "answer", "Holdout", "secrets"]


@register("flt06_forbidden_keys", f"""WITH c AS (SELECT click_id, any_value(props) AS props, md5(click_id::VARCHAR) AS h FROM clicks GROUP BY click_id),
r AS (SELECT click_id, {_list(_KEYS)}[('0x' || substr(h, 1, 6))::BIGINT % {len(_KEYS)} + 1] AS f, {_list(_KEYS)}[('0x' || substr(h, 7, 6))::BIGINT % {len(_KEYS)} + 1] AS g FROM c WHERE props IS NOT NULL AND json_valid(props)),
bad AS (SELECT unnest({_list(sinks.LEDGER_FORBIDDEN)}) AS k)
SELECT click_id, 'meta.' || f AS path, f AS name FROM r WHERE lower(f) IN (SELECT k FROM bad) UNION ALL SELECT click_id, 'steps[0][1].inner.' || g, g FROM r WHERE lower(g) IN (SELECT k FROM bad)""")
def flt06(spark, d):
    """Forbidden keys at any depth of a ledger's records; broken records are those of flt03."""
    c = read(spark, d, "clicks").dropDuplicates(["click_id"]).where("props is not null").withColumn("h", F.md5(F.col("click_id").cast("string").cast("binary")))
    pick = lambda at: F.get(F.array(*map(F.lit, _KEYS)), (F.conv(F.substring("h", at, 6), 16, 10).cast("long") % len(_KEYS)).cast("int"))
    text = F.concat(F.lit('{"meta": {"'), pick(1), F.lit('": '), "props", F.lit('}, "steps": [['), "props", F.lit(', {"inner": {"'), pick(7), F.lit('": "token"}}]]}'))
    return W.forbidden_keys(c.select("click_id", text.alias("record")), "record", ["click_id"], sinks.LEDGER_FORBIDDEN)
