"""Queries on text and vectors, with SQL twins written on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwell.functions import text as T
from rankwell.functions import vectors as V
from rankwell.operators import chunking as C
from rankwell.operators import embedding as M
from rankwell.operators import memo
from rankwell.operators import retrieval as R
from rankwell.plans.base import ORACLE_SQL, QUERIES, register
from rankwell.sources.folders import scratch
from rankwell.streaming import quota


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return C.pages_of(_docs(spark, d))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), V.as_doubles(F.col("embedding")).alias("vector"), "label")


def _run(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors."""
    v = _vectors(spark, d)
    return R.top_k(R.stated(v), v, k)


_PAGES = "pg AS (SELECT concat('doc_', doc_id) AS document_id, CAST(1 AS INTEGER) AS page_number, text FROM documents)"
_ABBR = "(?i)(^|[^\\p{L}\\p{N}_])(e\\.g|i\\.e|ex|pág|pag|fig|cap|tab|vs|art|sec|seção|vol|dr|prof|sr|sra|pp|nº)\\.\\s+"
#: Pages with abbreviations of every kind in front of a third of the documents' texts.
_ABBR_TEXT = "CASE doc_id % 3 WHEN 0 THEN 'See e.g. this. O Dr. Silva e a SRA.  Costa viram a Fig. 2! Ver seção. Nova, etc. Fim? Cap. 1 ' ELSE '' END || text"
_SENT = f"""pg AS (SELECT concat('doc_', doc_id) AS document_id, CAST(1 AS INTEGER) AS page_number, {_ABBR_TEXT} AS text FROM documents),
gl AS (SELECT document_id, page_number, regexp_replace(regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_ABBR}', '\\1\\2.' || chr(2), 'g'), '{_ABBR}', '\\1\\2.' || chr(2), 'g') AS text FROM pg),
st AS (SELECT document_id, page_number, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(replace(x, chr(2), ' '))), lambda x: x <> '') AS s FROM gl),
sn AS (SELECT document_id, page_number, s, unnest(range(0, len(s))) AS i FROM st)"""


def _prose(spark, d):
    """Pages whose texts hold abbreviations."""
    lead = F.when(F.col("doc_id") % 3 == 0, "See e.g. this. O Dr. Silva e a SRA.  Costa viram a Fig. 2! Ver seção. Nova, etc. Fim? Cap. 1 ").otherwise("")
    return C.pages_of(_docs(spark, d).withColumn("text", F.concat(lead, "text")))


def _cut_sql(width: int, step: int) -> str:
    return f"{_PAGES}, cut AS (SELECT document_id, page_number, o, substr(text, o + 1, {width}) AS c FROM (SELECT *, unnest(range(0, greatest(length(text), 1), {step})) AS o FROM pg) WHERE trim(substr(text, o + 1, {width})) <> '')"


@register("ing01_normalize_whitespace", r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([a-zà-ÿ])-\s*\n\s*([a-zà-ÿ])', '\1\2', 'gi'), '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM documents""")
def ing01(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))


@register("chk01_fixed", f"WITH {_cut_sql(512, 512)} SELECT document_id, page_number, concat(document_id, '_p', page_number, '_c', o) AS chunk_id, trim(c) AS text FROM cut")
def chk01(spark, d):
    return C.fixed(_pages(spark, d))


@register("chk02_fixed_ordinal", f"WITH {_cut_sql(512, 512)} SELECT document_id, page_number, concat(document_id, '_p', page_number, '_c', o // 512) AS chunk_id, c AS text FROM cut")
def chk02(spark, d):
    return C.fixed(_pages(spark, d), by_ordinal=True)


@register("chk03_overlapping", f"WITH {_cut_sql(512, 448)} SELECT document_id, page_number, concat(document_id, '_p', page_number, '_c', o) AS chunk_id, c AS text FROM cut")
def chk03(spark, d):
    return C.overlapping(_pages(spark, d))


@register("chk04_sentences", f"WITH {_SENT} SELECT document_id, CAST(i AS INTEGER) AS i, s[i + 1] AS sentence FROM sn")
def chk04(spark, d):
    return _prose(spark, d).select("document_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))


@register("chk05_sentence_windows", f"WITH {_SENT} SELECT concat(document_id, '_p', page_number, '_s', i) AS chunk_id, s[i + 1] AS anchor_text, array_to_string(s[greatest(i - 3, 0) + 1 : least(i + 3, len(s) - 1) + 1], ' ') AS window_text FROM sn")
def chk05(spark, d):
    return C.sentence_windows(_prose(spark, d)).select("chunk_id", "anchor_text", "window_text")


@register("chk06_sentence_anchors", f"WITH {_SENT} SELECT document_id, page_number, concat(document_id, '_p', page_number, '_s', i, '_anchor') AS chunk_id, CAST(i AS INTEGER) AS sentence_index, s[i + 1] AS text FROM sn")
def chk06(spark, d):
    return C.sentence_anchors(_prose(spark, d))


_TREE = _PAGES + r""", w AS (SELECT concat(document_id, '_p', page_number) AS id, document_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM pg),
l0 AS (SELECT document_id, id AS up, i // 1024 AS o, concat(id, '/', i // 1024) AS id, w[i + 1 : i + 1024] AS w FROM (SELECT *, unnest(range(0, len(w), 1024)) AS i FROM w)),
l1 AS (SELECT document_id, id AS up, concat(id, '/', i // 512) AS id, w[i + 1 : i + 512] AS w FROM (SELECT *, unnest(range(0, len(w), 512)) AS i FROM l0)),
l2 AS (SELECT document_id, id AS up, concat(id, '/', i // 256) AS id, w[i + 1 : i + 256] AS w FROM (SELECT *, unnest(range(0, len(w), 256)) AS i FROM l1)),
nodes AS (SELECT document_id, id AS node_id, 0 AS level, CAST(NULL AS VARCHAR) AS parent_id, array_to_string(w, ' ') AS text FROM l0 UNION ALL SELECT document_id, id, 1, up, array_to_string(w, ' ') FROM l1 UNION ALL SELECT document_id, id, 2, up, array_to_string(w, ' ') FROM l2)"""


@register("chk07_hierarchy", f"WITH {_TREE} SELECT node_id, CAST(level AS INTEGER) AS level, parent_id, text FROM nodes")
def chk07(spark, d):
    return C.hierarchy(_pages(spark, d)).select("node_id", "level", "parent_id", "text")


@register("chk08_hierarchy_nodes", f"WITH {_TREE} SELECT node_id, CAST(level AS INTEGER) AS level, CAST(sum(length(text)) OVER (PARTITION BY document_id, level ORDER BY length(node_id), node_id) - length(text) AS BIGINT) AS char_start, substr(sha256(text), 1, 16) AS fingerprint, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_count FROM nodes")
def chk08(spark, d):
    return C.hierarchy_nodes(C.hierarchy(_pages(spark, d))).select("node_id", "level", "char_start", "fingerprint", "token_count")


@register("chk09_hierarchy_stats", f"WITH {_TREE} SELECT CAST(level AS INTEGER) AS level, count(*) AS n, round(avg(greatest(1, length(text) // 4)), 1) AS avg_tokens FROM nodes GROUP BY level")
def chk09(spark, d):
    n = C.hierarchy_nodes(C.hierarchy(_pages(spark, d)))
    return n.groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("token_count"), 1).alias("avg_tokens"))


@register("chk10_navigation", f"WITH {_TREE} SELECT p.node_id, count(c.node_id) AS children FROM nodes p LEFT JOIN nodes c ON c.parent_id = p.node_id GROUP BY p.node_id")
def chk10(spark, d):
    n = C.hierarchy(_pages(spark, d)).select("node_id", "parent_id")
    c = n.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("children"))
    return n.select("node_id").join(c, "node_id", "left").select("node_id", F.coalesce("children", F.lit(0)).alias("children"))


_PASS = _PAGES + ", ps AS (SELECT document_id, trim(text) AS text, sha256(trim(text)) AS content_sha256, concat('ps_', substr(sha256(concat(document_id, ':1:0:', length(trim(text)), ':', sha256(trim(text)))), 1, 16)) AS passage_id FROM pg WHERE trim(text) <> '')"


@register("chk11_passages", f"WITH {_PASS} SELECT document_id, passage_id, CAST(length(text) AS INTEGER) AS end_char, content_sha256, length(text) < 50 AS is_short FROM ps")
def chk11(spark, d):
    return C.passages(_pages(spark, d)).select("document_id", "passage_id", "end_char", "content_sha256", "is_short")


QUERIES["chk12_passage_id"], ORACLE_SQL["chk12_passage_id"] = lambda spark, d: C.passages(_pages(spark, d)).select("document_id", "passage_id"), f"WITH {_PASS} SELECT document_id, passage_id FROM ps"


@register("chk13_chunk_pages", f"WITH {_cut_sql(512, 512)} SELECT document_id, page_number + CASE WHEN o >= 1024 THEN 1 ELSE 0 END AS page_number, concat(document_id, '_p', page_number, '_c', o) AS chunk_id, trim(c) AS text FROM cut")
def chk13(spark, d):
    """Chunks that span pages as pages, by the page they start on: the form that page chunkers take."""
    c = C._cut(_pages(spark, d), 512, 512)
    spans = c.select("document_id", F.concat("document_id", F.lit("_p"), "page_number", F.lit("_c"), "offset").alias("chunk_id"), F.when(F.col("offset") >= 1024, 2).otherwise(1).alias("start_page"), F.lit(2).alias("end_page"), F.trim("text").alias("text"))
    return C.as_pages(spans)


_HEX = "SELECT doc_id, list_transform(range(0, 64), lambda i: CAST(CAST(('0x' || substr(sha256(text), CAST((i % 32) * 2 + 1 AS BIGINT), 2)) AS BIGINT) AS DOUBLE)) AS v FROM documents"


@register("emb01_hash_embedding", f"SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[64] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last, len(v) AS dim FROM ({_HEX})")
def emb01(spark, d):
    e = _docs(spark, d).select("doc_id", V.hash_embedding(F.col("text")).alias("v"))
    return e.select("doc_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"), F.size("v").cast("long").alias("dim"))


@register("emb02_memo_embedding", f"SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE first END AS first, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE last END AS last, 64 AS dim, run FROM (SELECT doc_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(v[64] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS last FROM ({_HEX}) h) e JOIN documents USING (doc_id), (VALUES (1), (2)) AS r(run) WHERE run = 2 OR doc_id % 2 = 0")
def emb02(spark, d):
    """Two runs over one cache: the first embeds every second document, the second only what is new."""
    cache, v = scratch(spark, "embeddings"), F.col("embedding")
    docs = _docs(spark, d).select("doc_id", "text")
    one = memo.embed_once(docs.where("doc_id % 2 = 0"), V.hash_embedding, 64, cache=cache).withColumn("run", F.lit(1))
    two = memo.embed_once(docs, V.hash_embedding, 64, cache=cache).withColumn("run", F.lit(2))
    return one.unionByName(two).select("doc_id", F.round(v[0], 6).alias("first"), F.round(v[63], 6).alias("last"), F.size(v).cast("long").alias("dim"), "run")


class _Sized:
    dimension = 64

    def embed_texts(self, texts):
        return [M.word_vector(t, 64) for t in texts]


class _Short:
    dim = 32

    def embed(self, texts):
        return [M.word_vector(t, 32) for t in texts]


def _plain(texts):
    return [M.word_vector(t, 16) for t in texts]


@register("emb03_bridge", """WITH q AS (SELECT item_id, split_part(trim(text), ' ', 1) AS t FROM benchmark WHERE item_id IS NOT NULL AND trim(text) <> ''), e AS (SELECT * FROM (VALUES ('with_dimension', 64, 'dimension'), ('with_dim', 32, 'dim'), ('plain_function', 16, 'probe')) AS t(embedder, dimension, via))
SELECT item_id, embedder, dimension, via, dimension AS size, round(('0x' || substr(sha256(concat('w:', t, ':', dimension - 1)), 1, 8))::BIGINT / 4294967295.0::DOUBLE * 2 - 1, 6) AS last FROM q, e""")
def emb03(spark, d):
    """Embedders of three shapes behind one face: the first words of all questions by each, and how its size was found."""
    import pyarrow as pa

    shapes = {"with_dimension": _Sized(), "with_dim": _Short(), "plain_function": _plain}
    q = spark.read.parquet(f"{d}/benchmark.parquet").where("item_id is not null").select("item_id", F.split_part(F.trim("text"), F.lit(" "), F.lit(1)).alias("t")).where("t != ''")

    def run(batches):
        faces = {name: (M.Bridge(e), *M.Bridge(e).dimension()) for name, e in shapes.items()}
        for b in batches:
            texts = b.column("t").to_pylist()
            for name, (face, n, via) in faces.items():
                v = face.embed(texts)
                yield pa.RecordBatch.from_pydict({"item_id": b.column("item_id"), "embedder": [name] * len(v), "dimension": pa.array([n] * len(v), pa.int32()), "via": [via] * len(v), "size": pa.array([len(x) for x in v], pa.int32()), "last": [x[-1] for x in v]})

    return q.mapInArrow(run, "item_id long, embedder string, dimension int, via string, size int, last double").withColumn("last", F.round("last", 6))


@register("emb04_parity", """WITH p AS (SELECT label, sha256(concat_ws('|', CASE WHEN label = 3 THEN 'hash' ELSE 'minilm' END, 'r1', max(len(embedding)), CASE WHEN label = 7 THEN 'cls' ELSE 'mean' END, 'true', 'float32', 256)) AS fingerprint, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, n, fingerprint, label NOT IN (3, 7) AS agrees, false AS parity FROM p""")
def emb04(spark, d):
    """Fingerprints of seven fields: the embedders of labels 3 and 7 differ in model and pooling."""
    l = F.col("label")
    fields = {"model": F.when(l == 3, "hash").otherwise("minilm"), "revision": F.lit("r1"), "dimension": F.col("dim"), "pooling": F.when(l == 7, "cls").otherwise("mean"), "normalized": F.lit("true"), "dtype": F.lit("float32"), "max_tokens": F.lit(256)}
    v = _vectors(spark, d).groupBy("label").agg(F.max(F.size("vector")).alias("dim"), F.count("*").alias("n"))
    return M.parity(v.select("label", "n", M.fingerprint(**fields).alias("fingerprint")), "label")


_PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_WORDSUM = f"""w AS (SELECT id, list_filter(list_transform(regexp_split_to_array(lower(t), '\\s+'), lambda x: trim(x, '{_PUNCT}')), lambda x: x <> '') AS ws FROM texts WHERE trim(t) <> ''),
o AS (SELECT id, unnest(ws) AS word FROM w), vocab AS (SELECT word, i, ('0x' || substr(sha256(concat('w:', word, ':', i)), 1, 8))::BIGINT / 4294967295.0::DOUBLE * 2 - 1 AS x FROM (SELECT DISTINCT word FROM o) u, range(0, 64) AS r(i)),
c AS (SELECT id, word, count(*) AS n FROM o GROUP BY ALL), z AS (SELECT id, i, sum(n * x) AS x FROM c JOIN vocab USING (word) GROUP BY ALL), ws AS (SELECT id, list(x ORDER BY i) AS v FROM z GROUP BY id),
wv AS (SELECT id, [y / sqrt(list_sum([x * x for x in v])) for y in v] AS v FROM ws)"""


@register("emb05_word_sum", f"WITH texts AS (SELECT conv_id * 100000 + turn AS id, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL), {_WORDSUM.replace('range(0, 64)', 'range(0, 384)')} SELECT texts.id, round(coalesce(v[1], 0), 6) AS first, round(coalesce(v[384], 0), 6) AS last, 384 AS dim, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS norm FROM texts LEFT JOIN wv ON wv.id = texts.id")
def emb05(spark, d):
    """Word sums of all turns, of the full 384 dimensions; rtv04 searches documents by shorter ones."""
    v, turns = F.col("vector"), spark.read.parquet(f"{d}/conversations.parquet").where("conv_id is not null and turn is not null")
    return M.word_sum(turns.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("id"), "text"), "id", dim=384).select("id", F.round(v[0], 6).alias("first"), F.round(v[383], 6).alias("last"), F.size(v).alias("dim"), F.round(V.norm(v)).cast("int").alias("norm"))


@register("emb06_canary", "SELECT vec_id, vec_id % 10 <> 3 AND vec_id % 10 <> 4 AS ok FROM embeddings")
def emb06(spark, d):
    """The canary on vectors of which some were cut short and some hold what is no number."""
    i, v = F.col("id"), F.col("vector")
    hurt = F.when(i % 10 == 3, F.slice(v, 1, 63)).when(i % 10 == 4, F.concat(F.slice(v, 1, 63), F.array(F.lit(float("nan"))))).otherwise(v)
    return _vectors(spark, d).select(i.alias("vec_id"), M.canary(hurt, 64).alias("ok"))


def _topk_sql(k: int) -> str:
    return f"""v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sc AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.e, i.e) AS score FROM v q JOIN v i ON q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id),
rk AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) AS rank FROM sc),
topk AS (SELECT * FROM rk WHERE rank <= {k})"""


@register("rtv01_cosine", f"WITH {_topk_sql(1)} SELECT query_id, round(avg(score), 6) AS mean_score, count(*) AS n FROM sc GROUP BY query_id")
def rtv01(spark, d):
    v = _vectors(spark, d)
    return R.score_sums(R.stated(v), v).select("query_id", F.round(F.col("total") / F.col("n"), 6).alias("mean_score"), "n")


@register("jon01_query_chunk", f"WITH {_topk_sql(1)}, l AS (SELECT query_id, list(score) AS s FROM sc GROUP BY query_id) SELECT query_id, len(s) AS n, len(list_filter(s, lambda x: x > 0.1)) AS n_above FROM l")
def jon01(spark, d):
    """Every stated query with every chunk: how many pairs score above a tenth."""
    v = _vectors(spark, d)
    return R.score_sums(R.stated(v), v, above=0.1).select("query_id", "n", "n_above")


@register("rtv02_f0_topk", f"WITH {_topk_sql(3)} SELECT query_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM topk")
def rtv02(spark, d):
    return _run(spark, d, 3).withColumn("score", F.round("score", 6))


@register("rtv03_f0_scaled", f"WITH {_topk_sql(3)} SELECT query_id, concat(item_id, '_p1') AS document_id, round(greatest(0, least(1, (score + 1) / 2)), 4) AS score FROM topk")
def rtv03(spark, d):
    return _run(spark, d, 3).select("query_id", F.concat("item_id", F.lit("_p1")).alias("document_id"), R.clamped((F.col("score") + 1) / 2).alias("score"))


@register("rtv04_vector_retriever", f"""WITH texts AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), {_WORDSUM}, a AS (SELECT texts.id, v FROM texts LEFT JOIN wv ON wv.id = texts.id),
p AS (SELECT q.id AS query_id, i.id AS item_id, coalesce(list_cosine_similarity(q.v, i.v), 0) AS score FROM a q JOIN a i ON q.id % 20 = 0 AND q.id <> i.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM p) SELECT query_id, rank::INT AS rank, round(score, 4) AS score FROM r WHERE rank <= 5""")
def rtv04(spark, d):
    """Texts retrieved by texts: word-sum vectors of whole documents, the stated documents against all.  Copies tie, so scores by rank are compared."""
    path = scratch(spark, "vectors")  # each block of queries reads them
    M.word_sum(_docs(spark, d), "doc_id").write.parquet(path)
    v = spark.read.parquet(path)
    return R.top_k(R.stated(v), v, 5).select("query_id", "rank", F.round("score", 4).alias("score"))


@register("rtv05_s0_anchor", f"WITH {_topk_sql(5)} SELECT query_id, item_id, round(greatest(0, least(1, score)), 4) AS score FROM topk")
def rtv05(spark, d):
    return _run(spark, d, 5).select("query_id", "item_id", R.clamped(F.col("score")).alias("score"))


@register("rtv06_w0_window", f"""WITH RECURSIVE {_topk_sql(9)}, c AS (SELECT query_id, rank, item_id // 25 AS page, item_id % 25 AS s FROM topk),
walk AS (SELECT DISTINCT query_id, 0::BIGINT AS pos, []::STRUCT(page BIGINT, s BIGINT, rank BIGINT)[] AS kept FROM c
 UNION ALL SELECT w.query_id, w.pos + 1, CASE WHEN len(w.kept) >= 3 OR len(list_filter(w.kept, lambda k: k.page = c.page AND abs(k.s - c.s) <= 3)) > 0 THEN w.kept ELSE list_append(w.kept, {{'page': c.page, 's': c.s, 'rank': c.rank}}) END FROM walk w JOIN c ON c.query_id = w.query_id AND c.rank = w.pos + 1),
e AS (SELECT query_id, kept FROM walk WHERE pos = 9) SELECT query_id, unnest(range(1, len(kept) + 1))::INT AS rank, unnest(kept).page::VARCHAR AS page, unnest(kept).s::INT AS sentence, unnest(kept).rank::INT AS candidate_rank FROM e""")
def rtv06(spark, d):
    run = _run(spark, d, 9).select("query_id", "rank", F.floor(F.col("item_id") / 25).cast("string").alias("page"), (F.col("item_id") % 25).cast("int").alias("sentence"))
    return R.window_dedup(run, 3, 3)


@register("rtv07_h0_leaves", f"WITH {_topk_sql(6)} SELECT query_id, concat('leaf_', item_id) AS node_id, round(score, 6) AS score FROM topk")
def rtv07(spark, d):
    return _run(spark, d, 6).select("query_id", F.concat(F.lit("leaf_"), "item_id").alias("node_id"), F.round("score", 6).alias("score"))


def _level(spark, d, child: str, n: int, up: str, m: int):
    """Children of one level with their parents: nodes are runs of vector ids."""
    i = F.col("id")
    name = lambda what, k: F.concat(F.lit(f"{what}_"), F.floor(i / k).cast("string"))
    return _vectors(spark, d).select(name(child, n).alias("node_id"), name(up, m).alias("parent_id")).distinct()


@register("rtv08_h1_auto_merge", f"""WITH {_topk_sql(12)}, size AS (SELECT vec_id // 3 AS p, count(*) AS c FROM embeddings GROUP BY 1), big AS (SELECT p // 2 AS g, count(*) AS c FROM size GROUP BY 1),
g AS (SELECT query_id, item_id // 3 AS p, count(*) AS n, avg(score) AS m FROM topk GROUP BY 1, 2), up AS (SELECT query_id, g.p, m FROM g JOIN size ON size.p = g.p WHERE 2 * n >= c),
g2 AS (SELECT query_id, p // 2 AS g, count(*) AS n, avg(m) AS m FROM up GROUP BY 1, 2), top AS (SELECT query_id, g2.g, m FROM g2 JOIN big ON big.g = g2.g WHERE 2 * n >= c),
every AS (SELECT query_id, 'parent_' || g AS node_id, m AS score FROM top UNION ALL SELECT u.query_id, 'middle_' || u.p, u.m FROM up u LEFT JOIN top t ON t.query_id = u.query_id AND t.g = u.p // 2 WHERE t.g IS NULL
 UNION ALL SELECT t.query_id, 'leaf_' || t.item_id, t.score FROM topk t LEFT JOIN up ON up.query_id = t.query_id AND up.p = t.item_id // 3 WHERE up.p IS NULL)
SELECT query_id, node_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id)::INT AS rank FROM every""")
def rtv08(spark, d):
    """Leaves to middles of three, middles to parents of two, wherever half of the children were found."""
    from pyspark.sql import Window

    run = _run(spark, d, 12).select("query_id", F.concat(F.lit("leaf_"), "item_id").alias("node_id"), "score")
    run = R.auto_merge(run, _level(spark, d, "leaf", 1, "middle", 3))
    run = R.auto_merge(run, _level(spark, d, "middle", 3, "parent", 6))
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "node_id")
    return run.select("query_id", "node_id", F.round("score", 6).alias("score"), F.row_number().over(by).alias("rank"))


_RESCORED = "rs AS (SELECT t.query_id, t.item_id, t.rank, t.score, list_cosine_similarity(q.e[33:], i.e[33:]) AS again FROM topk t JOIN v q ON q.vec_id = t.query_id JOIN v i ON i.vec_id = t.item_id), re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(again, 12) DESC, rank) AS p FROM rs)"


def _rescored(spark, d, k: int, keep: int) -> DataFrame:
    """Candidates scored again by another encoder, the second half of the vectors."""
    half = _vectors(spark, d).select("id", F.slice("vector", 33, 32).alias("h"), V.norm(F.slice("vector", 33, 32)).alias("n"))
    run = _run(spark, d, k)
    pairs = run.select("query_id", "item_id").join(half.select(F.col("id").alias("query_id"), F.col("h").alias("qh"), F.col("n").alias("qn")), "query_id").join(half.select(F.col("id").alias("item_id"), "h", "n"), "item_id")
    return R.rescore(run, pairs.select("query_id", "item_id", F.round(V.cosine(F.col("qh"), F.col("h"), F.col("qn"), F.col("n")), 12).alias("new_score")), keep)


@register("rtv12_w1_rerank", f"WITH {_topk_sql(10)}, {_RESCORED} SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank, CAST(CASE WHEN p <= 3 THEN p END AS INTEGER) AS post_rank FROM re")
def rtv12(spark, d):
    return _rescored(spark, d, 10, 3).select("query_id", "item_id", "rank", "post_rank")


@register("rtv13_rescoring", f"WITH {_topk_sql(6)}, {_RESCORED} SELECT query_id, item_id, CASE WHEN p <= 3 THEN 'KEPT' ELSE 'DROPPED' END AS state, CASE WHEN p <= 3 THEN round(greatest(0, least(1, again)), 4) ELSE round(score, 4) END AS score FROM re")
def rtv13(spark, d):
    """What rescoring keeps, with its clamped score, and what it drops, with the score it came with."""
    kept = F.col("post_rank").isNotNull()
    return _rescored(spark, d, 6, 3).select("query_id", "item_id", F.when(kept, "KEPT").otherwise("DROPPED").alias("state"), F.when(kept, R.clamped(F.col("new_score"))).otherwise(F.round("score", 4)).alias("score"))


@register("rtv16_wide_k", f"WITH {_topk_sql(6)} SELECT query_id, item_id, CAST(rank AS INTEGER) AS rank FROM topk")
def rtv16(spark, d):
    return _run(spark, d, 6).select("query_id", "item_id", "rank")


@register("rtv16_rerank_two", f"WITH {_topk_sql(6)}, {_RESCORED} SELECT query_id, item_id, p::INT AS rank FROM re WHERE p <= 2")
def rtv16_two(spark, d):
    return _rescored(spark, d, 6, 2).where("post_rank is not null").select("query_id", "item_id", F.col("post_rank").alias("rank"))


@register("rtv16_splitter", rf"""WITH {_PAGES}, w AS (SELECT document_id, page_number, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM pg), s AS (SELECT *, unnest(range(0, greatest(1, len(w) - 64), 448)) AS o FROM w WHERE len(w) > 0)
SELECT document_id, page_number, concat(document_id, '_p', page_number, '_t', o) AS chunk_id, array_to_string(w[o + 1 : o + 512], ' ') AS text FROM s""")
def rtv16_splitter(spark, d):
    return C.token_chunks(_pages(spark, d))


@register("rtv16_hierarchy", f"WITH {_TREE.replace('1024', '2048').replace('512', '768')} SELECT CAST(level AS INTEGER) AS level, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT parent_id) AS parents FROM nodes GROUP BY level")
def rtv16_hierarchy(spark, d):
    return C.hierarchy(_pages(spark, d), (2048, 768, 256)).groupBy("level").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.count_distinct("parent_id").alias("parents"))


@register("evl18_token_judge", r"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT u.conv_id, u.turn, lower(a.text) AS ans, list_distinct(list_filter(regexp_split_to_array(lower(u.text), '\s+'), lambda x: length(x) > 3)) AS q, list_distinct(list_filter(regexp_split_to_array(lower(a.text), '\s+'), lambda x: length(x) > 3)) AS a FROM t u JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0 ELSE round(CAST(len(list_intersect(q, a)) AS DOUBLE) / len(a), 4) END AS groundedness, CASE WHEN len(q) = 0 THEN 0 ELSE round(CAST(len(list_filter(q, lambda x: contains(ans, x))) AS DOUBLE) / len(q), 4) END AS answer_relevance FROM p""")
def evl18(spark, d):
    t = spark.read.parquet(f"{d}/conversations.parquet").withColumn("text", F.coalesce("text", F.lit("")))
    u = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    p = u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", F.lower("a").alias("ans"), T.tokens(F.col("q")).alias("q"), T.tokens(F.col("a")).alias("a"))
    share = lambda n, of: F.when(F.size(of) == 0, 0.0).otherwise(F.round(n / F.size(of), 4))
    return p.select("conv_id", "turn", share(F.size(F.array_intersect("q", "a")), "a").alias("groundedness"), share(F.size(F.filter("q", lambda x: F.contains(F.col("ans"), x))), "q").alias("answer_relevance"))




_ADMISSION_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
w AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, []::BIGINT[] AS held, NULL::BOOLEAN AS admitted FROM (SELECT DISTINCT user_id FROM e) u
 UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN len(list_filter(w.held, lambda x: e.t - x < 86400000000)) < 3 THEN list_append(list_filter(w.held, lambda x: e.t - x < 86400000000), e.t) ELSE list_filter(w.held, lambda x: e.t - x < 86400000000) END, len(list_filter(w.held, lambda x: e.t - x < 86400000000)) < 3 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)"""


@register("str01_admission", f"{_ADMISSION_SQL} SELECT event_id, user_id, admitted FROM w WHERE n > 0")
def str01(spark, d):
    return quota.admitted(spark.read.parquet(f"{d}/events.parquet"), limit=3, seconds=86_400).select("event_id", "user_id", "admitted")


@register("str01_admission_stream", f"{_ADMISSION_SQL} SELECT w.event_id, w.user_id, admitted FROM w JOIN e USING (event_id) WHERE w.n > 0 AND e.t < (SELECT max(epoch_ms(ts)) - 3600000 FROM events WHERE user_id IS NOT NULL) * 1000")
def str01_stream(spark, d):
    """The same as a stream over the table's files: what the watermark, an hour behind the last event, has passed."""
    kind = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(kind).parquet(f"{d}/events.parque[t]")  # a stream takes a single file by a pattern only
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    out, state = scratch(spark, "admitted"), scratch(spark, "admission-state")
    query = quota.admitted_stream(source, 3, 86_400).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).select("event_id", "user_id", "admitted")
