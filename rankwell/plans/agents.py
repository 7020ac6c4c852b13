"""Routing, governed execution and replay of agents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankwell.operators import canonical, trajectory
from rankwell.operators import routing as R
from rankwell.plans import base as B
from rankwell.plans.base import ASKS_SQL, METRIC_SQL, RUN_SQL, read, register
from rankwell.plans.evaluation import metric

#: Openings that make questions of every class out of conversations.
OPENINGS = ["Compare both sides: ", "Give an OVERVIEW of ", "How does this work, ", "Is it not covered in the text, that ", "What was ", "  ", "contrasts with the step for ", "whichever "]
CLOSINGS = ["", "?", "", " ?"]


def questions(spark, d):
    i, t = F.col("conv_id"), F.col("turn")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    return B.asks(spark, d).select("conv_id", "turn", F.concat(pick(OPENINGS, i), F.col("question"), pick(CLOSINGS, i + t)).alias("question"))


_Q_SQL = f"{ASKS_SQL}, q AS (SELECT conv_id, turn, concat({OPENINGS!r}[conv_id % 8 + 1], question, {CLOSINGS!r}[(conv_id + turn) % 4 + 1]) AS question FROM asks), s AS (SELECT *, trim(regexp_replace(question, '\\s+$', '')) AS x FROM q)"
_RE = {k: v.replace("'", "''") for k, v in R.CLASSES.items()}
CLASS_SQL = f"""{_Q_SQL}, routed AS (SELECT conv_id, turn, question, coalesce(CASE WHEN regexp_matches(x, '(?i){_RE["POSSIBLY_UNANSWERABLE"]}') THEN 'POSSIBLY_UNANSWERABLE' END, CASE WHEN regexp_matches(x, '(?i){_RE["COMPARISON"]}') THEN 'COMPARISON' END,
  CASE WHEN regexp_matches(x, '(?i){_RE["GLOBAL_SUMMARY"]}') THEN 'GLOBAL_SUMMARY' END, CASE WHEN regexp_matches(x, '(?i){_RE["PROCEDURAL_EXPLANATION"]}') THEN 'PROCEDURAL_EXPLANATION' END,
  CASE WHEN regexp_matches(x, '\\?$') OR regexp_matches(x, '(?i)^(what|where|when|who|which)') THEN 'LOCALIZED_FACT' END, 'UNCLASSIFIED') AS query_class FROM s)"""
_MAP_SQL = "CASE WHEN query_class = 'GLOBAL_SUMMARY' THEN 'auto_merging' WHEN query_class = 'PROCEDURAL_EXPLANATION' THEN 'sentence_window' WHEN query_class = 'POSSIBLY_UNANSWERABLE' THEN 'baseline' ELSE 'sentence_window_rerank' END"


@register("agt01_classify", f"WITH {CLASS_SQL} SELECT conv_id, turn, query_class FROM routed")
def agt01(spark, d):
    return questions(spark, d).select("conv_id", "turn", R.classify(F.col("question")).alias("query_class"))


@register("agt02_route", f"WITH {CLASS_SQL} SELECT conv_id, turn, {_MAP_SQL} AS strategy, CASE WHEN query_class = 'UNCLASSIFIED' THEN 'FALLBACK' ELSE 'SELECTED' END AS status FROM routed")
def agt02(spark, d):
    c = questions(spark, d).select("conv_id", "turn", R.classify(F.col("question")).alias("c"))
    return c.select("conv_id", "turn", R.strategy_of(F.col("c")).alias("strategy"), F.when(F.col("c") == "UNCLASSIFIED", "FALLBACK").otherwise("SELECTED").alias("status"))


@register("agt03_hashes", f"""WITH {CLASS_SQL}, j AS (SELECT conv_id, turn, '{{"query_class":"' || query_class || '","query_id":"' || conv_id || '_' || turn || '","steps":' || turn + 1 || ',"strategy":"' || {_MAP_SQL} || '"}}' AS json FROM routed)
SELECT conv_id, turn, json, sha256(json) AS trajectory_sha256 FROM j""")
def agt03(spark, d):
    """Trajectories as canonical JSON (sorted keys, no blanks) with their hash."""
    c = questions(spark, d).withColumn("c", R.classify(F.col("question")))
    json = R.canonical_json(query_id=R.quoted(F.concat_ws("_", "conv_id", "turn")), query_class=R.quoted(F.col("c")), strategy=R.quoted(R.strategy_of(F.col("c"))), steps=(F.col("turn") + 1).cast("string"))
    return c.select("conv_id", "turn", json.alias("json")).withColumn("trajectory_sha256", F.sha2("json", 256))


_ESCAPED = """list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t'
  WHEN unicode(c) >= 65536 THEN format('\\u{{:04x}}\\u{{:04x}}', 55296 + ((unicode(c) - 65536) >> 10), 56320 + (unicode(c) - 65536) % 1024) WHEN unicode(c) < 32 OR unicode(c) > 126 THEN format('\\u{{:04x}}', unicode(c)) ELSE c END)"""
_TEXT_SQL = "'\"' || array_to_string(" + _ESCAPED + ", '') || '\"'"


@register("agt03_canonical", f"""WITH t AS (SELECT conv_id, turn, role, concat(text, ' 𝒳 "', chr(9), '\\') AS text FROM conversations WHERE turn IS NOT NULL),
j AS (SELECT conv_id, turn, '{{{{"conv_id":' || conv_id || ',"ends":{{{{' || CASE WHEN role IS NULL THEN '' ELSE {_TEXT_SQL.format('role')} || ':' || CASE WHEN turn = 0 THEN '0.0' ELSE (turn / 8.0::DOUBLE)::VARCHAR END END || '}}}},"parts":[[' || coalesce({_TEXT_SQL.format('text')}, 'null') || '],null],"role":' || coalesce({_TEXT_SQL.format('role')}, 'null') || ',"turn":{{{{"even":' || (turn % 2 = 0) || ',"share":' || CASE WHEN turn = 0 THEN '0.0' ELSE (turn / 8.0::DOUBLE)::VARCHAR END || '}}}}}}}}' AS j FROM t)
SELECT conv_id, turn, length(j) AS n_chars, sha256(j) AS sha FROM j""".replace("{{", "{").replace("}}", "}"))
def agt03_canonical(spark, d):
    """Nested records of every turn, with texts beyond ASCII, as canonical JSON and its hash."""
    t = B.read(spark, d, "conversations").where("turn is not null").withColumn("text", F.concat("text", F.lit(' 𝒳 "\t\\')))
    share = F.col("turn") / 8.0
    ends = F.when(F.col("role").isNull(), F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.col("role"), share))
    rows = t.select("conv_id", "turn", F.struct(F.struct(share.alias("share"), (F.col("turn") % 2 == 0).alias("even")).alias("turn"), "role", F.array(F.array("text"), F.lit(None).cast("array<string>")).alias("parts"), ends.alias("ends"), "conv_id").alias("r"))
    json = canonical.json(F.col("r"), rows.schema["r"].dataType)
    return rows.select("conv_id", "turn", json.alias("json")).select("conv_id", "turn", F.length("json").cast("long").alias("n_chars"), F.sha2("json", 256).alias("sha"))


@register("agt04_fixed_router", f"WITH {RUN_SQL}, s AS (SELECT qid, list(DISTINCT strategy) AS allowed FROM run GROUP BY qid) SELECT qid, CASE WHEN list_contains(allowed, 3) THEN 3 ELSE list_min(allowed) END AS chosen, CASE WHEN list_contains(allowed, 3) THEN 'FIXED' ELSE 'FIRST_ALLOWED' END AS why FROM s")
def agt04(spark, d):
    """The fixed strategy where it is allowed, else the first allowed one in order."""
    s = B.run(spark, d).groupBy("qid").agg(F.max((F.col("strategy") == 3)).alias("has"), F.min("strategy").alias("first"))
    return s.select("qid", F.when(F.col("has"), 3).otherwise(F.col("first")).alias("chosen"), F.when(F.col("has"), "FIXED").otherwise("FIRST_ALLOWED").alias("why"))


def invocations(spark, d):
    """Calls of each user in order: tools by event type, some of them unknown, some arguments bad."""
    i, kind = F.col("event_id"), F.col("event_type")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    tool = F.when(kind == "error", "delete_all").when(kind == "signup", "retrieve_auto_merging").when(kind == "view", "retrieve_sentence_window").otherwise("retrieve_baseline")
    asked = F.when(i % 7 == 0, "baseline").otherwise(F.substring(tool, 10, 40))
    query = F.when(i % 37 == 0, "  ").when(i % 29 == 0, "the GOLD-answer, please").when(i % 43 == 0, F.repeat(F.lit("x"), F.lit(10001))).otherwise("what is it")
    e = read(spark, d, "events").where("user_id is not null and event_type is not null")
    return e.select(
        F.col("user_id").alias("run_id"), F.row_number().over(order).alias("seq"), tool.alias("tool_id"), query.alias("query"), asked.alias("strategy"), (i % 12).cast("int").alias("top_k"),
        F.when(i % 31 == 0, F.array(F.lit("doc_1"))).alias("document_filter"), F.array(F.lit("ps_1"), F.when(i % 11 == 0, "p_2").otherwise("ps_2")).alias("passage_ids"),
    )


@register("agt05_execution_ladder", """WITH e AS (SELECT user_id AS run_id, event_id AS i, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS k, CASE event_type WHEN 'signup' THEN 'auto_merging' WHEN 'view' THEN 'sentence_window' ELSE 'baseline' END AS own FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
x AS (SELECT *, CASE WHEN k = 'error' THEN 'UNKNOWN_TOOL' WHEN i % 37 = 0 OR (i % 43 = 0 AND i % 29 <> 0) OR (i % 7 = 0 AND own <> 'baseline') OR i % 12 NOT BETWEEN 1 AND 10 THEN 'INVALID_ARGUMENTS' WHEN i % 31 = 0 OR i % 29 = 0 THEN 'LEAKAGE_DETECTED' END AS early FROM e),
u AS (SELECT *, count(*) FILTER (early IS NULL) OVER (PARTITION BY run_id ORDER BY seq) AS used FROM x) SELECT run_id, seq, coalesce(early, CASE WHEN used > 10 THEN 'BUDGET_EXHAUSTED' WHEN i % 11 = 0 THEN 'NON_CANONICAL_ID' ELSE 'EXECUTED' END) AS status FROM u""")
def agt05(spark, d):
    return R.execute(invocations(spark, d), R.registry(spark))


@register("agt06_budget", """WITH e AS (SELECT user_id AS run_id, event_type = 'error' AS r, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
c AS (SELECT run_id, seq, count(*) FILTER (NOT r) OVER w AS logical, seq AS physical, count(*) FILTER (r) OVER w AS retries FROM e WINDOW w AS (PARTITION BY run_id ORDER BY seq)) SELECT *, CASE WHEN logical > 10 THEN 'LOGICAL' WHEN physical > 20 THEN 'PHYSICAL' WHEN retries > 5 THEN 'RETRIES' END AS exceeded FROM c""")
def agt06(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").where("user_id is not null and event_type is not null").select(F.col("user_id").alias("run_id"), F.row_number().over(order).alias("seq"), (F.col("event_type") == "error").alias("is_retry"))
    return R.budget(e).drop("is_retry")


def observed(spark, d):
    """Each strategy is a call that observes its first five passages."""
    return B.run(spark, d).where("rank <= 5").select("qid", "passage", F.col("strategy").alias("call"), "rank")


@register("agt07_accumulator", f"WITH {RUN_SQL}, l AS (SELECT qid, list(passage ORDER BY strategy, rank) AS p, list(strategy ORDER BY strategy, rank) AS c, list(rank ORDER BY strategy, rank) AS r FROM run WHERE rank <= 5 GROUP BY qid) SELECT qid, unnest(c) AS call, unnest(r) AS rank, unnest(p) AS passage, unnest([list_position(p, p[i]) = i for i in range(1, len(p) + 1)]) AS is_new FROM l")
def agt07(spark, d):
    return R.accumulate(observed(spark, d))


@register("agt08_stop_policy", f"""WITH {RUN_SQL}, o AS (SELECT qid, passage, strategy AS call, rank FROM run WHERE rank <= 5), s AS (SELECT qid, call, count_if(NOT EXISTS (SELECT 1 FROM o p WHERE p.qid = o.qid AND p.passage = o.passage AND (p.call, p.rank) < (o.call, o.rank))) AS fresh FROM o GROUP BY qid, call),
f AS (SELECT qid, call, CASE WHEN call % 2 = 0 AND qid % 5 = 0 THEN 0 ELSE fresh END AS fresh, CASE WHEN qid % 97 = 0 AND call = 2 THEN 'TIMEOUT' WHEN qid % 89 = 0 AND call = 3 THEN 'TOOL_FAILURE' END AS flag FROM s),
c AS (SELECT *, (SELECT count(*) FROM f z WHERE z.qid = f.qid AND z.call <= f.call AND z.call > coalesce((SELECT max(y.call) FROM f y WHERE y.qid = f.qid AND y.call <= f.call AND y.fresh > 0), -1)) AS idle, (SELECT sum(fresh) FROM f z WHERE z.qid = f.qid AND z.call <= f.call) AS got FROM f)
SELECT qid, call, fresh, idle, coalesce(flag, CASE WHEN call >= 7 THEN 'BUDGET_EXHAUSTED' WHEN got = 0 THEN 'NO_EVIDENCE' WHEN idle >= 2 THEN 'REPEATED_CALL_NO_NEW_EVIDENCE' ELSE 'CONTINUE' END) AS decision FROM c""")
def agt08(spark, d):
    """Every fifth question learns nothing from its even calls; some calls time out or fail."""
    q, c = F.col("qid"), F.col("call")
    fresh = R.accumulate(observed(spark, d)).groupBy("qid", "call").agg(F.count_if("is_new").alias("fresh"))
    calls = fresh.withColumn("fresh", F.when((c % 2 == 0) & (q % 5 == 0), 0).otherwise(F.col("fresh"))).withColumn("flag", F.when((q % 97 == 0) & (c == 2), "TIMEOUT").when((q % 89 == 0) & (c == 3), "TOOL_FAILURE"))
    return R.stop_decisions(calls, most_calls=7)


#: Number of each strategy in the run.
NUMBER = {"baseline": 1, "sentence_window": 3, "sentence_window_rerank": 4, "auto_merging": 6}
_ROUTE_SQL = "routes AS (SELECT qid, [1, 3, 4, 6, 4, NULL][qid % 6 + 1] AS strategy FROM (SELECT DISTINCT qid FROM run))"


def routes(spark, d):
    """A question of each class in turn, routed by the policy; the last of six finds no route."""
    classes = ["POSSIBLY_UNANSWERABLE", "PROCEDURAL_EXPLANATION", "COMPARISON", "GLOBAL_SUMMARY", "UNCLASSIFIED", "NONE"]
    k = F.element_at(F.array(*map(F.lit, classes)), (F.col("qid") % 6 + 1).cast("int"))
    number = F.create_map(*[F.lit(x) for kv in NUMBER.items() for x in kv])
    return B.run(spark, d).select("qid").distinct().select("qid", F.try_element_at(number, R.strategy_of(k)).alias("strategy"))


@register("agt09_one_shot", f"""WITH {RUN_SQL}, {_ROUTE_SQL}, e AS (SELECT r.qid, r.strategy, list(passage ORDER BY rank) FILTER (rank <= 3) AS p FROM routes r LEFT JOIN run ON run.qid = r.qid AND run.strategy = r.strategy GROUP BY ALL)
SELECT qid, strategy, coalesce(len(list_distinct(p)), 0) AS evidence, coalesce(len(p) - len(list_distinct(p)), 0) AS duplicates, CASE WHEN strategy IS NULL THEN 'INVALID_TOOL_ARGUMENTS' WHEN p IS NULL THEN 'NO_EVIDENCE' ELSE 'COMPLETED_ONE_SHOT' END AS stop, CASE WHEN len(list_distinct(p)) >= 2 THEN 'ANSWERED' ELSE 'ABSTAINED' END AS outcome FROM e""")
def agt09(spark, d):
    """Route, one call, evidence without repeats, stop reason and outcome."""
    top = B.run(spark, d).where("rank <= 3").select("qid", "strategy", "passage")
    e = routes(spark, d).join(top, ["qid", "strategy"], "left").groupBy("qid", "strategy").agg(F.count_distinct("passage").alias("evidence"), (F.count("passage") - F.count_distinct("passage")).alias("duplicates"))
    stop = F.when(F.col("strategy").isNull(), "INVALID_TOOL_ARGUMENTS").when(F.col("evidence") == 0, "NO_EVIDENCE").otherwise("COMPLETED_ONE_SHOT")
    return e.select("*", stop.alias("stop"), F.when(F.col("evidence") >= 2, "ANSWERED").otherwise("ABSTAINED").alias("outcome"))


def agent_calls(spark, d):
    """A question's calls: each strategy is one, of what it found first; some are retries, some fail."""
    run = B.run(spark, d).where("rank <= 5")
    found = run.groupBy("qid", "strategy").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), F.concat(F.lit("ps_"), "passage").alias("passage_id"), F.col("score").cast("double").alias("score")))).alias("f"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "qid", "strategy").cast("binary")), 1, 6), 16, 10).cast("long")
    status = F.when(h % 17 == 0, "TOOL_FAILURE").when(h % 41 == 0, "LEAKAGE_DETECTED").otherwise("EXECUTED")
    items = F.transform("f", lambda x: F.struct(x["passage_id"].alias("passage_id"), x["rank"].alias("rank"), x["score"].alias("score")))
    return found.select(F.concat(F.lit("q"), "qid").alias("query_id"), F.col("strategy").cast("int").alias("seq"), F.concat(F.lit("retrieve_"), "strategy").alias("tool_id"), F.concat(F.lit("pergunta é "), "qid").alias("arguments"), status.alias("status"), (h % 5 == 0).alias("retry"), items.alias("found"))


@register("agt09_trajectories")
def agt09_trajectories(spark, d):
    """Trajectories with steps, budgets, snapshots and hashes; a test replays them in plain Python."""
    t = trajectory.fold(agent_calls(spark, d))
    return t.select("query_id", F.size("steps").alias("n_steps"), F.size("evidence").alias("n_evidence"), "stop", "evidence_sha256", "trajectory_sha256")


@register("agt10_policy_replay", f"""WITH {METRIC_SQL}, {_ROUTE_SQL}, sc AS (SELECT strategy, qid, recall FROM metric WHERE recall IS NOT NULL AND qid % 50 <> 0), best AS (SELECT qid, max(recall) AS top FROM sc GROUP BY qid), j AS (SELECT r.qid, top, s.recall AS got FROM routes r LEFT JOIN best b ON b.qid = r.qid LEFT JOIN sc s ON s.qid = r.qid AND s.strategy = r.strategy),
m AS (SELECT strategy, round(avg(recall), 9) AS mean FROM sc GROUP BY strategy), f AS (SELECT strategy, mean FROM m ORDER BY mean DESC, strategy LIMIT 1), v AS (SELECT * FROM j WHERE got IS NOT NULL)
SELECT (SELECT count(*) FROM j) AS total, count(*) AS valid, (SELECT count(*) FROM j WHERE top IS NULL) AS no_results, (SELECT count(*) FROM j WHERE top IS NOT NULL AND got IS NULL) AS route_missing, round(avg(got), 6) AS routed_mean, round(avg(top), 6) AS oracle_mean, round(avg(top) - avg(got), 6) AS regret,
count_if(got - top > 1e-9) AS wins, count_if(abs(got - top) < 1e-9) AS ties, count_if(top - got >= 1e-9) AS losses, (SELECT strategy FROM f) AS fixed_best, (SELECT round(mean, 6) FROM f) AS fixed_mean FROM v""")
def agt10(spark, d):
    s = metric(spark, d).where("recall is not null and qid % 50 <> 0").select("qid", "strategy", F.col("recall").alias("score"))
    out = R.replay(s, routes(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith("mean") or c == "regret" else c for c in out.columns])


@register("agt11_tool_registry", f"""WITH {RUN_SQL}, {_ROUTE_SQL}, t AS (SELECT * FROM (VALUES ('auto_merging', 6), ('baseline', 1), ('sentence_window', 3), ('sentence_window_rerank', 4)) AS t(s, number)), c AS (SELECT strategy, count(*) AS calls FROM routes GROUP BY strategy)
SELECT 'retrieve_' || s AS tool_id, '1.0.0' AS version, 10 AS max_top_k, sha256('{{"allowed_strategies":["' || s || '"],"max_top_k":10,"network_access":false,"read_only":true,"version":"1.0.0"}}') AS spec_sha256, coalesce(calls, 0) AS calls FROM t LEFT JOIN c ON c.strategy = t.number""")
def agt11(spark, d):
    """The registry's tools with the hash of what they may do, and how many questions the policy routes to each."""
    tools = R.registry(spark)
    spec = F.struct("version", "read_only", F.col("network").alias("network_access"), "max_top_k", F.col("allowed").alias("allowed_strategies"))
    kind = tools.select(spec.alias("s")).schema["s"].dataType
    number = F.create_map(*[F.lit(x) for kv in NUMBER.items() for x in kv])
    own = tools.select("tool_id", "version", "max_top_k", canonical.digest(spec, kind).alias("spec_sha256"), F.try_element_at(number, F.get("allowed", F.lit(0))).alias("strategy"))
    calls = routes(spark, d).where("strategy is not null").groupBy("strategy").agg(F.count("*").alias("calls"))
    return own.join(calls, "strategy", "left").select("tool_id", "version", "max_top_k", "spec_sha256", F.coalesce("calls", F.lit(0)).alias("calls"))


#: Backends by the module that they need; the last is nowhere installed.
BACKENDS = [("arrow", "pyarrow"), ("tokenizers", "tokenizers"), ("onnx", "onnxruntime"), ("vector_index", "no_such_vector_index")]


@register("agt12_backends", """WITH b AS (SELECT * FROM (VALUES (0, 'arrow', true), (1, 'tokenizers', true), (2, 'onnx', true), (3, 'vector_index', false)) AS t(k, backend, available)), q AS (SELECT item_id % 4 AS k, count(*) AS n FROM benchmark WHERE item_id IS NOT NULL GROUP BY 1)
SELECT backend, available, CASE WHEN available THEN 'AVAILABLE' ELSE 'BACKEND_NOT_INSTALLED' END AS status, coalesce(n, 0) AS asked, CASE WHEN available THEN coalesce(n, 0) ELSE 0 END AS served FROM b LEFT JOIN q USING (k)""")
def agt12(spark, d):
    """Optional backends behind a barrier: questions ask for each in turn, and are served only where its module is installed."""
    from importlib.util import find_spec

    own = spark.createDataFrame([(i, n, find_spec(m) is not None) for i, (n, m) in enumerate(BACKENDS)], "k long, backend string, available boolean")
    asked = read(spark, d, "benchmark").where("item_id is not null").groupBy((F.col("item_id") % len(BACKENDS)).alias("k")).agg(F.count("*").alias("asked"))
    j = own.join(asked, "k", "left").withColumn("asked", F.coalesce("asked", F.lit(0)))
    ok = F.col("available")
    return j.select("backend", "available", F.when(ok, "AVAILABLE").otherwise("BACKEND_NOT_INSTALLED").alias("status"), "asked", F.when(ok, F.col("asked")).otherwise(0).alias("served"))


@register("flt16_routing_ladder", f"""WITH {CLASS_SQL}, r AS (SELECT conv_id, turn, CASE WHEN conv_id % 23 = 0 THEN '0.9' ELSE '1.0.0' END AS v, CASE WHEN conv_id % 19 = 0 THEN '' ELSE 'q' END AS id, CASE WHEN conv_id % 17 = 0 THEN '' WHEN conv_id % 13 = 0 THEN 'other' ELSE 'sha' END AS p,
  CASE WHEN conv_id % 11 = 0 THEN 'graph' ELSE {_MAP_SQL} END AS s, CASE WHEN conv_id % 7 = 0 THEN 1.5 WHEN conv_id % 5 = 0 THEN NULL ELSE 0.5 END AS c, conv_id % 9 = 0 AS leak FROM routed)
SELECT conv_id, turn, CASE WHEN v <> '1.0.0' THEN 'SCHEMA_MISMATCH' WHEN id = '' THEN 'MISSING_REQUIRED_FIELD' WHEN p <> 'sha' THEN 'POLICY_HASH_MISSING' WHEN s = 'graph' THEN 'INVALID_STRATEGY' WHEN c > 1 THEN 'CONFIDENCE_OUT_OF_RANGE' WHEN leak THEN 'LEAKAGE_DETECTED' ELSE 'VALID' END AS status FROM r""")
def flt16(spark, d):
    """Routing decisions with a fault for every rung of the ladder."""
    i = F.col("conv_id")
    c = questions(spark, d).withColumn("c", R.classify(F.col("question")))
    rows = c.select(
        "conv_id", "turn", F.when(i % 23 == 0, "0.9").otherwise("1.0.0").alias("schema_version"), F.when(i % 19 == 0, "").otherwise("q").alias("query_id"), F.when(i % 17 == 0, "").when(i % 13 == 0, "other").otherwise("sha").alias("policy_sha256"),
        F.when(i % 11 == 0, "graph").otherwise(R.strategy_of(F.col("c"))).alias("selected_strategy"), F.when(i % 7 == 0, 1.5).when(i % 5 != 0, 0.5).alias("confidence"), F.array(F.lit("length"), F.when(i % 9 == 0, "human_qrels path").otherwise("words")).alias("features"),
    )
    return rows.select("conv_id", "turn", R.validate_decision(rows, sorted(set(R.STRATEGY.values())), "sha").alias("status"))
