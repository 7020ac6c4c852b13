"""Routing of questions to strategies, governed execution, budgets, evidence and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankwell.operators.filters import leakage, leaks

#: Patterns of the classes, the first that matches decides; word edges and letters are Unicode. Fixed values.
CLASSES = {
    "POSSIBLY_UNANSWERABLE": r"\b(unanswerable|cannot\s+be\s+answered|not\s+(addressed|discussed|mentioned|covered)\s+(in|by)\s+the\s+(text|book|chapter|document))\b",
    "COMPARISON": r"\b(compar\w*|differ\w*|versus|vs\.?|contrast\w*|advantage|disadvantage)\b",
    "GLOBAL_SUMMARY": r"\b(summar\w*|overview|main\s+(idea|point|concept|theme)|what\s+is\s+the\s+(book|chapter|text)\s+about|explain\s+the\s+(overall|general|broad))\b",
    "PROCEDURAL_EXPLANATION": r"\b(how\s+(to|do|does|can|should|would)|step[s]?\s+(to|for|in)|process\s+(of|for)|procedure|method\s+for|approach\s+to)\b",
}
#: How a question about one fact begins, if it does not end with a question mark. Fixed values.
FACT = ["what", "where", "when", "who", "which"]
#: Strategy of each class. Fixed values.
STRATEGY = {
    "GLOBAL_SUMMARY": "auto_merging", "LOCALIZED_FACT": "sentence_window_rerank", "COMPARISON": "sentence_window_rerank",
    "PROCEDURAL_EXPLANATION": "sentence_window", "POSSIBLY_UNANSWERABLE": "baseline", "UNCLASSIFIED": "sentence_window_rerank",
}
MAX_QUERY, MAX_TOP_K = 10_000, 10
LOGICAL, PHYSICAL, RETRIES = 10, 20, 5


def classify(question: Column) -> Column:
    """Class of a question by its text alone; a blank one has none."""
    text = F.regexp_replace(F.coalesce(question, F.lit("")), r"(?U)^\s+|\s+$", "")
    out = None
    for name, pattern in CLASSES.items():
        hit = text.rlike(f"(?iU){pattern}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    fact = F.endswith(text, F.lit("?"))
    for word in FACT:
        fact = fact | F.startswith(F.lower(text), F.lit(word))
    return out.when(fact, "LOCALIZED_FACT").otherwise("UNCLASSIFIED")


def strategy_of(query_class: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STRATEGY.items() for x in kv]), query_class)


def validate_decision(d: DataFrame, allowed: list[str], policy_sha: str, version: str = "1.0.0") -> Column:
    """Status of a routing decision (schema_version, query_id, policy_sha256, selected_strategy, confidence, features): the first failing check."""
    c = F.col
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    return (
        F.when(F.coalesce(c("schema_version") != version, F.lit(True)), "SCHEMA_MISMATCH").when(blank(c("query_id")), "MISSING_REQUIRED_FIELD").when(blank(c("policy_sha256")), "POLICY_HASH_MISSING")
        .when(c("policy_sha256") != policy_sha, "POLICY_HASH_MISSING").when(~F.coalesce(c("selected_strategy").isin(allowed), F.lit(False)), "INVALID_STRATEGY")
        .when(~c("confidence").between(0, 1), "CONFIDENCE_OUT_OF_RANGE").when(F.exists(F.coalesce("features", F.array().cast("array<string>")), lambda x: leaks(x)), "LEAKAGE_DETECTED").otherwise("VALID")
    )


#: A tool for each strategy; they read only and need no network.
TOOLS = [(f"retrieve_{s}", "1.0.0", True, False, [s], MAX_TOP_K) for s in sorted({*STRATEGY.values()})]
TOOL_SCHEMA = "tool_id string, version string, read_only boolean, network boolean, allowed array<string>, max_top_k int"


def registry(spark, tools: list[tuple] = TOOLS) -> DataFrame:
    """The tools as a table; tools that write, need a network or are named twice are refused."""
    bad = [t[0] for t in tools if not t[2] or t[3]]
    names = [t[0] for t in tools]
    if bad or len(set(names)) != len(names):
        raise ValueError(f"not to be registered: {bad or sorted({n for n in names if names.count(n) > 1})}")
    return spark.createDataFrame(tools, TOOL_SCHEMA)


def execute(invocations: DataFrame, tools: DataFrame, logical: int = LOGICAL) -> DataFrame:
    """invocations (run_id, seq, tool_id, query, strategy, top_k, document_filter, passage_ids) with status.

    Checks in order: unknown tool, unauthorised, arguments, document filter and leaks, budget
    of logical calls, and after execution the ids of what came back.  Only calls that reach
    the budget use it up.
    """
    c = F.col
    bad_args = (F.trim(F.coalesce("query", F.lit(""))) == "") | (F.length("query") > MAX_QUERY) | ~F.coalesce(F.array_contains("allowed", c("strategy")), F.lit(False)) | ~F.coalesce(c("top_k").between(1, c("max_top_k")), F.lit(False))
    early = (
        F.when(c("read_only").isNull(), "UNKNOWN_TOOL").when(~c("read_only") | c("network"), "UNAUTHORIZED_TOOL").when(bad_args, "INVALID_ARGUMENTS").when(c("document_filter").isNotNull() | c("leaks"), "LEAKAGE_DETECTED")
    )
    j = leakage(invocations, "query").join(F.broadcast(tools), "tool_id", "left").withColumn("early", early)  # the registry of tools
    by = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    used = F.sum(c("early").isNull().cast("int")).over(by)
    late = F.when(c("used") > logical, "BUDGET_EXHAUSTED").when(F.exists("passage_ids", lambda p: ~F.startswith(p, F.lit("ps_"))), "NON_CANONICAL_ID").otherwise("EXECUTED")
    return j.withColumn("used", used).select("run_id", "seq", F.coalesce("early", late).alias("status"))


def budget(calls: DataFrame, logical: int = LOGICAL, physical: int = PHYSICAL, retries: int = RETRIES) -> DataFrame:
    """calls (run_id, seq, is_retry) with the three running counters, and the first limit that is passed."""
    by = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = F.col("is_retry").cast("int")
    out = calls.select("*", F.sum(1 - r).over(by).alias("logical"), F.count("*").over(by).alias("physical"), F.sum(r).over(by).alias("retries"))
    return out.withColumn("exceeded", F.when(F.col("logical") > logical, "LOGICAL").when(F.col("physical") > physical, "PHYSICAL").when(F.col("retries") > retries, "RETRIES"))


def accumulate(observed: DataFrame) -> DataFrame:
    """observed (qid, passage, call, rank) with is_new: the first time a passage is seen for a question."""
    first = Window.partitionBy("qid", "passage").orderBy("call", "rank")
    return observed.withColumn("is_new", F.row_number().over(first) == 1)


def stop_decisions(calls: DataFrame, most_calls: int, most_idle: int = 2) -> DataFrame:
    """calls (qid, call, fresh, flag) with idle (calls in a row without new evidence) and decision.

    flag names what went wrong with a call: of TIMEOUT, CANONICAL_ID_FAILURE,
    UNAUTHORIZED_TOOL, INVALID_TOOL_ARGUMENTS and TOOL_FAILURE the first counts; then the
    budget, then a question without any evidence, then idleness.
    """
    by = Window.partitionBy("qid").orderBy("call").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = calls.withColumn("grp", F.sum((F.col("fresh") > 0).cast("int")).over(by)).withColumn("evidence", F.sum("fresh").over(by))
    island = Window.partitionBy("qid", "grp").orderBy("call").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    idle = F.sum((F.col("fresh") == 0).cast("int")).over(island)
    decision = F.when(F.col("flag").isNotNull(), F.col("flag")).when(F.col("call") >= most_calls, "BUDGET_EXHAUSTED").when(F.col("evidence") == 0, "NO_EVIDENCE").when(F.col("idle") >= most_idle, "REPEATED_CALL_NO_NEW_EVIDENCE").otherwise("CONTINUE")
    return run.withColumn("idle", idle).select("qid", "call", "fresh", "idle", decision.alias("decision"))


def replay(scores: DataFrame, routed: DataFrame) -> DataFrame:
    """One row: a routing policy against every strategy, the best strategy of each question and the best fixed one.

    scores (qid, strategy, score), routed (qid, strategy; strategy null for a question
    without a route).  A question without a score for its route is not applicable.
    """
    per = scores.groupBy("qid").agg(F.max("score").alias("top"), F.map_from_entries(F.collect_list(F.struct(F.col("strategy").cast("string").alias("k"), "score"))).alias("m"))
    j = routed.join(per, "qid", "left").withColumn("got", F.try_element_at("m", F.col("strategy").cast("string")))
    ok = F.col("got").isNotNull()
    gap = F.when(ok, F.col("got") - F.col("top"))
    out = j.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(F.col("m").isNull()).alias("no_results"), F.count_if(F.col("m").isNotNull() & ~ok).alias("route_missing"),
        F.avg("got").alias("routed_mean"), F.avg(F.when(ok, F.col("top"))).alias("oracle_mean"), F.count_if(gap > 1e-9).alias("wins"), F.count_if(F.abs(gap) < 1e-9).alias("ties"), F.count_if(gap <= -1e-9).alias("losses"),
    )
    means = scores.groupBy("strategy").agg(F.round(F.avg("score"), 9).alias("mean"))
    best = means.agg(F.max(F.struct("mean", (-F.col("strategy")).alias("k"))).alias("b")).select((-F.col("b.k")).alias("fixed_best"), F.col("b.mean").alias("fixed_mean"))
    return out.crossJoin(best).withColumn("regret", F.when(F.col("oracle_mean") > 0, F.col("oracle_mean") - F.col("routed_mean")))  # one row each


def canonical_json(**fields: Column) -> Column:
    """JSON of ASCII strings, numbers and booleans with sorted keys and no blanks, for hashes that other engines can repeat."""
    return F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]), F.lit("}"))


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
