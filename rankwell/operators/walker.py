"""Walks nested records as JSON texts, of any shape: every value with its key and its path.

A text becomes a VARIANT, and each step explodes the objects and arrays of the step before;
what is neither stays.  There are as many steps as the deepest text has levels, which one
scan over the brackets finds.  Steps are generators in one chain, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A quoted string of a JSON text.
STRING = r'"(?:[^"\\]|\\.)*+"'
#: Keys whose value must be a canonical id, and the one value that may stand in its place. Fixed values.
ID_KEYS, UNMAPPED = ["passage_id", "canonical_passage_id"], "UNMAPPED_NEEDS_REVIEW"
#: Records of a task on average: what tasks hold follows this and not the table.
TASK_RECORDS = 25_000


def depth(text: Column) -> Column:
    """How many objects and arrays of a JSON text lie in each other at most."""
    brackets = F.split(F.regexp_replace(F.regexp_replace(text, STRING, ""), r"[^\[\]{}]+", ""), "")
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def walk(records: DataFrame, text: str, key: list[str], stop: list[str] | None = None) -> DataFrame:
    """key columns, path, name, keyed, kind, value of every value below the top of each record's text.

    A path joins object keys by dots and counts array places in brackets, from 0.  name is the key
    that a value stands under (in an array, the array's key; keyed is false there), kind its schema:
    OBJECT<...>, ARRAY<...>, STRING, BIGINT, VOID and so on; value is a string's text, else JSON.  Below
    keys in stop nothing is walked.  A text that is no JSON, or repeats a key, is one row of kind INVALID
    without a path; a null text and a text without members give none.
    """
    most, n = records.agg(F.max(depth(F.col(text))), F.count(text)).first()  # two numbers
    tasks = max(records.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_RECORDS))
    own = records.where(F.col(text).isNotNull()).select(*key, F.col(text).alias("_text")).repartition(tasks, *key)
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("INVALID"))
    now = own.select(*key, F.lit("").alias("path"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("keyed"), F.try_parse_json("_text").alias("v"), F.col("_text").isNotNull().alias("open"), F.array().cast("array<struct<path:string,name:string,keyed:boolean,kind:string,value:string>>").alias("above"))
    now = now.withColumn("_kind", kind(F.col("v")))  # a kind is made once, when its value is met
    shown = F.when(F.startswith("_kind", F.lit("STRING")), F.variant_get("v", "$", "string")).when(~F.is_variant_null("v"), F.to_json("v"))
    for _ in range(most or 0):
        view = F.coalesce(F.col("open") & (F.startswith("_kind", F.lit("OBJECT")) | F.startswith("_kind", F.lit("ARRAY"))), F.lit(False))
        now = now.withColumn("inner", F.when(view, F.col("v")))
        step = now.lateralJoin(now.sparkSession.tvf.variant_explode_outer(F.col("inner").outer()).toDF("_pos", "_key", "_value"))
        below = F.col("inner").isNotNull() & F.col("_pos").isNotNull()
        path = F.when(F.col("_key").isNotNull(), F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "_key")).otherwise(F.concat("path", F.lit("["), "_pos", F.lit("]")))
        name = F.coalesce("_key", "name")
        v = F.when(below, F.col("_value")).otherwise(F.col("v"))
        # a container's own row travels with its first member, as one of an empty container does by itself
        mine = F.array(F.struct("path", "name", "keyed", F.col("_kind").alias("kind"), shown.alias("value")))
        above = F.when(~below, F.col("above")).when(F.col("_pos") == 0, F.concat("above", F.when(F.col("path") == "", F.slice(mine, 1, 0)).otherwise(mine))).otherwise(F.slice("above", 1, 0))
        goes_on = below & ~F.coalesce(name.isin(stop or []) & F.col("_key").isNotNull(), F.lit(False))
        now = step.select(*key, F.when(below, path).otherwise(F.col("path")).alias("path"), F.when(below, name).otherwise(F.col("name")).alias("name"), F.when(below, F.col("_key").isNotNull()).otherwise(F.col("keyed")).alias("keyed"), v.alias("v"), F.when(below, kind(F.col("_value"))).otherwise(F.col("_kind")).alias("_kind"), goes_on.alias("open"), above.alias("above"))
    last = F.array(F.struct("path", "name", "keyed", F.col("_kind").alias("kind"), shown.alias("value")))
    whole = F.when((F.col("path") == "") & F.col("v").isNotNull(), F.col("above")).otherwise(F.concat("above", last))
    return now.select(*key, F.explode(whole).alias("n")).select(*key, "n.*")


def bad_ids(records: DataFrame, text: str, key: list[str]) -> DataFrame:
    """key columns, path, kind, value of every id anywhere in a record that is no canonical one; below an id nothing is looked at."""
    found = walk(records, text, key, ID_KEYS)
    good = F.startswith("value", F.lit("ps_")) & ~F.contains("value", F.lit("_rank")) | (F.col("value") == UNMAPPED)
    bad = F.col("keyed") & F.col("name").isin(ID_KEYS) & ~F.coalesce((F.col("kind") == "STRING") & good, F.lit(False))
    return found.where((F.col("kind") == "INVALID") | bad).select(*key, "path", "kind", "value")


def forbidden_keys(records: DataFrame, text: str, key: list[str], forbidden: list[str], any_case: bool = True) -> DataFrame:
    """key columns, path, name of every key anywhere in a record that is forbidden."""
    name = F.lower("name") if any_case else F.col("name")
    return walk(records, text, key).where(F.col("keyed") & name.isin(forbidden)).select(*key, "path", "name")


def revealing(records: DataFrame, text: str, key: list[str], fields: list[str], words: list[str], reasons: str) -> DataFrame:
    """key columns, path, what: forbidden fields anywhere in a record, and words in texts under reasons, at any depth of lists."""
    found = walk(records, text, key)
    said = F.when((F.col("name") == reasons) & (F.col("kind") == "STRING"), F.filter(F.array(*map(F.lit, sorted(words))), lambda w: F.contains(F.lower("value"), w)))
    field = F.when(F.col("keyed") & F.col("name").isin(fields), F.array("name"))
    return found.select(*key, "path", F.explode(F.concat(F.coalesce(field, F.array()), F.coalesce(said, F.array()))).alias("what"))
