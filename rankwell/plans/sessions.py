"""Queries on annotation sessions; the twins go through each item's events one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankwell.operators import sessions as S
from rankwell.plans.base import read, register

_LOG_SQL = """h AS (SELECT event_id, user_id, event_type, md5(event_id::VARCHAR) AS h, value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL),
log AS (SELECT user_id AS annotator, event_type AS qid, 'ps_' || (('0x' || substr(h, 1, 4))::INT % 3) AS passage, event_id AS seq, CASE WHEN substr(h, 5, 1) < '5' THEN 'UNLOCK' WHEN substr(h, 5, 1) = '5' THEN 'DELETE' ELSE 'SAVE' END AS action,
  CASE WHEN substr(h, 6, 1) = '0' THEN 'old' ELSE 'v' || user_id % 3 END AS version, coalesce(floor(value) % 5 < 4, false) AS valid FROM h),
queue AS (SELECT DISTINCT annotator, qid, passage, 'v' || annotator % 3 AS version FROM log WHERE passage <> 'ps_2' OR qid <> 'view'),
k AS (SELECT l.*, CASE WHEN q.version IS NULL THEN 'UNKNOWN_ITEM' WHEN q.version <> l.version THEN 'STALE' WHEN action = 'UNLOCK' THEN 'UNLOCKED' WHEN action <> 'SAVE' THEN 'UNKNOWN_ACTION' WHEN NOT valid THEN 'INVALID' END AS early,
  row_number() OVER (PARTITION BY l.annotator, l.qid, l.passage ORDER BY seq) AS n FROM log l LEFT JOIN queue q USING (annotator, qid, passage)),
st AS (SELECT annotator, qid, passage, n, seq, coalesce(early, 'SAVED') AS status, early IS NULL AS done, coalesce(early = 'UNLOCKED', false) AS opened FROM k WHERE n = 1
 UNION ALL SELECT k.annotator, k.qid, k.passage, k.n, k.seq, coalesce(early, CASE WHEN st.done AND NOT st.opened THEN 'LOCKED' ELSE 'SAVED' END), st.done OR early IS NULL,
  CASE WHEN early = 'UNLOCKED' THEN true WHEN early IS NULL AND (NOT st.done OR st.opened) THEN false ELSE st.opened END FROM st JOIN k ON k.annotator = st.annotator AND k.qid = st.qid AND k.passage = st.passage AND k.n = st.n + 1)"""


def log(spark, d):
    """Events of sessions: saves, unlocks and what is neither, some against an old version of the queue, some with invalid content."""
    e = read(spark, d, "events").where("user_id is not null and event_type is not null").withColumn("h", F.md5(F.col("event_id").cast("string").cast("binary")))
    five = F.substring("h", 5, 1)
    passage = F.concat(F.lit("ps_"), F.conv(F.substring("h", 1, 4), 16, 10).cast("int") % 3)
    version = F.when(F.substring("h", 6, 1) == "0", "old").otherwise(F.concat(F.lit("v"), F.col("user_id") % 3))
    return e.select(
        F.col("user_id").alias("annotator"), F.col("event_type").alias("qid"), passage.alias("passage"), F.col("event_id").alias("seq"),
        F.when(five < "5", "UNLOCK").when(five == "5", "DELETE").otherwise("SAVE").alias("action"), version.alias("version"), F.coalesce(F.floor("value") % 5 < 4, F.lit(False)).alias("valid"),
    )


def queue(spark, d):
    own = log(spark, d).where("passage != 'ps_2' or qid != 'view'")
    return own.select("annotator", "qid", "passage", F.concat(F.lit("v"), F.col("annotator") % 3).alias("version")).distinct()


@register("ann10_sessions", f"WITH RECURSIVE {_LOG_SQL} SELECT annotator, qid, passage, seq, status FROM st")
def ann10_sessions(spark, d):
    """Every event of every session with what came of it."""
    return S.judge(log(spark, d), queue(spark, d)).select("annotator", "qid", "passage", "seq", "status")


@register("ann10_session_progress", f"""WITH RECURSIVE {_LOG_SQL}, f AS (SELECT annotator, qid, passage, min(seq) AS seq FROM st WHERE status = 'SAVED' GROUP BY ALL)
SELECT annotator, seq, (SELECT count(*) FROM f g WHERE g.annotator = f.annotator AND g.seq <= f.seq)::INT AS completed, (SELECT count(*) FROM queue q WHERE q.annotator = f.annotator) - (SELECT count(*) FROM f g WHERE g.annotator = f.annotator AND g.seq <= f.seq) AS remaining,
round((SELECT count(*) FROM f g WHERE g.annotator = f.annotator AND g.seq <= f.seq)::DOUBLE / (SELECT count(*) FROM queue q WHERE q.annotator = f.annotator) * 100, 1) AS percent FROM f""")
def ann10_progress(spark, d):
    """Each annotator's progress after every completed item."""
    return S.progress(S.judge(log(spark, d), queue(spark, d)), queue(spark, d))
