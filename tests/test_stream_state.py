"""The streaming admission keeps the state of many users in few entries and judges each user by itself."""

import datetime
import random

from rankwell.streaming import quota


def test_state_follows_buckets(spark, tmp_path):
    t0, r = datetime.datetime(2024, 1, 1), random.Random(5)
    rows = [(i, r.randrange(300), t0 + datetime.timedelta(seconds=r.randrange(4 * 3600))) for i in range(3000)]
    rows.sort(key=lambda x: (x[2] + datetime.timedelta(minutes=r.randrange(30)), x[0]))
    kind = "event_id long, user_id long, ts timestamp"
    for n in range(3):
        spark.createDataFrame(rows[n * 1000 : n * 1000 + 1000], kind).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    src = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stream = quota.admitted_stream(src, 2, 1800, late="1 hour", buckets=4)
    q = stream.writeStream.format("memory").queryName("bucketed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = {(x.event_id, x.user_id, x.ts, x.admitted) for x in spark.table("bucketed").collect()}
    mark = max(x[2] for x in rows) - datetime.timedelta(hours=1)
    want = {(x.event_id, x.user_id, x.ts, x.admitted) for x in quota.admitted(spark.createDataFrame(rows, kind), 2, 1800).collect() if x.ts < mark}
    assert got == want and len(got) > 1000
    # 300 users' held times and waiting events: per bucket two entries and a timer, and what counts list entries
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4 * 10
