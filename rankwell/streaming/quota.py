"""Sliding-window admission: an event passes while fewer than `limit` admitted ones lie in the window.

State holds admitted times only, at most `limit` for each user, in batch; in streaming also
the events that the watermark has not passed yet, so that they are judged in event time.

In batch a user's events are cut into stretches where the user was silent for a window: the
state is empty there, so stretches are judged apart, and a user of very many events is as many
tasks as there are such silences.  Only a stretch without one is judged as one stream.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

OUT = "event_id long, user_id long, ts timestamp, admitted boolean"
#: Slots of a window by which silences are found: one of a window and a slot at most is always seen.
SLOTS = 8
#: Parts of the users whose streaming state is kept together.
BUCKETS = 2048


def _judge(times: list[int], held: deque, limit: int, width: int) -> list[bool]:
    """Whether each time (microseconds, ascending) is admitted; held is the user's admitted times and is kept up."""
    out = []
    for t in times:
        while held and t - held[0] >= width:
            held.popleft()
        ok = len(held) < limit
        out.append(ok)
        if ok:
            held.append(t)
    return out


def stretches(events: DataFrame, width: int) -> DataFrame:
    """events (user_id, us, ...) with stretch: it changes only after a silence of the user of at least width microseconds.

    Silences are found between the slots of time that a user has any event in, which are few
    rows however many events there are; events then meet the stretch of their slot.
    """
    size = max(1, -(-width // SLOTS))
    slot = F.expr(f"(us - pmod(us, {size}L)) div {size}L")
    used = events.select("user_id", slot.alias("slot")).distinct()
    by = Window.partitionBy("user_id").orderBy("slot")
    # empty slots between two used ones make up a window
    new = F.coalesce(F.col("slot") - F.lag("slot").over(by) - 1, F.lit(SLOTS)) * size >= width
    starts = used.withColumn("new", new).withColumn("stretch", F.max(F.when(F.col("new"), F.col("slot"))).over(by)).select("user_id", "slot", "stretch")
    return events.withColumn("slot", slot).join(starts, ["user_id", "slot"]).drop("slot")


def admitted(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """Batch form: events stream through a task in order of user and time; only the current stretch's state is held.

    Whether an event passes depends on all before it in its stretch.  Events without user or
    time are left out; of equal times the smaller event_id is first.
    """
    width = int(seconds * 1_000_000)
    cols = events.where("user_id is not null and ts is not null").select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))

    def run(batches):
        last, held = None, deque()
        for b in batches:
            users, stretch, times = (np.asarray(b.column(c)) for c in ("user_id", "stretch", "us"))
            change = (users[1:] != users[:-1]) | (stretch[1:] != stretch[:-1])
            starts = np.flatnonzero(np.append(True, change)) if len(users) else []
            flags = []
            for lo, hi in zip(starts, [*starts[1:], len(users)], strict=True):
                if (users[lo], stretch[lo]) != last:
                    last, held = (users[lo], stretch[lo]), deque()
                flags += _judge(times[lo:hi].tolist(), held, limit, width)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), b.column("user_id"), b.column("ts"), pa.array(flags, pa.bool_())], names=["event_id", "user_id", "ts", "admitted"])

    return stretches(cols, width).repartition("user_id", "stretch").sortWithinPartitions("user_id", "stretch", "us", "event_id").mapInArrow(run, OUT)


class _Admission(StatefulProcessor):
    """State of a bucket of users: times of admitted events, and events that the watermark has not passed; a timer wakes it for the first of either.

    Both are kept as packed columns, an entry for each batch of input, as every entry is a call to the state store.
    """

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "packed binary")
        self.pending = handle.getListState("pending", "packed binary")

    def handleInputRows(self, key, rows, timerValues):
        new = [np.stack([b[c].to_numpy(np.int64) for c in ("user_id", "us", "event_id")]) for b in rows]
        self.pending.appendList([(x.tobytes(),) for x in new])
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        first = min((int(x[1].min()) for x in new if x.size), default=mark)
        if first < mark:
            yield from self._pass(mark)
        else:  # older ones that are due have a timer
            self._wake(first // 1000 + 1, keep=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self._pass(timerValues.getCurrentWatermarkInMs() * 1000)

    def _wake(self, at: int | None, keep: bool = False) -> None:
        """Sets the bucket's only timer; keep leaves one that is not later."""
        old = list(self.handle.listTimers())
        if keep and old and min(old) <= at:
            return
        for t in old:
            self.handle.deleteTimer(t)
        if at is not None:
            self.handle.registerTimer(at)

    @staticmethod
    def _read(state, n: int) -> np.ndarray:
        return np.concatenate([np.zeros((n, 0), np.int64), *(np.frombuffer(x[0], np.int64).reshape(n, -1) for x in state.get())], axis=1)

    def _pass(self, mark: int):
        """Judges what the watermark has passed, lets state expire, and sets the next timer."""
        import pandas as pd

        pending, held = self._read(self.pending, 3), self._read(self.held, 2)
        ready, wait = pending[:, pending[1] < mark], pending[:, pending[1] >= mark]
        ready = ready[:, np.lexsort((ready[2], ready[1], ready[0]))]
        users, starts = np.unique(ready[0], return_index=True)
        old = np.isin(held[0], users)
        open_: dict[int, list[int]] = {}
        for u, t in held[:, old].T.tolist():
            open_.setdefault(u, []).append(t)
        times, flags, kept = ready[1].tolist(), [], []
        for u, lo, hi in zip(users.tolist(), starts.tolist(), [*starts[1:].tolist(), len(times)], strict=True):
            own = deque(sorted(open_.get(u, ())))
            flags += _judge(times[lo:hi], own, self.limit, self.width)
            kept += [(u, t) for t in own]
        held = np.concatenate([held[:, ~old], np.array(kept, np.int64).reshape(-1, 2).T], axis=1)
        held = held[:, mark - held[1] < self.width]
        for state, rows in ((self.pending, wait), (self.held, held)):
            state.put([(np.ascontiguousarray(rows).tobytes(),)]) if rows.size else state.clear()
        nexts = [int(x) for x in ([wait[1].min()] if wait.size else []) + ([held[1].min() + self.width] if held.size else [])]
        self._wake(max(min(nexts) // 1000, mark // 1000) + 1 if nexts else None)
        if len(times):
            yield pd.DataFrame({"event_id": ready[2], "user_id": ready[0], "us": ready[1], "admitted": flags})

    def close(self) -> None:
        pass


def admitted_stream(events: DataFrame, limit: int, seconds: float, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Streaming form: events wait until the watermark has passed them and are judged in order of time.

    Users share the state of their bucket, each judged by itself: calls to the state store follow the
    buckets and not the users.  A user's part goes once nothing waits and the admitted events have left the window.
    Events later than the watermark are dropped by Spark, which counts them in the query's
    progress.  State lies in RocksDB, which the session is set to; buckets must stay as they are for a checkpoint.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cols = events.where("user_id is not null and ts is not null").withWatermark("ts", late)
    user, event = F.col("user_id").cast("long"), F.col("event_id").cast("long")
    cols = cols.select(F.pmod(F.xxhash64(user), F.lit(buckets)).alias("bucket"), user.alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), event.alias("event_id"), "ts")
    done = cols.groupBy("bucket").transformWithStateInPandas(_Admission(limit, int(seconds * 1_000_000)), "event_id long, user_id long, us long, admitted boolean", "append", "eventTime")
    return done.select("event_id", "user_id", F.timestamp_micros("us").alias("ts"), "admitted")
