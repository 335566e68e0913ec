"""First-in, first-out matching of two kinds of events as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a key keeps: events that wait, as rows of three long numbers (microseconds, event, whether it is a left one), and when its timer rings (milliseconds).
_STATE = T.StructType([T.StructField("pending", T.BinaryType()), T.StructField("queue", T.BinaryType()), T.StructField("timer", T.LongType())])


def _packed(rows: list[tuple]) -> bytes:
    return np.array(rows, np.int64).tobytes()


def _unpacked(stored: bytes) -> list[tuple]:
    return list(map(tuple, np.frombuffer(stored, np.int64).reshape(-1, 3).tolist()))


class FifoMatcher(StatefulProcessor):
    """The n-th left event of a key with its n-th right one, in the order of time and event number.

    Events wait until the watermark has passed them, so that none can come in between. Then they are
    matched; what finds no partner waits on in a queue, which holds one kind of event only. A key without waiting events has
    no state. An event that waits for longer than patience (in event time) leaves without a partner, and the events
    after it move up. Each call of the state's store costs more than a match, so all of a key's state is one value, and it has one timer.
    """

    def __init__(self, key: T.StructField, patience_ms: int):
        self.key, self.patience = key, 1000 * patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", _STATE)

    def _read(self) -> tuple[list[tuple], list[tuple], int | None]:
        got = self.state.get()
        return (_unpacked(got[0]), _unpacked(got[1]), got[2]) if got else ([], [], None)

    def _keep(self, pending: list[tuple], queue: list[tuple], timer: int | None) -> None:
        """Keep what waits, and come back when all that is pending is final, or the first of the queue has waited for long enough.

        A timer that rings earlier stays: what isn't final by then waits for another one.
        """
        when = [max(x[0] for x in pending)] if pending else []
        when += [queue[0][0] + self.patience] if queue else []
        if not when:
            self.state.clear()
            return
        at = min(when) // 1000 + 1
        if timer is None or at < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
            timer = at
        self.state.update((_packed(pending), _packed(queue), timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending, queue, timer = self._read()
        for part in rows:
            pending += zip(*[part[c].to_numpy(np.int64).tolist() for c in ("at", "event", "is_left")], strict=True)
        self._keep(pending, queue, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = 1000 * timerValues.getCurrentWatermarkInMs()
        (pending, queue, _), out = self._read(), []
        final = sorted(x for x in pending if x[0] < now)
        pending = [x for x in pending if x[0] >= now]
        head = 0
        for event in final:
            while head < len(queue) and queue[head][0] + self.patience < event[0]:
                out.append((queue[head], None))
                head += 1
            if head < len(queue) and queue[head][2] != event[2]:
                out.append((queue[head], event))
                head += 1
            else:
                queue.append(event)
        while head < len(queue) and queue[head][0] + self.patience < now:
            out.append((queue[head], None))
            head += 1
        queue = queue[head:]
        self._keep(pending, queue, None)  # the one timer has rung
        if out:
            sides = [(a[1], b and b[1]) if a[2] else (b and b[1], a[1]) for a, b in out]
            left, right = zip(*sides, strict=True)
            yield pd.DataFrame({"key": [key[0]] * len(out), "left_event": pd.array(left, "Int64"), "right_event": pd.array(right, "Int64")})

    def close(self) -> None:
        pass


def fifo_matches(events: DataFrame, key: str, time: str, event: str, is_left, delay: str = "0 seconds", patience_ms: int = 10 * 365 * 86_400_000) -> DataFrame:
    """A stream of key, left_event, right_event from a stream of events (event: long numbers that break ties of time).

    is_left: a condition that tells the two kinds apart. Rows that come later than the watermark, which is delay behind
    the newest time, are dropped. Keys, times and numbers must not be null; such rows are left out. Needs the RocksDB state store.
    """
    at = F.unix_micros(F.col("_time"))
    rows = events.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("_time"), F.col(event).cast("long").alias("event"), is_left.alias("is_left"))
    rows = rows.dropna().withColumn("at", at).withWatermark("_time", delay)
    field = T.StructField("key", events.schema[key].dataType)
    out = T.StructType([field, T.StructField("left_event", T.LongType()), T.StructField("right_event", T.LongType())])
    return rows.groupBy("key").transformWithStateInPandas(FifoMatcher(field, patience_ms), out, "Append", "EventTime")
