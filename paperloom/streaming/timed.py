"""Rules over one key's events whose states end by themselves: locks, leases, buckets.

A rule is judged row by row in the order of event time.  What its state does when nothing
happens is a matter of timers: in a stream the state of a key is removed, and its end
reported, once the watermark has passed it, so that only keys that still have something to
remember take room.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Spark's state store for states with timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
OUT = "event_id long, at double, kind string, accepted boolean"


class Rule:
    """What a key remembers (a tuple, or None for nothing), what a row does to it, and when it ends."""

    state = ""  # its columns

    def step(self, state: tuple | None, row: Any) -> tuple[tuple | None, bool]:
        """The state after a row, and whether the row is accepted."""
        raise NotImplementedError

    def end(self, state: tuple) -> float | None:
        """The second at which the state is as good as none; None if never."""
        raise NotImplementedError

    def report(self, state: tuple) -> str | None:
        """How an end is reported, if it is."""
        return None


class TokenBucket(Rule):
    """At most ``capacity`` requests at once, refilled at ``per_second``; a full bucket is no state.

    ``slack`` is what a token may lack by rounding: a third and two thirds of a token are one.
    """

    state = "tokens double, last double"

    def __init__(self, capacity: float, per_second: float, slack: float = 1e-9):
        self.capacity, self.per_second, self.slack = float(capacity), float(per_second), float(slack)

    def step(self, state, row):
        tokens, last = state or (self.capacity, row.at)
        tokens = min(self.capacity, tokens + max(0.0, row.at - last) * self.per_second)
        passed = tokens >= 1 - self.slack
        return (tokens - passed, max(last, row.at)), passed

    def end(self, state):
        return state[1] + (self.capacity - state[0]) / self.per_second


class Lockout(Rule):
    """So many failures without a success lock a key for ``seconds``; rows of a locked key are not accepted and count nothing.

    The lock starts the counter anew.  ``good`` says whether a row is a success.  Failures
    alone are remembered until a success or a lock.
    """

    state = "failures int, until double"

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, float(seconds)

    def step(self, state, row):
        failures, until = state or (0, 0.0)
        if row.at < until:
            return (failures, until), False
        if row.good:
            return None, True
        return ((failures + 1, 0.0) if failures + 1 < self.most else (0, row.at + self.seconds)), True

    def end(self, state):
        return state[1] if state[1] > 0 else None

    def report(self, state):
        return "unlocked"


class Lease(Rule):
    """A job is held by the worker that claims it until its lease is over; only the holder extends or ends it.

    Rows have ``action`` (claim, heartbeat or done) and ``worker``.
    """

    state = "holder string, until double"

    def __init__(self, seconds: float):
        self.seconds = float(seconds)

    def step(self, state, row):
        if row.action == "claim" and state is None:
            return (row.worker, row.at + self.seconds), True
        if state is None or state[0] != row.worker or row.action == "claim":
            return state, False
        return (None if row.action == "done" else (row.worker, row.at + self.seconds)), True

    def end(self, state):
        return state[1]

    def report(self, state):
        return "expired"


class _Key:
    """One key's rows against its rule; ``out`` gathers what is to be returned."""

    def __init__(self, rule: Rule, state: tuple | None):
        self.rule, self.state, self.out = rule, state, []

    def pass_time(self, now: float) -> None:
        end = self.rule.end(self.state) if self.state is not None else None
        if end is not None and end <= now:
            kind = self.rule.report(self.state)
            if kind:
                self.out.append((None, end, kind, None))
            self.state = None

    def row(self, row: Any) -> None:
        self.pass_time(row.at)
        self.state, accepted = self.rule.step(self.state, row)
        self.out.append((row.event_id, row.at, "row", accepted))


class _Processor(StatefulProcessor):
    def __init__(self, rule: Rule, names: list[str]):
        self.rule, self.names = rule, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.saved = handle.getValueState("state", self.rule.state)

    def _save(self, key: _Key, watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if key.state is None:
            self.saved.clear()
            return
        self.saved.update(key.state)
        end = self.rule.end(key.state)
        if end is not None:
            self.handle.registerTimer(max(int(end * 1000) + 1, watermark + 1))

    def _frame(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["event_id", "at", "kind", "accepted"]).astype({"event_id": "Int64", "at": float, "accepted": "boolean"})
        for name, value in zip(reversed(self.names), reversed(key), strict=True):
            frame.insert(0, name, pd.Series([value] * len(frame), dtype=object))
        return frame

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        one = _Key(self.rule, tuple(self.saved.get()) if self.saved.exists() else None)
        for row in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples():
            one.row(row)
        self._save(one, timerValues.getCurrentWatermarkInMs())
        yield self._frame(key, one.out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.saved.exists():
            one = _Key(self.rule, tuple(self.saved.get()))
            one.pass_time(expiredTimerInfo.getExpiryTimeInMs() / 1000)
            self._save(one, timerValues.getCurrentWatermarkInMs())
            if one.out:
                yield self._frame(key, one.out)

    def close(self) -> None:
        pass


def judged(events: DataFrame, key: str, rule: Rule, at: str = "ts", late: str = "0 seconds") -> DataFrame:
    """``key, event_id, at, kind, accepted``: a row an event (kind ``row``), and one a reported end of a state.

    ``events`` have ``event_id``, the key, the time and what the rule reads.  Null keys are a
    key like others.  A table is sorted by key and time, and a key's rows pass through one
    task a batch at a time, with nothing but the state held; an end is reported when a later
    row of its key has passed it.  A stream takes rows by batch; ends are reported once the
    watermark, ``late`` behind the newest event, has passed them; rows behind the watermark
    are dropped.  A stream needs the settings ``STORE``.
    """
    seconds = events.withColumn("at", F.unix_micros(F.col(at).cast("timestamp")) / 1e6)
    kind = dict(events.dtypes)[key]
    if events.isStreaming:
        marked = seconds.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
        return marked.groupBy(key).transformWithStateInPandas(_Processor(rule, [key]), f"`{key}` {kind}, {OUT}", "append", "EventTime")
    ordered = seconds.repartition(key).sortWithinPartitions(key, "at", "event_id")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = one = None
        for batch in batches:
            keys, out = [], []
            for row in map(_Row, batch.to_pylist()):
                own = (getattr(row, key),)
                if own != before:
                    one, before = _Key(rule, None), own
                one.row(row)
                keys += own * len(one.out)
                out += one.out
                one.out = []
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.record_batch([pa.array(keys, batch.schema.field(key).type), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.string(), pa.bool_()), strict=True))], [key, "event_id", "at", "kind", "accepted"])

    return ordered.mapInArrow(whole, f"`{key}` {kind}, {OUT}")


class _Row:
    def __init__(self, values: dict[str, Any]):
        self.__dict__.update(values)
