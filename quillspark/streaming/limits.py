"""Time-based checks over a stream of events (or a table of them).

The same functions serve streaming and static tables where Spark allows it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def aligned_rates(events: DataFrame, key: str, most: int, every: str = "1 minute", at: str = "ts") -> DataFrame:
    """Windows in which a key has more than ``most`` events; windows start at full minutes."""
    rows = events.withWatermark(at, every) if events.isStreaming else events
    w = rows.groupBy(F.window(at, every).alias("w"), key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return w.select(F.col("w.start").alias("start"), key, "n")


def first_of_each(events: DataFrame, keys: list[str], within: str = "24 hours", at: str = "ts") -> DataFrame:
    """Idempotency: the first event of each key within the time, as a stream."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


class _Window(StatefulProcessor):
    """Counts a key's events in a window that starts with its first one; the window's end takes the state away."""

    def __init__(self, key: str, most: int, seconds: int, at: str):
        self.key, self.most, self.seconds, self.at = key, most, seconds, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.window = handle, handle.getValueState("window", "start double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(self.at, kind="stable")
        before = start = None
        n = 0
        if self.window.exists():
            start, n = self.window.get()
            before = start
        allowed = []
        for t in events[self.at]:
            now = t.timestamp()
            start, n = (now, 1) if start is None or now - start >= self.seconds else (start, n + 1)
            allowed.append(n <= self.most)
        self.window.update((start, n))
        if start != before:
            if before is not None:
                self.handle.deleteTimer(_millis(before + self.seconds))
            self.handle.registerTimer(_millis(start + self.seconds))
        yield pd.DataFrame({self.key: [key[0]] * len(events), self.at: events[self.at].values, "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def _millis(seconds: float) -> int:
    return int(round(seconds * 1000))


def anchored_rates(events: DataFrame, key: str, most: int, seconds: int = 60, at: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Every event with ``allowed``: windows start at a key's first event and last ``seconds``; a stream of events in order.

    A key's state goes when its window ends by the watermark, so it holds the keys
    of the last ``seconds`` alone.  Needs a RocksDB state store.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, at).withWatermark(at, late)
    return rows.groupBy(key).transformWithStateInPandas(_Window(key, most, seconds, at), f"{key} {kind}, {at} timestamp, allowed boolean", "Append", "EventTime")


class _Once(StatefulProcessor):
    """Remembers a key's first answer until it is ``seconds`` old."""

    def __init__(self, keys: list[str], seconds: int, at: str, answer: str):
        self.keys, self.seconds, self.at, self.answer = keys, seconds, at, answer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.first = handle, handle.getValueState("first", "start double, answer string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests = pd.concat(list(rows)).sort_values(self.at, kind="stable")
        before = start = answer = None
        if self.first.exists():
            start, answer = self.first.get()
            before = start
        out = []
        for t, own in zip(requests[self.at], requests[self.answer]):
            now = t.timestamp()
            fresh = start is None or now - start >= self.seconds
            if fresh:
                start, answer = now, own
            out.append((fresh, answer))
        self.first.update((start, answer))
        if start != before:
            if before is not None:
                self.handle.deleteTimer(_millis(before + self.seconds))
            self.handle.registerTimer(_millis(start + self.seconds))
        yield pd.DataFrame({**dict(zip(self.keys, key)), self.at: requests[self.at].values, "fresh": [f for f, _ in out], "answer": [a for _, a in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def idempotent(requests: DataFrame, keys: list[str], answer: str, seconds: int = 86_400, at: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Every request with ``fresh``, whether it is to be carried out, and ``answer``, that of the first one with its keys within
    ``seconds``: a repeated request gets the answer of the first, and after that time counts as a new one.

    State goes with the time by the watermark.  Needs a RocksDB state store.
    """
    kinds = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in keys)
    rows = requests.select(*keys, at, F.col(answer).cast("string").alias(answer)).withWatermark(at, late)
    return rows.groupBy(*keys).transformWithStateInPandas(_Once(keys, seconds, at, answer), f"{kinds}, {at} timestamp, fresh boolean, answer string", "Append", "EventTime")


def lockouts(events: DataFrame, key: str, failed, succeeded, most: int = 5, seconds: int = 900, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """Failures that lock a key: the ``most``-th or a later one in a run.

    A run ends with a success, or when ``seconds`` pass without a failure.  Runs
    are numbered by a window over each key's events in order.
    """
    from pyspark.sql import Window

    rows = events.where(failed | succeeded).withColumn("_f", failed)
    order = Window.partitionBy(key).orderBy(at, tie)
    long = F.lag(at).over(order) <= F.col(at) - F.make_dt_interval(secs=F.lit(seconds))
    cut = F.when(~F.lag("_f").over(order) | long | F.lag(at).over(order).isNull(), 1).otherwise(0)
    rows = rows.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(key, "_run").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("n_failures", F.sum(F.col("_f").cast("int")).over(run)).where(F.col("_f") & (F.col("n_failures") >= most)).drop("_f", "_cut", "_run")
