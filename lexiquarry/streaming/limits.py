"""Rate limits, lockouts and usage, on finished logs and on streams.

Logs are sorted by key and time within partitions and walked once; what is carried from row to row is a few numbers, so a key's rows are never
held together, however many there are. Times are compared in whole microseconds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MICROS = 1_000_000


class Window:
    """Sliding-window log of one key: the admitted times of the last window, ``most`` at most. Rejected calls don't count."""

    def __init__(self, most: int, seconds: float, recent: list[int] | None = None) -> None:
        self.most, self.width, self.recent = most, round(seconds * _MICROS), list(recent or [])

    def call(self, time: int) -> bool:
        self.recent = [x for x in self.recent if time - x < self.width]
        admitted = len(self.recent) < self.most
        if admitted:
            self.recent.append(time)
        return admitted


class Lock:
    """Failures of one key since the last success or block, and the end of its block."""

    def __init__(self, attempts: int, seconds: float, failures: int = 0, until: int = 0) -> None:
        self.attempts, self.width, self.failures, self.until = attempts, round(seconds * _MICROS), failures, until

    def login(self, time: int, ok: bool | None) -> str:
        if self.until > time:
            return "blocked"
        if ok:
            self.failures = self.until = 0
            return "ok"
        self.failures += 1
        if self.failures >= self.attempts:
            self.failures, self.until = 0, time + self.width
        return "failed"


def _walk(log: DataFrame, keys: tuple[str, ...], time: str, tie: str, fresh: Callable[[], Any], told: Callable[..., Any], also: tuple[str, ...], column: str, kind: T.DataType) -> DataFrame:
    """``log`` with ``column``: told(state, time, *also) of each row in order, by one pass over rows sorted by key; rows without a time get null and change nothing."""
    order = [*keys, time, tie]
    ordered = log.repartition(*keys).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    out = T.StructType([f for f in log.schema.fields if f.name != column] + [T.StructField(column, kind)])
    arrow = {T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, fresh()
        for b in batches:
            times = b.column(time).cast(pa.timestamp("us", b.schema.field(time).type.tz)).cast(pa.int64()).to_pylist()
            found = []
            for own, t, *more in zip(zip(*[b.column(k).to_pylist() for k in keys]), times, *[b.column(c).to_pylist() for c in also]):
                if own != key:
                    key, state = own, fresh()
                found.append(None if t is None else told(state, t, *more))
            rest = [f.name for f in out.fields[:-1]]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in rest], pa.array(found, arrow)], names=[*rest, column])

    return ordered.mapInArrow(run, out)


def rate_limited(calls: DataFrame, most: int, seconds: float, keys: tuple[str, ...] = ("address", "path"), time: str = "ts", tie: str = "id") -> DataFrame:
    """Adds admitted to calls (with a key's calls in order of time and ``tie``); null for calls without a time.

    Whether a call is admitted depends on those admitted before it, so a key's calls are walked in order; its state is ``most`` times at most.
    """
    return _walk(calls, keys, time, tie, lambda: Window(most, seconds), Window.call, (), "admitted", T.BooleanType())


def lockouts(logins: DataFrame, attempts: int = 3, block: float = 300.0, key: str = "address", time: str = "ts", ok: str = "ok", tie: str = "id") -> DataFrame:
    """Adds outcome: 'ok', 'failed', or 'blocked' (null without a time). The third failure blocks for 300 s and starts the count anew; a success forgets failures; a null ``ok`` fails."""
    return _walk(logins, (key,), time, tie, lambda: Lock(attempts, block), Lock.login, (ok,), "outcome", T.StringType())


def stream_rate_limited(calls: DataFrame, most: int, seconds: float, key: str = "address", time: str = "ts", tie: str = "id") -> DataFrame:
    """``rate_limited`` on a stream (key, id, ts timestamp, with a watermark): a key's state is its admitted times, and goes when the window has passed."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values([time, tie], kind="stable")
        window = Window(most, seconds, state.get[0] if state.exists else [])
        times = pdf[time].astype("datetime64[us]").astype("int64")
        admitted = [window.call(int(t)) for t in times]
        state.update((window.recent,))
        state.setTimeoutTimestamp(max(int(times.iloc[-1]) // 1000 + round(1000 * seconds), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: k[0], tie: pdf[tie].to_numpy(), time: pdf[time].to_numpy(), "admitted": admitted})

    kinds = {f.name: f.dataType.simpleString() for f in calls.schema.fields}
    return calls.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, {time} {kinds[time]}, admitted boolean", "recent array<bigint>", "append", "EventTimeTimeout")


def stream_lockouts(logins: DataFrame, attempts: int = 3, block: float = 300.0, key: str = "address", time: str = "ts", ok: str = "ok", tie: str = "id") -> DataFrame:
    """``lockouts`` on a stream (key, id, ts timestamp, ok, with a watermark): key, id, ts, outcome, the same whatever micro-batches the log comes in.

    Logins wait in the key's state until the watermark has passed them (an event-time timer says when) and are then judged in order of time and
    ``tie``. Logins that come behind the watermark are too late: Spark drops them, and they change nothing. What waits is
    bounded by the watermark's delay; besides, a key keeps its failures and the end of its block. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor

    kinds = {f.name: f.dataType for f in logins.schema.fields}
    waiting = T.StructType([T.StructField("t", T.LongType()), T.StructField("tie", kinds[tie]), T.StructField("ok", T.BooleanType())])
    lock = T.StructType([T.StructField("failures", T.IntegerType()), T.StructField("until", T.LongType())])
    out = T.StructType([T.StructField(c, kinds[c]) for c in (key, tie, time)] + [T.StructField("outcome", T.StringType())])

    own = key

    class Waiting(StatefulProcessor):
        def init(self, handle: Any) -> None:
            self.handle = handle
            self.waiting, self.lock = handle.getListState("waiting", waiting), handle.getValueState("lock", lock)

        def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                times = pdf[time].astype("datetime64[us]").astype("int64")
                new = [(int(t), i, None if pd.isna(o) else bool(o)) for t, i, o in zip(times, pdf[tie].tolist(), pdf[ok].tolist())]
                self.waiting.appendList(new)
                self.handle.registerTimer(min(t for t, *_ in new) // 1000)
            return iter(())

        def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs()
            held = sorted(tuple(x) for x in self.waiting.get())
            due, rest = [x for x in held if x[0] // 1000 <= passed], [x for x in held if x[0] // 1000 > passed]
            state = Lock(attempts, block, *(self.lock.get() if self.lock.exists() else (0, 0)))
            outcomes = [state.login(t, o) for t, _, o in due]
            self.lock.update((state.failures, state.until))
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] // 1000)
            if due:
                yield pd.DataFrame({own: key[0], tie: [i for _, i, _ in due], time: pd.to_datetime([t for t, *_ in due], unit="us"), "outcome": outcomes})

        def close(self) -> None:
            pass

    return logins.select(key, tie, time, ok).groupBy(key).transformWithStateInPandas(statefulProcessor=Waiting(), outputStructType=out, outputMode="Append", timeMode="EventTime")


def stream_usage(log: DataFrame, key: str, time: str, tokens: str, late: str = "1 day") -> DataFrame:
    """Tokens by key and date at +05:30 of a stream, as windows of a day."""
    day = F.window(time, "1 day", startTime="18 hours 30 minutes")
    local = F.to_date(F.col("window.start") + F.expr("INTERVAL 330 MINUTES"))
    return log.where(F.col(tokens) > 0).withWatermark(time, late).groupBy(key, day).agg(F.sum(tokens).alias("tokens_used")).select(key, local.alias("usage_date"), "tokens_used")


def meter(log: DataFrame, path: str, key: str, time: str, tokens: str):
    """A stream writer that adds up tokens by key and date at +05:30 in a ledger at ``path``: one folder for each micro-batch.

    A micro-batch that is replayed after a crash writes its own folder anew, so nothing counts twice; ``metered`` adds the folders up. Rows of
    0 or fewer tokens don't count. Start it with a checkpoint location.
    """

    def post(batch: DataFrame, number: int) -> None:
        local = F.to_date(F.col(time) + F.expr("INTERVAL 330 MINUTES"))
        sums = batch.where(F.col(tokens) > 0).groupBy(F.col(key), local.alias("usage_date")).agg(F.sum(F.col(tokens).cast("long")).alias("tokens_used"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return log.select(key, time, tokens).writeStream.foreachBatch(post)


def metered(spark, path: str, key: str) -> DataFrame:
    """Tokens by key and date that a ledger of ``meter`` holds."""
    return spark.read.parquet(path).groupBy(key, "usage_date").agg(F.sum("tokens_used").alias("tokens_used"))
