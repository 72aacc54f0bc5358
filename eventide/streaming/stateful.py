"""Streaming operators with lists and timers in state: as-of enrichment, and idle release of the oldest window.

They keep state in RocksDB, so it may be larger than memory. State of one key is in one task at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..functions.time import interval_ms
from .forms import use_state_store


def _sent(df: DataFrame, name: str):
    """A column as it is sent to Python: numbers as text, as beside nulls they would come as rounded floats."""
    kind = df.schema[name].dataType
    return F.col(name).cast("string") if isinstance(kind, (T.IntegralType, T.FractionalType)) and not isinstance(kind, T.DecimalType) else F.col(name)


def _typed(rows: pd.DataFrame, schema: T.StructType) -> list[tuple]:
    """Rows as tuples of a schema, numbers read from text."""
    read = lambda f: int if isinstance(f.dataType, T.IntegralType) else float if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else lambda v: v
    columns = [[None if v is None or v is pd.NaT or v != v else read(f)(v) for v in rows[f.name].tolist()] for f in schema.fields]
    return list(zip(*columns))


class _AsOf(StatefulProcessor):
    """Names don't begin with an underscore here, as rows come as named tuples.

    Rows of the left side wait until the watermark passes them; versions of the right side go when a later one has been passed.
    """

    def __init__(self, left: T.StructType, right: T.StructType, out: T.StructType):
        self.left, self.right, self.out = left, right, out

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.left)
        self.versions = handle.getListState("versions", self.right)

    def handleInputRows(self, key, rows, timerValues):
        new, held = [], []
        for batch in rows:
            own = batch["side_"] == 1
            new += _typed(batch[own], self.left)
            held += _typed(batch[~own], self.right)
        # the first field of either is its time in microseconds
        if held:
            self.versions.appendList(held)
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: r[0]) if self.waiting.exists() else []
        order = lambda r: (r[0], tuple((x is not None, x if x is not None else 0) for x in r[1:]))
        versions = sorted(self.versions.get(), key=order) if self.versions.exists() else []
        passed, at, out = [r for r in rows if r[0] < mark], 0, []
        for r in passed:
            while at < len(versions) and versions[at][0] <= r[0]:
                at += 1
            out.append((*key, *r[1:], *(versions[at - 1][1:] if at else (None,) * (len(self.right) - 1))))
        left = rows[len(passed) :]
        self.waiting.put(left) if left else self.waiting.clear()
        old = sum(1 for v in versions if v[0] < mark)
        if old > 1:  # of those that the watermark has passed one is left, for all rows still to come
            self.versions.put(versions[old - 1 :])
        if left:
            self.handle.registerTimer(int(left[0][0]) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=self.out.fieldNames(), dtype=object)

    def close(self):
        pass


def as_of_stream(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], disorder: str) -> DataFrame:
    """The streaming form of as_of: each left row with the values of the latest right row of its key at or before its time.

    A row comes out when the watermark has passed it, so that no earlier version can still come; rows behind the watermark are
    dropped. State is the rows that wait and, of each key, the versions from the last one that the watermark has passed. left_ts is given as it
    is; rows without key or time find nothing and are left out. Ties at one time go to the largest values.
    """
    use_state_store(left.sparkSession)
    rest = [c for c in left.columns if c not in (key, left_ts)]
    kinds = lambda df, names: [T.StructField(n, df.schema[n].dataType) for n in names]
    empty = lambda df, c: F.lit(None).cast(df.select(_sent(df, c).alias("x")).schema["x"].dataType)
    a = left.select(F.col(key).alias("key_"), F.col(left_ts).alias("time_"), F.lit(1).alias("side_"), F.unix_micros(left_ts).alias("us_"), *(_sent(left, c).alias(f"l{i}_") for i, c in enumerate(rest)), *(empty(right, v).alias(f"v{i}_") for i, v in enumerate(values)))
    b = right.select(F.col(key).alias("key_"), F.col(right_ts).alias("time_"), F.lit(0).alias("side_"), F.unix_micros(right_ts).alias("us_"), *(empty(left, c).alias(f"l{i}_") for i, c in enumerate(rest)), *(_sent(right, v).alias(f"v{i}_") for i, v in enumerate(values)))
    both = a.unionByName(b).where("key_ is not null and time_ is not null").withWatermark("time_", disorder)
    us = T.StructField("us_", T.LongType())
    own = T.StructType([us, T.StructField("at_", T.LongType()), *(T.StructField(f"l{i}_", f.dataType) for i, f in enumerate(kinds(left, rest)))])
    seen = T.StructType([us, *(T.StructField(f"v{i}_", f.dataType) for i, f in enumerate(kinds(right, values)))])
    out = T.StructType([T.StructField("key_", left.schema[key].dataType), T.StructField("at_", T.LongType()), *own.fields[2:], *seen.fields[1:]])
    found = both.withColumn("at_", F.col("us_")).groupBy("key_").transformWithStateInPandas(_AsOf(own, seen, out), out, "Append", "EventTime")
    named = {"key_": key, **{f"l{i}_": c for i, c in enumerate(rest)}}
    return found.select(*(F.col(c).alias(n) for c, n in named.items()), F.timestamp_micros("at_").alias(left_ts), *(F.col(f"v{i}_").alias(v) for i, v in enumerate(values)))


class _Oldest(StatefulProcessor):
    """Open windows of a key, and the one that was the oldest when the clock was last looked at."""

    def __init__(self, state: T.StructType, out: T.StructType, fold, release, idle_ms: int):
        self.state, self.out, self.fold, self.release, self.idle_ms = state, out, fold, release, idle_ms

    def init(self, handle):
        self.handle = handle
        self.windows = handle.getMapState("windows", T.StructType([T.StructField("start", T.LongType())]), self.state)
        self.next = handle.getValueState("next", T.StructType([T.StructField("start", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        empty = not self.windows.exists()
        for batch in rows:
            for start, part in batch.groupby("start_"):
                at = (int(start),)
                now = tuple(self.windows.getValue(at)) if self.windows.containsKey(at) else None
                self.windows.updateValue(at, self.fold(now, part))
        if empty:  # the clock starts
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = tuple(self.next.get()) if self.next.exists() else None
        if due and self.windows.containsKey(due):
            row = dict(zip(self.out.fieldNames(), key)) | {"start_": due[0]} | self.release(tuple(self.windows.getValue(due))) | {"partial": True}
            self.windows.removeKey(due)
            yield pd.DataFrame([row])[self.out.fieldNames()]
        open_windows = [tuple(k) for k in self.windows.keys()]
        if open_windows:
            self.next.update(min(open_windows))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        else:
            self.next.clear()

    def close(self):
        pass


def release_oldest(stream: DataFrame, ts: str, keys: list[str], size: str, idle: str, fold: Callable[[tuple | None, pd.DataFrame], tuple], state: str, release: Callable[[tuple], dict], schema: str) -> DataFrame:
    """Of each key the oldest open tumbling window, as partial, one for each ``idle`` of the clock.

    When the clock goes off, the window that was the oldest the time before is released if it is still open, and the one that is now
    the oldest is next. So a window has at least ``idle`` to go on filling. fold(state or None, rows) gives the new state, a tuple of the
    types in ``state``; release(state) gives the columns in ``schema``. Without open windows the clock of a key stands still.
    """
    use_state_store(stream.sparkSession)
    rows = stream.withColumn("start_", F.unix_micros(F.window(ts, size)["start"]))
    held = T.StructType.fromDDL(state)
    out = T.StructType([*(T.StructField(k, stream.schema[k].dataType) for k in keys), T.StructField("start_", T.LongType()), *T.StructType.fromDDL(schema).fields, T.StructField("partial", T.BooleanType())])
    found = rows.groupBy(*keys).transformWithStateInPandas(_Oldest(held, out, fold, release, interval_ms(idle)), out, "Append", "ProcessingTime")
    return found.withColumn("start_", F.timestamp_micros("start_")).withColumnRenamed("start_", "window_start")
