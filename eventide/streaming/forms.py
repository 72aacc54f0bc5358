"""Streaming forms of the operators, and how to run them to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import interval_ms
from ..operators.watermark import CHUNK_ROWS, replay, split_late, state_after
from ..operators.windows import latest_per_key, top_k
from ..sources.shared import fresh_path, remove

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession, kind: str = "ROCKSDB") -> None:
    """Keep streaming state in RocksDB, or in memory with files."""
    if kind == "ROCKSDB":
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run_available(stream: DataFrame, tag: str = "stream") -> DataFrame:
    """Run an append-mode stream over all that is there and read its output as a batch frame."""
    spark = stream.sparkSession
    out = fresh_path(spark, tag)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed(stream: DataFrame, ts: str, disorder: str, size: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates per tumbling window and keys, each given once when the watermark passes its end.

    The watermark lags by the disorder and one millisecond, as in replay. Spark's watermark is the largest event
    time of the whole stream; replay takes the smallest over source partitions.
    """
    delay = f"{interval_ms(disorder) + 1} milliseconds"
    out = stream.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), *keys).agg(*aggregates)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *out.columns[1:], "w")


def write_top_k(stream: DataFrame, ts: str, disorder: str, size: str, group: str, key: str, k: int, folder: str, checkpoint: str):
    """Write the k most frequent keys of each window and group, by batch number; returns the running query.

    Counts by window, group and key come out when their window closes, all of a window in one batch, and are ranked there.
    So state has one number a key, and ranking keeps k rows of a group in each task before they meet.
    """
    counted = windowed(stream, ts, disorder, size, [group, key], F.count("*").alias("n")).drop("w")

    def rank(batch: DataFrame, number: int) -> None:
        top_k(batch, ["window_start", "window_end", group], "n", key, k).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return counted.writeStream.foreachBatch(rank).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def distinct_events(stream: DataFrame, ts: str, disorder: str, keys: list[str]) -> DataFrame:
    """The first row of each key, with others left out that come before the watermark passes it; state goes with the watermark."""
    return stream.withWatermark(ts, disorder).dropDuplicatesWithinWatermark(keys)


def two_level_windows(stream: DataFrame, ts: str, disorder: str, inner: str, outer: str, user: str, team: str, value: str) -> DataFrame:
    """Sums per user, then per team over them. Inner rows count at the last instant of their window (window_time)."""
    first = windowed(stream, ts, disorder, inner, [user, team], F.sum(value).alias("score"))
    out = first.groupBy(F.window(F.window_time("w"), outer).alias("v"), team).agg(F.sum("score").alias("total_score"), F.count("*").alias("n_users"))
    return out.select(F.col("v.start").alias("window_start"), F.col("v.end").alias("window_end"), team, "total_score", "n_users")


def write_split(stream: DataFrame, tag: Callable[[DataFrame], DataFrame], policy: str, main: str, side: str, checkpoint: str):
    """Tag each batch with a status and write its main and late rows to two folders, by batch number."""

    def both(batch: DataFrame, number: int) -> None:
        rows = tag(batch)
        for part, path in zip(split_late(rows, policy), (main, side)):
            part.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_replayed(stream: DataFrame, ts: str, order: list[str], partition: str, disorder_ms: int, lateness_ms: int, policy: str, main: str, side: str, state: str, checkpoint: str, watermark: str | None = None, chunk_rows: int = CHUNK_ROWS, stamp: Callable[[DataFrame], DataFrame] | None = None):
    """Replay arrivals as they stream in: each batch is tagged with watermarks by source partition and split by the late policy.

    Batches follow one another in arrival order, rows of a batch by ``order``. After a batch the largest time of each known
    partition is written under ``state``, by batch number; the next one starts from it. So rows are what a replay of all
    arrivals gives, however they are cut into batches, and a batch that is repeated reads the same state and leaves the same files.
    State has a row for each source partition; that of the batch before last is removed. ``stamp`` may change the tagged rows before they are
    split, for example to put event time and watermark into their headers.
    """
    spark = stream.sparkSession

    def tag(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(_state_schema(batch, partition)).parquet(f"{state}/batch={number - 1}") if number else None
        tagged = f"{state}/tagged"
        replay(batch, ts, order, partition, disorder_ms, lateness_ms, watermark, chunk_rows, before).write.mode("overwrite").parquet(tagged)
        rows = spark.read.parquet(tagged)
        for part, path in zip(split_late(stamp(rows) if stamp else rows, policy), (main, side)):
            part.write.mode("overwrite").parquet(f"{path}/batch={number}")
        state_after(rows, watermark or ts, partition, before).write.mode("overwrite").parquet(f"{state}/batch={number}")
        remove(spark, tagged)
        if number > 1:
            remove(spark, f"{state}/batch={number - 2}")

    return stream.writeStream.foreachBatch(tag).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _state_schema(rows: DataFrame, partition: str) -> T.StructType:
    return T.StructType([T.StructField("part", rows.schema[partition].dataType), T.StructField("top", T.LongType())])


def join_within_time(left: DataFrame, right: DataFrame, key: str, right_key: str, left_ts: str, right_ts: str, disorder: str, width: str, how: str = "inner") -> DataFrame:
    """Stream-stream join of rows of one key in which right's time is at or after left's, by less than width, with bounded state.

    Both sides have a watermark, so either keeps only rows that a partner can still come for. With how="left_outer" a left row
    without a partner comes out when it can have none any more.
    """
    a, b = left.withWatermark(left_ts, disorder), right.withWatermark(right_ts, disorder)
    near = F.expr(f"{key} = {right_key} AND {right_ts} >= {left_ts} AND {right_ts} < {left_ts} + interval {width}")
    return a.join(b, near, how)


def upsert(stream: DataFrame, keys: list[str], order: list[str], folder: str, checkpoint: str, compact: int = 16, lists: int = 4):
    """Keep the newest row per key in a folder; ``read_upserted`` reads it.

    A batch writes its own newest rows as one version of level 0. As soon as a level has ``compact`` versions, they are merged
    into one of the next level, with those below. So a row is written once a level, in proportion to the logarithm of the
    number of batches, and reading meets fewer than ``compact`` versions a level. Versions merged at the time before are then removed, so that readers of
    the last list still find theirs; the last ``lists`` lists are kept. A batch that is repeated leaves the same files.
    """
    spark, schema = stream.sparkSession, stream.schema

    def merge(batch: DataFrame, number: int) -> None:
        live = _versions(spark, folder, number - 1) if number else []
        merged, level = [], 0
        while len(at := [v for v in live if v[1] == level]) + 1 >= compact:  # this batch, or what is merged below, is one more
            merged, level = merged + at, level + 1
        name = f"merged={number}" if level else f"version={number}"
        rows = batch
        if merged:
            rows = spark.read.schema(schema).parquet(*(f"{folder}/rows/{v}" for v, _ in merged)).unionByName(batch)
        latest_per_key(rows, keys, order).write.mode("overwrite").parquet(f"{folder}/rows/{name}")
        listed = [(v, at, True) for v, at in live if (v, at) not in merged] + [(name, level, True)] + [(v, at, False) for v, at in merged]
        spark.createDataFrame(listed, "version string, level int, live boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/list/batch={number}")
        for v, _ in _versions(spark, folder, number - 1, live=False) if number else []:
            remove(spark, f"{folder}/rows/{v}")
        if number >= lists:
            remove(spark, f"{folder}/list/batch={number - lists}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, folder: str, number: int, live: bool = True) -> list[tuple[str, int]]:
    """The versions and levels that the list of a batch names; fewer than are merged at a time of each level."""
    return [(r["version"], r["level"]) for r in spark.read.parquet(f"{folder}/list/batch={number}").where(F.col("live") == live).orderBy("version").collect()]


def read_upserted(spark: SparkSession, folder: str, schema, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key after the last batch."""
    last = spark.read.parquet(f"{folder}/list").agg(F.max("batch")).first()[0]
    paths = [f"{folder}/rows/{v}" for v, _ in _versions(spark, folder, last)]
    return latest_per_key(spark.read.schema(schema).parquet(*paths), keys, order)


def release_idle_windows(stream: DataFrame, ts: str, keys: list[str], size: str, idle: str, fold: Callable[[tuple | None, pd.DataFrame], tuple], state: str, release: Callable[[tuple], dict], schema: str) -> DataFrame:
    """Each tumbling window and key once, as partial, after no row of it came for ``idle`` of the clock.

    fold(state or None, rows) gives the new state, a tuple of the types in ``state``; release(state) gives the columns in
    ``schema``. State is that tuple per key and window, and times out by processing time. Keys are strings.
    """
    idle_ms = interval_ms(idle)
    rows = stream.withColumn("window_start", F.window(ts, size)["start"])
    for k in keys:
        rows = rows.withColumn(k, F.col(k).cast("string"))
    out = T.StructType.fromDDL(", ".join([*(f"{k} string" for k in keys), "window_start timestamp", schema, "partial boolean"]))

    def step(names, batches, held):
        if held.hasTimedOut:
            found = release(held.get)
            held.remove()
            yield pd.DataFrame([dict(zip([*keys, "window_start"], names)) | found | {"partial": True}])[out.fieldNames()]
            return
        now = held.get if held.exists else None
        for b in batches:
            now = fold(now, b)
        held.update(now)
        held.setTimeoutDuration(idle_ms)

    return rows.groupBy(*keys, "window_start").applyInPandasWithState(step, out, state, "append", "ProcessingTimeTimeout")


def release_idle(stream: DataFrame, ts: str, key: str, value: str, size: str, idle: str) -> DataFrame:
    """Counts and sums per key and tumbling window, each given once after it was idle."""
    rows = stream.select(ts, F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    fold = lambda s, b: ((s[0] if s else 0) + len(b), (s[1] if s else 0.0) + float(b["value"].sum()))
    return release_idle_windows(rows, ts, ["key"], size, idle, fold, "n long, total double", lambda s: {"n": s[0], "total": s[1]}, "n long, total double")
