"""Aggregation per window, ranking, collection, joins and keyed folds over batch or streaming frames."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.time import epoch_ms, interval_ms, tumble
from .watermark import CHUNK_ROWS, in_pieces


def window_aggregate(df: DataFrame, ts: str, size: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates per tumbling window and keys: (window_start, window_end, keys, aggregates)."""
    out = df.groupBy(F.window(ts, size).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *out.columns[1 + len(keys) :])


def top_k(df: DataFrame, partition: list[str], by: str, tie: str, k: int) -> DataFrame:
    """The k rows with the largest ``by`` in each partition, ties by ``tie``, with row_num."""
    ranked = Window.partitionBy(*partition).orderBy(F.desc(by), F.asc(tie))
    return df.withColumn("row_num", F.row_number().over(ranked)).where(F.col("row_num") <= k).withColumn("row_num", F.col("row_num").cast("long"))


def two_level(df: DataFrame, ts: str, inner: str, outer: str, user: str, team: str, value: str) -> DataFrame:
    """Sums per user and inner window, then per team and outer window over those; their event time is the window's end."""
    first = window_aggregate(df, ts, inner, [user, team], F.sum(value).alias("score"))
    return window_aggregate(first, "window_end", outer, [team], F.sum("score").alias("total_score"), F.count("*").alias("n_users"))


def collect_windows(df: DataFrame, ts: str, size: str, keys: list[str], order: list[str], payload: str, headers: str | None = None) -> DataFrame:
    """The payloads of each window and key in arrival order. Keys are required: a window may be of any size.

    With ``headers``, those of the first message too; its content type becomes multipart of the same kind.
    """
    if not keys:
        raise ValueError("a window is collected by key")
    rows = tumble(df, ts, size)
    packed = F.sort_array(F.collect_list(F.struct(*order, F.col(payload).alias("_p")))).alias("_all")
    first = [F.min_by(headers, F.struct(*order)).alias("headers")] if headers else []
    out = rows.groupBy("window_start", "window_end", *keys).agg(packed, *first)
    if headers:
        kind = F.coalesce(F.regexp_extract(F.col("headers")["content-type"], "/(.*)$", 1), F.lit("json"))
        rest = F.map_filter("headers", lambda k, v: k != "content-type")
        out = out.withColumn("headers", F.map_concat(rest, F.create_map(F.lit("content-type"), F.concat(F.lit("multipart/"), kind))))
    return out.select("window_start", "window_end", *keys, F.transform("_all", lambda x: x["_p"]).alias("payloads"), *(["headers"] if headers else []))


def collect_pieces(df: DataFrame, ts: str, size: str, keys: list[str], order: list[str], payload: str, most: int = 1000, piece_rows: int = CHUNK_ROWS) -> DataFrame:
    """The payloads of each window and key in arrival order, in pieces of at most ``most``, numbered from 0: no row holds a whole window.

    Rows are numbered in ranges of (window, key, order), and one row for each window and key in a range carries its count on to the
    next, so a window and key of any size is spread over tasks.
    """
    group = ["window_start", "window_end", *keys]
    rows = tumble(df, ts, size).select(*group, *order, F.col(payload).alias("_p"))
    ranged = in_pieces(rows, [*group, *order], piece_rows, rows.count(), "_range")
    counts = ranged.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_range").alias("_r"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_before")
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order))
    placed = ranged.withColumn("_own", own).join(carried, same).withColumn("piece", F.floor((F.col("_before") + F.col("_own") - 1) / most))
    packed = F.sort_array(F.collect_list(F.struct(*order, "_p"))).alias("_all")
    return placed.groupBy(*group, "piece").agg(packed).select(*group, "piece", F.transform("_all", lambda x: x["_p"]).alias("payloads"))


def enrich(events: DataFrame, table: DataFrame, key: str, table_key: str, broadcast_rows: int = 0, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Inner equi-join of events with a dimension. One of up to broadcast_rows rows and broadcast_bytes bytes, as counted, is broadcast."""
    if broadcast_rows and not table.isStreaming:
        size = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))
        rows, held = table.limit(broadcast_rows + 1).agg(F.count("*"), size).first()
        if rows <= broadcast_rows and held <= broadcast_bytes:
            table = F.broadcast(table)
    return events.join(table, events[key] == table[table_key])


def as_of(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, values: list[str], bucket: str = "1 day") -> DataFrame:
    """left with the values of the latest right row of its key at or before its time, null where there is none.

    A key's rows are cut into buckets of time, so a key with very many rows is spread over tasks: a window finds the
    latest value within the bucket, and one row per key and bucket carries it on to later ones. Rows without
    key or time find nothing; of right rows at one time the one with the largest values counts.
    """
    usable = lambda ts: F.col(key).isNotNull() & F.col(ts).isNotNull()
    slot = lambda ts: F.floor(epoch_ms(ts) / interval_ms(bucket)).alias("_slot")
    a = left.select(F.col(left_ts).alias("_at"), F.lit(1).alias("_side"), slot(left_ts), F.col(key).alias("_key"), F.struct(*left.columns).alias("_row"))
    b = right.where(usable(right_ts)).select(F.col(right_ts).alias("_at"), F.lit(0).alias("_side"), slot(right_ts), F.col(key).alias("_key"), F.struct(*values).alias("_v"))
    kind = b.schema["_v"].dataType
    both = a.withColumn("_v", F.lit(None).cast(kind)).unionByName(b.withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType)))
    within = Window.partitionBy("_key", "_slot").orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_v", F.last("_v", ignorenulls=True).over(within)).where("_side = 1")
    ends = b.groupBy("_key", "_slot").agg(F.max_by("_v", F.struct("_at", "_v")).alias("_end"))
    slots = ends.unionByName(a.where("_key is not null and _slot is not null").select("_key", "_slot").distinct().withColumn("_end", F.lit(None).cast(kind)))
    slots = slots.groupBy("_key", "_slot").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("_key", "_slot", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    out = seen.join(carried, ["_key", "_slot"], "left").withColumn("_v", F.coalesce("_v", "_carried"))
    out = out.withColumn("_v", F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), F.col("_v")))
    return out.select("_row.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, width: str) -> DataFrame:
    """Pairs of rows of one key in which right's time is at or after left's, by less than width: left's columns, then right's but the key.

    Both are dealt by key and by steps of time as long as width: a left row meets the right rows of its step and the next.
    """
    step = lambda ts: F.floor(epoch_ms(ts) / interval_ms(width))
    a = left.withColumn("_step", F.explode(F.array(step(left_ts), step(left_ts) + 1)))
    b = right.withColumn("_step", step(right_ts)).withColumnRenamed(right_ts, "_then")
    near = (F.col("_then") >= F.col(left_ts)) & (F.col("_then") < F.col(left_ts) + F.expr(f"interval {width}"))
    return a.join(b, [key, "_step"]).where(near).withColumnRenamed("_then", right_ts).drop("_step")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by one aggregation: what an upsert leaves."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(newest).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def map_messages(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame] | None, schema: str | T.StructType | None = None) -> DataFrame:
    """A user's function over batches of rows, one row out for each row in; None leaves rows as they are.

    schema is that of the rows it gives, headers and payload of another type included; else they have df's.
    """
    if fn is None:
        return df

    def run(batches):
        for batch in batches:
            out = fn(batch)
            if len(out) != len(batch):
                raise ValueError("a mapping gives one row for each row")
            yield out

    return df.mapInPandas(run, schema or df.schema)


def fold_windows(df: DataFrame, ts: str, size: str, keys: list[str], fold: Callable[[dict, dict], None], schema: str, release: Callable[[list[dict]], list[dict]] | None = None, order: list[str] | None = None, headers: Callable[[dict], dict[str, str]] | None = None) -> DataFrame:
    """A user's fold of each window and key, record by record: fold(record, results) changes results, a dict of rows.

    release may filter or extend the rows before they go out, and headers gives those of each, a column of that name. Records stream through sorted by window and key, so a
    task holds the results of one group, never its records. Keys are required, else a window is one task's work.
    """
    if not keys:
        raise ValueError("a window is folded by key")
    group = ["window_start", "window_end", *keys]
    rows = tumble(df, ts, size).repartition(*group).sortWithinPartitions(*group, *(order or []))
    schema = f"{schema}, headers map<string,string>" if headers else schema
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, results, out = None, {}, []

        def done() -> None:
            if current is not None:
                found = list(results.values())
                found = release(found) if release else found
                out.extend([row | {"headers": list(headers(row).items())} for row in found] if headers else found)
                results.clear()

        for batch in batches:
            for record in batch.to_pylist():
                at = tuple(record[c] for c in group)
                if at != current:
                    done()
                    current = at
                fold(record, results)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return rows.mapInArrow(run, schema)


def fold_merging(df: DataFrame, ts: str, size: str, keys: list[str], init: Callable[[], object], add: Callable[[object, dict], object], merge: Callable[[object, object], object], finish: Callable[[dict, object], list[dict]], schema: str, held: int = 10_000) -> DataFrame:
    """A user's fold of each window and key whose states can be merged: init(), add(state, record), merge(state, state), finish(group, state) to rows.

    Records are folded where they are read, in any order, and only states are shuffled: one for each window and key and task, or
    more where a task meets over ``held`` groups at a time. So a window and key with very many records is folded by all tasks. States are pickled.
    Without keys a window's states still meet in one task, a state for each task that read it.
    """
    group = ["window_start", "window_end", *keys]
    rows = tumble(df, ts, size)
    partial = T.StructType([*rows.select(*group).schema.fields, T.StructField("_state", T.BinaryType())])
    between, kinds = to_arrow_schema(partial), to_arrow_schema(T.StructType.fromDDL(schema))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, object] = {}
        give = lambda: pa.RecordBatch.from_pylist([dict(zip(group, g)) | {"_state": pickle.dumps(s)} for g, s in states.items()], schema=between)
        for batch in batches:
            for record in batch.to_pylist():
                g = tuple(record[c] for c in group)
                states[g] = add(states[g] if g in states else init(), record)
                if len(states) >= held:
                    yield give()
                    states.clear()
        yield give()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out = None, None, []
        for batch in batches:
            for record in batch.to_pylist():
                g, own = tuple(record[c] for c in group), pickle.loads(record["_state"])
                if current is not None and g == current:
                    state = merge(state, own)
                    continue
                if current is not None:
                    out.extend(finish(dict(zip(group, current)), state))
                current, state = g, own
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)
                out.clear()
        if current is not None:
            out.extend(finish(dict(zip(group, current)), state))
        yield pa.RecordBatch.from_pylist(out, schema=kinds)

    states = rows.mapInArrow(fold, partial)
    return states.repartition(*group).sortWithinPartitions(*group).mapInArrow(meet, schema)


def deal(df: DataFrame, key: str, n: int) -> DataFrame:
    """df repartitioned by key, with the number of the share each key goes to."""
    return df.withColumn("share", F.pmod(F.hash(key), F.lit(n))).repartition(n, "share")
