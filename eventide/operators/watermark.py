"""Replay of recorded arrivals: watermarks, status of rows, late policies and window firings.

A row's watermark is the smallest, over the source partitions known before it, of their largest event time so
far, less the allowed disorder and one millisecond. A partition is known from its first row that is not DISCARDED.

The scan in arrival order is cut into chunks of about CHUNK_ROWS rows by quantiles of the arrival order, whatever its numbers
are, so no task orders the whole stream: each partition's largest times in the chunks before give what a chunk starts from, and
within a chunk rows stream by in order. Any number of source partitions will do: their state is a row each per chunk.

Where partitions begin in earlier chunks is found by a fixpoint. Each is first taken to begin with its first row; a pass then scans
each chunk from what it knows under the beginnings so far, and the first row in it that is not DISCARDED of each partition that it doesn't
know gives the next beginnings. A chunk whose scan finds the beginnings it was taken to have leaves the next one's start right,
so a pass makes at least one more chunk right for good, and beginnings that a pass leaves as they were are the ones there are. However
many rows of a chunk are DISCARDED before a partition begins and however partitions there depend on one another, that is one pass.
Summaries (the least time a chunk starts from, each partition's largest time in it) rule out chunks in which none begins, and only others are
scanned. Usually a pass finds the beginnings and one more confirms them.

On a stream the state after a batch is a row for each known partition, its largest time: what the next batch starts from.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import from_ms
from ..sources.shared import fresh_path

CHUNK_ROWS = 1 << 18


def _written(df: DataFrame, tag: str) -> DataFrame:
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_pieces(df: DataFrame, order: list[str], rows: int, total: int, name: str) -> DataFrame:
    """df with a number of its piece, ascending in order: ranges of about that many rows by sampled quantiles, written once so that they stay."""
    pieces = -(-total // rows)
    if pieces <= 1:
        return df.withColumn(name, F.lit(0).cast("long"))
    return _written(df.repartitionByRange(pieces, *order).withColumn(name, F.spark_partition_id().cast("long")), "pieces")


class _Tops:
    """The largest time of each known partition, and the least of those, with or without one partition."""

    def __init__(self):
        self.at, self.heap = {}, []

    def add(self, part, at) -> None:
        if part not in self.at or at > self.at[part]:
            self.at[part] = at
            heappush(self.heap, (at, id(part), part))

    def least(self):
        while self.heap and self.at[self.heap[0][2]] != self.heap[0][0]:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else None


def _in_order(rows: DataFrame, first: DataFrame) -> DataFrame:
    return rows.unionByName(first).repartition("_chunk").sortWithinPartitions("_chunk", "_kind", "_o", "_mark")


def _scan(rows: DataFrame, starts: DataFrame, late: int, lateness_ms: int) -> DataFrame:
    """rows (_chunk, _part, _ts, _at, _o, _row) streamed in order, each chunk from its starts (_chunk, _part, _at): the rows' structs with watermark and status."""
    kinds = rows.schema
    none = lambda c: F.lit(None).cast(kinds[c].dataType).alias(c)
    first = starts.select("_chunk", "_part", none("_ts"), "_at", none("_o"), none("_row"), F.lit(0).alias("_kind"), F.lit(0).alias("_mark"))
    both = _in_order(rows.withColumns({"_kind": F.lit(1), "_mark": F.lit(0)}), first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, tops = None, _Tops()
        for batch in batches:
            cols = {n: batch.column(batch.schema.get_field_index(n)) for n in ("_chunk", "_part", "_ts", "_at", "_kind")}
            marks, states = [], []
            for c, part, ts, at, kind in zip(*(x.to_pylist() for x in cols.values())):
                if c != chunk:
                    chunk, tops = c, _Tops()
                if not kind:
                    tops.add(part, at)
                    continue
                least = tops.least()
                mark = None if least is None else least - late
                if ts is None or at is None:
                    state = "DISCARDED"
                elif mark is None or mark <= at:
                    state = "VALID"
                else:
                    state = "LATE" if mark - lateness_ms <= at else "DISCARDED"
                marks.append(mark)
                states.append(state)
                if state != "DISCARDED":
                    tops.add(part, at)
            kept = batch.column(batch.schema.get_field_index("_row")).filter(pa.array([bool(k) for k in cols["_kind"].to_pylist()], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*kept.flatten(), pa.array(marks, pa.int64()), pa.array(states, pa.string())], names=[*(f.name for f in kept.type), "wm", "status"])

    fields = [T.StructField(f.name, f.dataType) for f in kinds["_row"].dataType.fields]
    return both.mapInArrow(run, T.StructType([*fields, T.StructField("wm", T.LongType()), T.StructField("status", T.StringType())]))


def _accepted(timed: DataFrame, starts: DataFrame, late: int, lateness_ms: int) -> DataFrame:
    """(_chunk, _part, _o, _at, _top): in each chunk the first row that is not DISCARDED of each partition that it doesn't start from, and that one's largest time by the chunk's end."""
    kinds = timed.schema
    first = starts.select("_chunk", "_part", "_at", F.lit(None).cast(kinds["_o"].dataType).alias("_o"), F.lit(0).alias("_kind"), F.lit(0).alias("_mark"))
    both = _in_order(timed.select("_chunk", "_part", "_at", "_o", F.lit(1).alias("_kind"), F.lit(0).alias("_mark")), first)
    given = ["_chunk", "_part", "_o", "_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, tops, new = None, _Tops(), []

        def done() -> Iterator[pa.RecordBatch]:
            for part, row in new:
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([tops.at[part]], pa.int64())], names=[*given, "_top"])

        for batch in batches:
            for n, (c, part, at, kind) in enumerate(zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("_chunk", "_part", "_at", "_kind")))):
                if c != chunk:
                    yield from done()
                    chunk, tops, new = c, _Tops(), []
                if kind and part not in tops.at:
                    least = tops.least()
                    if least is not None and least - late - lateness_ms > at:
                        continue
                    new.append((part, batch.select(given).take(pa.array([n]))))
                tops.add(part, at)  # a DISCARDED row of a known partition is below its largest time
        yield from done()

    fields = [T.StructField(c, kinds[c].dataType) for c in given]
    return both.mapInArrow(run, T.StructType([*fields, T.StructField("_top", T.LongType())]))


def _starts(begin: DataFrame, initial: DataFrame, largest: DataFrame, last: int) -> DataFrame:
    """(_chunk, _part, _at): what each chunk knows of the partitions that begin before it."""
    own = begin.select(F.col("_from_part").alias("_part"), F.col("_in").alias("_chunk"), F.col("_top").alias("_at"))
    since = largest.join(begin, largest["_part"].eqNullSafe(begin["_from_part"])).where("_chunk > _in").select("_part", "_chunk", F.col("_largest").alias("_at"))
    again = largest.join(initial, largest["_part"].eqNullSafe(initial["_known"])).select("_part", "_chunk", F.col("_largest").alias("_at"))
    held = initial.select(F.col("_known").alias("_part"), F.lit(-1).cast("long").alias("_chunk"), F.col("_top").alias("_at"))
    tops = own.unionByName(since).unionByName(again).unionByName(held)
    by = Window.partitionBy("_part").orderBy("_chunk")
    tops = tops.withColumn("_next", F.lead("_chunk", 1, last).over(by)).withColumn("_at", F.max("_at").over(by))
    return tops.where("_next > _chunk").select(F.explode(F.sequence(F.col("_chunk") + 1, F.col("_next"))).alias("_chunk"), "_part", "_at")


def _possible(starts: DataFrame, largest: DataFrame, late: int, lateness_ms: int) -> DataFrame:
    """(_chunk): where, by summaries, a partition can begin. The first to begin in a chunk is held against no less than what the chunk starts from."""
    least = starts.groupBy("_chunk").agg(F.min("_at").alias("_least"))
    known = starts.select(F.col("_chunk").alias("_c"), F.col("_part").alias("_p"))
    unknown = largest.join(known, (F.col("_chunk") == F.col("_c")) & F.col("_part").eqNullSafe(F.col("_p")), "left_anti").join(least, "_chunk", "left")
    return unknown.where(F.col("_least").isNull() | (F.col("_least") - late - lateness_ms <= F.col("_largest"))).select("_chunk").distinct()


def _beginnings(timed: DataFrame, initial: DataFrame, last: int, late: int, lateness_ms: int) -> tuple[DataFrame, DataFrame]:
    """Where partitions not known before begin, (_from_part, _from, _in, _top): row, chunk and largest time by its end; and what each chunk starts from."""
    largest = _written(timed.groupBy("_part", "_chunk").agg(F.max("_at").alias("_largest"), F.min("_o").alias("_o")), "largest")
    first = lambda rows: rows.groupBy("_part").agg(F.min(F.struct("_o", "_chunk", "_top")).alias("_b")).select(F.col("_part").alias("_from_part"), F.col("_b._o").alias("_from"), F.col("_b._chunk").alias("_in"), F.col("_b._top").alias("_top"))
    new = largest.join(initial.select("_known"), largest["_part"].eqNullSafe(F.col("_known")), "left_anti")
    begin = _written(first(new.withColumnRenamed("_largest", "_top")), "begin")
    state = lambda b: b.agg(F.count("*"), F.sum(F.xxhash64("_from_part", "_from").cast("decimal(38,0)"))).first()
    was = state(begin)
    while True:
        starts = _written(_starts(begin, initial, largest, last), "starts")
        where = _possible(starts, largest, late, lateness_ms)
        looked = _accepted(timed.join(where, "_chunk", "left_semi"), starts.join(where, "_chunk", "left_semi"), late, lateness_ms)
        begin = _written(first(looked), "begin")
        now = state(begin)
        if now == was:
            return begin, starts
        was = now


def replay(df: DataFrame, ts: str, order: list[str], partition: str, disorder_ms: int, lateness_ms: int = 0, watermark: str | None = None, chunk_rows: int = CHUNK_ROWS, state: DataFrame | None = None) -> DataFrame:
    """df with wm (milliseconds, null before any row) and status VALID, LATE or DISCARDED.

    ts is a column of milliseconds; order starts with an arrival number and tells rows apart. With ``watermark``, a column
    of watermarks that rows carry, those are used in place of ts - disorder - 1, and compared in place of ts.
    Rows without event time are DISCARDED. ``state`` (part, top) is what ``state_after`` gave for the rows before these.
    """
    total = df.count()
    held = in_pieces(df, order, chunk_rows, total, "_chunk")
    rows = held.select("_chunk", F.col(partition).alias("_part"), F.col(ts).cast("long").alias("_ts"), F.col(watermark or ts).cast("long").alias("_at"), F.struct(*order).alias("_o"), F.struct(*df.columns).alias("_row"))
    late = 0 if watermark else disorder_ms + 1
    timed = rows.where("_ts is not null and _at is not null").drop("_row", "_ts")
    kind = rows.schema["_part"].dataType
    initial = (state if state is not None else df.sparkSession.createDataFrame([], T.StructType([T.StructField("part", kind), T.StructField("top", T.LongType())]))).select(F.col("part").cast(kind).alias("_known"), F.col("top").alias("_top"))
    if total <= chunk_rows:
        return _scan(rows, initial.select(F.lit(0).cast("long").alias("_chunk"), F.col("_known").alias("_part"), F.col("_top").alias("_at")), late, lateness_ms)
    last = -(-total // chunk_rows) - 1
    return _scan(rows, _beginnings(timed, initial, last, late, lateness_ms)[1], late, lateness_ms)


def state_after(replayed: DataFrame, time: str, partition: str, state: DataFrame | None = None) -> DataFrame:
    """(part, top): the known partitions after replayed rows and their largest times, from the state before. time is the column that was compared."""
    rows = replayed.where("status <> 'DISCARDED'").select(F.col(partition).alias("part"), F.col(time).cast("long").alias("top"))
    return (rows if state is None else rows.unionByName(state)).groupBy("part").agg(F.max("top").alias("top"))


def split_late(df: DataFrame, policy: str = "DROP") -> tuple[DataFrame, DataFrame]:
    """(main, side) of rows with a status: LATE rows are dropped, sent on (UPSERT) or set aside (SIDE_CHANNEL)."""
    late = F.col("status") == "LATE"
    valid = F.col("status") == "VALID"
    if policy == "DROP":
        return df.where(valid), df.where(F.lit(False))
    if policy == "UPSERT":
        return df.where(valid | late), df.where(F.lit(False))
    if policy == "SIDE_CHANNEL":
        return df.where(valid), df.where(late)
    raise ValueError(policy)


def split_firings(firings: DataFrame, policy: str = "DROP") -> tuple[DataFrame, DataFrame]:
    """(main, side) of window firings with a late flag: late ones are dropped, sent on (UPSERT) or set aside (SIDE_CHANNEL)."""
    late = F.col("late")
    parts = {"DROP": (firings.where(~late), firings.where(F.lit(False))), "UPSERT": (firings, firings.where(F.lit(False))), "SIDE_CHANNEL": (firings.where(~late), firings.where(late))}
    if policy not in parts:
        raise ValueError(policy)
    return parts[policy]


def fire_strict(df: DataFrame, ts: str, size_ms: int, keys: list[str], **aggregates: Column) -> DataFrame:
    """Each window once, from the rows that were not late (lateness 0)."""
    start = F.col(ts) - F.pmod(F.col(ts), F.lit(size_ms))
    on_time = df.where(F.col(ts).isNotNull() & (F.col("wm").isNull() | (F.col(ts) >= F.col("wm"))))
    out = on_time.withColumn("_start", start).groupBy("_start", *keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    return out.select(from_ms(F.col("_start")).alias("window_start"), from_ms(F.col("_start") + size_ms).alias("window_end"), *keys, *aggregates)


def fire_lateness(df: DataFrame, ts: str, size_ms: int, keys: list[str], order: list[str], value: str, piece_rows: int = CHUNK_ROWS) -> DataFrame:
    """All firings of windows with allowed lateness: (window, keys, late, seq, n, total).

    A window's first firing has its rows that came while it was open; each accepted row after that fires
    the window again with all rows so far, late = true and the row's arrival number.

    Running counts and sums go in pieces of about piece_rows rows in the order of firing: a window and key of any size is spread
    over tasks, and one row for each of its pieces carries the sums on.
    """
    start = F.col(ts) - F.pmod(F.col(ts), F.lit(size_ms))
    rows = df.where(F.col("status") != "DISCARDED").withColumn("_start", start)
    rows = rows.withColumn("_late", F.coalesce(F.col("wm") >= F.col("_start") + size_ms, F.lit(False)))
    group = ["_start", *keys]
    rows = _written(rows.select(*group, "_late", *order, F.col(value).alias("_value")), "firings")
    first = rows.where("not _late").groupBy(*group).agg(F.count("*").alias("n"), F.sum("_value").alias("total"))
    pieces = in_pieces(rows, [*group, "_late", *order], piece_rows, rows.count(), "_piece")
    so_far = Window.partitionBy("_piece", *group).orderBy("_late", *order).rowsBetween(Window.unboundedPreceding, 0)
    sums = pieces.groupBy("_piece", *group).agg(F.count("*").alias("_n"), F.sum("_value").alias("_total"))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    carried = sums.select("_piece", *group, F.sum("_n").over(before).alias("_n"), F.sum("_total").over(before).alias("_total")).where("_n is not null")
    carried = carried.select(F.col("_piece").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_n", "_total")
    within = pieces.withColumn("_own", F.count("*").over(so_far)).withColumn("_sum", F.sum("_value").over(so_far)).where("_late")
    same = F.col("_piece") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    plus = lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    again = within.join(carried, same, "left").select(*group, F.lit(True).alias("late"), F.col(order[0]).cast("long").alias("seq"), (F.col("_own") + F.coalesce("_n", F.lit(0))).alias("n"), plus(F.col("_sum"), F.col("_total")).alias("total"))
    both = first.select(*group, F.lit(False).alias("late"), F.lit(None).cast("long").alias("seq"), "n", "total").unionByName(again)
    return both.select(from_ms(F.col("_start")).alias("window_start"), from_ms(F.col("_start") + size_ms).alias("window_end"), *keys, "late", "seq", "n", "total")
