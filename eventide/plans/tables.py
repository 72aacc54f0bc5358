"""Stream tables: a name, a schema, an event-time column with its delay, keys and metadata columns."""

from __future__ import annotations

import contextlib
import io
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import watermark_declaration
from ..sources.shared import make_folder

TYPES = {"null": "void", "boolean": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "bytes": "binary", "string": "string", "long_timestamp-millis": "timestamp", "int_date": "date"}


@dataclass
class StreamTable:
    name: str
    schema: T.StructType
    event_time: str | None = None
    delay: str | None = None
    processing_time: list[str] = field(default_factory=list)
    primary_key: list[str] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)  # column -> source column
    options: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        names = {f.name for f in self.schema.fields} | set(self.metadata)
        if self.event_time and self.event_time.split(".")[0] not in names:
            raise ValueError(f"{self.name} has no column {self.event_time}")

    @classmethod
    def from_meta(cls, spec: dict) -> StreamTable:
        """From a dictionary: fields (name, type, optional, watermark, metadata) and outer sections, which win."""
        fields, times, clocks, meta = [], {}, [], {}
        for f in spec["fields"]:
            if f["type"] == "proctime":
                clocks.append(f["name"])
                continue
            if f.get("metadata"):
                meta[f["name"]] = f["metadata"]
            if f.get("watermark"):
                times[f["name"]] = f["watermark"]
            fields.append(T.StructField(f["name"], T.DataType.fromDDL(TYPES.get(f["type"], f["type"])), bool(f.get("optional", False))))
        meta |= spec.get("metadataFields", {})
        for name, text in spec.get("timeAttributes", {}).items():
            if text:
                times = {name: text}
            else:
                clocks.append(name)
        column, delay = watermark_declaration(next(iter(times.values()))) if times else (None, None)
        return cls(spec["name"], T.StructType(fields), column, delay, clocks, spec.get("primaryKey", []), meta, spec.get("options", {}))

    @classmethod
    def from_ddl(cls, name: str, columns: str, watermark: str | None = None, primary_key: list[str] | None = None) -> StreamTable:
        """From a column list such as 'id BIGINT NOT NULL, ts TIMESTAMP'."""
        column, delay = watermark_declaration(watermark) if watermark else (None, None)
        return cls(name, T.StructType.fromDDL(columns), column, delay, primary_key=primary_key or [])

    @classmethod
    def from_avro(cls, text: str, watermark: str | None = None) -> StreamTable:
        """From an Avro record schema in JSON; a union with null makes a column nullable."""

        def of(t) -> tuple[T.DataType, bool]:
            if isinstance(t, list):
                rest = [x for x in t if x != "null"]
                return of(rest[0])[0], "null" in t
            if isinstance(t, dict):
                kind = t["type"]
                if t.get("logicalType") in ("timestamp-millis", "timestamp-micros"):
                    return T.TimestampType(), False
                if t.get("logicalType") == "date":
                    return T.DateType(), False
                if kind == "record":
                    return record(t), False
                if kind == "array":
                    return T.ArrayType(*of(t["items"])), False
                if kind == "map":
                    return T.MapType(T.StringType(), *of(t["values"])), False
                return of(kind)
            return T.DataType.fromDDL(TYPES[t]), False

        def record(t: dict) -> T.StructType:
            return T.StructType([T.StructField(f["name"], *of(f["type"])) for f in t["fields"]])

        spec = json.loads(text)
        column, delay = watermark_declaration(watermark) if watermark else (None, None)
        return cls(spec["name"], record(spec), column, delay)

    def apply(self, df: DataFrame) -> DataFrame:
        """df with this table's columns and types, metadata columns, clocks and, where streaming, the watermark.

        A dotted event-time column is a field of a struct; a stream gets it as a column of its own, dots as underscores.
        """
        cols = [F.col(self.metadata.get(f.name, f.name)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        cols += [F.col(source).alias(name) for name, source in self.metadata.items() if name not in self.schema.fieldNames()]
        out = df.select(*cols, *(F.current_timestamp().alias(p) for p in self.processing_time))
        if self.event_time and df.isStreaming:
            name = self.event_time.replace(".", "_")
            out = out.withColumn(name, F.col(self.event_time).cast("timestamp")).withWatermark(name, self.delay)
        return out

    def decode(self, df: DataFrame, value: str = "value") -> DataFrame:
        """This table from JSON text in a column; fields that are missing or malformed are null."""
        parsed = F.from_json(F.col(value).cast("string"), self.schema, {"mode": "PERMISSIVE"})
        return self.apply(df.withColumn("_v", parsed).select(*(c for c in df.columns if c != value), "_v.*"))

    def encode(self, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
        """(key, value): JSON of the key columns and of all columns."""
        keys = keys or self.primary_key
        key = F.to_json(F.struct(*keys)) if keys else F.lit(None).cast("string")
        return df.select(key.alias("key"), F.to_json(F.struct(*self.schema.fieldNames())).alias("value"))


PLACEHOLDER = re.compile(r"\[\[\s*STREAM\s*:\s*([\w.-]+)\s*\]\]", re.I)


def run_sql(spark: SparkSession, text: str, streams: dict[str, DataFrame]) -> DataFrame:
    """SQL whose [[STREAM:name]] places stand for frames; names don't regard case."""
    by = {k.lower(): v for k, v in streams.items()}
    used: dict[str, DataFrame] = {}

    def place(m: re.Match) -> str:
        name = m[1].lower()
        if name not in by:
            raise KeyError(f"no stream {m[1]}")
        arg = "s_" + re.sub(r"\W", "_", name)
        used[arg] = by[name]
        return "{" + arg + "}"

    return spark.sql(PLACEHOLDER.sub(place, text), **used) if PLACEHOLDER.search(text) else spark.sql(text)


def plans_of(frames: list[DataFrame], numbers: list[int]) -> list[str]:
    """The extended plans of some of the frames, by their numbers."""
    out = []
    for n in numbers:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            frames[n].explain("extended")
        out.append(text.getvalue())
    return out


class Statements:
    """Statements that each fill a sink from streams and from the sinks before them, running side by side.

    Each is a streaming query into Parquet files under folder, which later statements read as a stream, as does a side query,
    whose rows go to files of their own. ``settle`` waits until all that has come so far went through all of them; ``stop``
    ends them. If one fails, all are stopped and its error is raised.
    """

    def __init__(self, spark: SparkSession, statements: list[tuple[str, str]], streams: dict[str, DataFrame], folder: str, side: str | None = None, every: str = "200 milliseconds"):
        self.spark, self.folder, self.side = spark, folder, side
        self.frames, self.queries, self.sinks = list(streams.values()), {}, {}
        try:
            for name, text in [*statements, *([("side", side)] if side else [])]:
                frame = run_sql(spark, text, {**streams, **self.sinks})
                path = f"{folder}/{name}"
                make_folder(spark, path)
                query = frame.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(processingTime=every).start()
                self.queries[name] = query
                if name != "side" or not side:
                    self.frames.append(frame)
                self.sinks[name] = spark.readStream.schema(frame.schema).parquet(path)
        except BaseException:
            self.stop()
            raise

    def alive(self) -> int:
        return sum(q.isActive for q in self.queries.values())

    def settle(self) -> None:
        try:
            for query in self.queries.values():  # each after those that it may read from
                query.processAllAvailable()
                for other in self.queries.values():
                    if other.exception():
                        raise other.exception()
        except BaseException:
            self.stop()
            raise

    def stop(self) -> None:
        for query in self.queries.values():
            query.stop()

    def rows(self, name: str) -> DataFrame:
        """What a sink, or "side", holds."""
        return self.spark.read.schema(self.sinks[name].schema).parquet(f"{self.folder}/{name}")


def run_statements(spark: SparkSession, statements: list[tuple[str, str]], streams: dict[str, DataFrame], folder: str, side: str | None = None, explain: list[int] | None = None) -> tuple[dict[str, DataFrame], DataFrame | None, list[str]]:
    """Statements run side by side over all that is there: the sinks' rows by name, those of the side query, and the plans
    asked for: those of the streams first, then of the statements, counted from 0.
    """
    running = Statements(spark, statements, streams, folder, side)
    running.settle()
    running.stop()
    return {n: running.rows(n) for n, _ in statements}, running.rows("side") if side else None, plans_of(running.frames, explain or [])


def run_pipeline(spark: SparkSession, statements: list[tuple[str, str]], streams: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Named statements in order, each able to use the streams and the results before it."""
    out: dict[str, DataFrame] = {}
    for name, text in statements:
        out[name] = run_sql(spark, text, {**streams, **out})
    return out
