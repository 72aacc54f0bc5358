"""Event time: extractors, watermark declarations and window assignment, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp with or without zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def from_ms(ms: Column) -> Column:
    """A timestamp without zone from milliseconds since 1970."""
    return F.timestamp_add("MILLISECOND", ms, F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"))


def interval_ms(text: str) -> int:
    """'5 seconds' in milliseconds."""
    m = re.fullmatch(r"\s*(\d+)\s+([a-zA-Z]+?)s?\s*", text)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not an interval: {text!r}")
    return int(m[1]) * UNITS[m[2].lower()]


def watermark_declaration(text: str) -> tuple[str, str]:
    """(column, delay) of "`col` - INTERVAL 'n' UNIT"; the column may be dotted."""
    m = re.fullmatch(r"\s*`?([\w.]+)`?\s*-\s*INTERVAL\s*'?(\d+)'?\s*([A-Za-z]+?)S?\s*", text, re.I)
    if not m or m[3].lower() not in UNITS:
        raise ValueError(f"not a watermark: {text!r}")
    return m[1], f"{m[2]} {m[3].lower()}s"


def payload_time(payload: Column, path: str) -> Column:
    """Event time in milliseconds from a JSON path ('$.' optional); only a JSON number counts, else null."""
    path = path if path.startswith("$") else f"$.{path}"
    return F.when(F.get_json_object(payload, path).rlike(r"^-?[0-9]+$"), F.get_json_object(payload, path).try_cast("bigint"))


def header_time(headers: Column, name: str) -> Column:
    return headers[name].try_cast("bigint")


def processing_time() -> Column:
    return F.unix_millis(F.current_timestamp())


def event_time(expression: str | None, headers: Column, payload: Column) -> Column:
    """The extractor an expression names.

    None: the eventtime header, else the clock; 'proc': the clock; 'header.x': a header; 'payload.x' or 'x': a path.
    """
    if not expression:
        return F.coalesce(header_time(headers, "eventtime"), processing_time())
    if expression == "proc":
        return processing_time()
    if expression.startswith("header."):
        return header_time(headers, expression.removeprefix("header."))
    return payload_time(payload, expression.removeprefix("payload."))


def tumble(df: DataFrame, ts: str, size: str) -> DataFrame:
    """df with window_start and window_end of its tumbling window."""
    return _flat(df, F.window(ts, size))


def hop(df: DataFrame, ts: str, size: str, slide: str) -> DataFrame:
    """df with a row for each sliding window that a row is in."""
    return _flat(df, F.window(ts, size, slide))


def _flat(df: DataFrame, window: Column) -> DataFrame:
    return df.withColumn("_w", window).select(*df.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"))


def cumulate(df: DataFrame, ts: str, step: str, size: str) -> DataFrame:
    """df with a row for each cumulating window: from the start of its window of size to each later end by steps."""
    step_ms, size_ms = interval_ms(step), interval_ms(size)
    ms = epoch_ms(ts)
    start = ms - F.pmod(ms, F.lit(size_ms))
    first = F.floor((ms - start) / step_ms) + 1
    ends = F.explode(F.sequence(first.cast("long"), F.lit(size_ms // step_ms).cast("long")))
    held = df.withColumn("_start", start).withColumn("_n", ends)
    return held.select(*df.columns, from_ms(F.col("_start")).alias("window_start"), from_ms(F.col("_start") + F.col("_n") * step_ms).alias("window_end"))
