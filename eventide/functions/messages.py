"""Messages: headers (a map of strings) and a payload (JSON text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def envelope(df: DataFrame, *fields: str, headers: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, headers, payload): payload is the JSON of fields."""
    pairs = [x for k, v in (headers or {}).items() for x in (F.lit(k), v.cast("string"))]
    head = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return df.select(*keep, head.alias("headers"), F.to_json(F.struct(*fields)).alias("payload"))


def transform_payload(df: DataFrame, expression: str) -> DataFrame:
    """A new payload from a SQL expression over payload and headers; headers stay."""
    return df.withColumn("payload", F.expr(expression))


def enrich_headers(df: DataFrame, declaration: str) -> DataFrame:
    """Add headers: 'name=payload.<path>;name=header.<name>'. Empty parts and null results are skipped."""
    pairs = []
    for part in declaration.split(";"):
        name, _, source = (x.strip() for x in part.partition("="))
        if not name or not source:
            continue
        if source.startswith("header."):
            value = F.col("headers")[source.removeprefix("header.")]
        else:
            path = source.removeprefix("payload.")
            value = F.get_json_object("payload", path if path.startswith("$") else f"$.{path}")
        pairs += [F.lit(name), value]
    if not pairs:
        return df
    added = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return df.withColumn("headers", F.map_concat(F.map_filter("headers", lambda k, v: ~F.array_contains(F.map_keys(added), k)), added))


def stamp(df: DataFrame, **values: Column) -> DataFrame:
    """Set headers to values, as strings; null values are skipped."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    added = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return df.withColumn("headers", F.map_concat(F.map_filter("headers", lambda k, v: ~k.isin(*values)), added))


def headers_text(headers: Column) -> Column:
    """Headers as sorted 'name=value' lines, for output and comparison."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
