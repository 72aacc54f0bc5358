"""Pieces shared by the corpus operators: shared storage, Arrow mapping and graph components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import fresh_path, remove, shared_dir  # noqa: F401

_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


#: Spark's switch that deletes a query's shuffle files as it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch(spark: SparkSession, shuffles: bool = False) -> Iterator[str]:
    """Tables materialized within are removed at its end; what is needed later is materialized with keep.

    shuffles: the files of shuffles within go with each query.
    """
    folder, cleanup = fresh_path(spark, "scratch"), spark.conf.get(CLEANUP, "false")
    before = _SCRATCH.set(folder)
    if shuffles:
        spark.conf.set(CLEANUP, "true")
    try:
        yield folder
    finally:
        if shuffles:
            spark.conf.set(CLEANUP, cleanup)
        _SCRATCH.reset(before)
        remove(spark, folder)


def around() -> str | bool:
    """For materialize's keep: the folder of the scratch that is open now, or True."""
    return _SCRATCH.get() or True


def materialize(df: DataFrame, tag: str, keep: bool | str = False) -> DataFrame:
    """Write df once to the shared folder and read it back, so that later uses neither recompute nor lose it.

    keep: not to the folder of the scratch that is open, but to the session's, or to the folder named.
    """
    spark = df.sparkSession
    folder = keep if isinstance(keep, str) else None if keep else _SCRATCH.get()
    path = f"{folder}/{tag}-{uuid.uuid4().hex}" if folder else fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FEW_IDS = 1 << 20


def few_ids(ids: DataFrame) -> DataFrame:
    """ids (a written table of narrow rows), broadcast in joins if they are counted to be FEW_IDS, about 30 MB, at most; others are shuffled."""
    return F.broadcast(ids) if ids.limit(FEW_IDS + 1).count() <= FEW_IDS else ids


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of texts, unless the session has its own settings; results don't depend on them."""
    own = spark.conf.getAll
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        if key not in own:
            spark.conf.set(key, str(value))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch of df."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Component of each node of an edge list (u, v: long): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps: every step only joins an edge list with one minimum per
    node, so it shuffles in proportion to the edges and never gathers a component in one place. Each
    round is written to the shared folder; only a count and a checksum reach the driver. Self-loops,
    repeated edges and nulls are ignored; an empty list gives an empty result.
    """
    links = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, seen = materialize(links, "links"), None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first, so that the join deals both sides anew and can divide the links of a node with very many
        low = materialize(both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.inline(F.expr("array(struct(v as u, low as v), struct(u as u, low as v))"))).where("u <> v").distinct()
        links = materialize(small, "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
