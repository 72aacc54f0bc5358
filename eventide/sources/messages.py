"""Sources and sinks of messages: topics, files, the clock, and bridges between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_topic(spark: SparkSession, topic: str, servers: str, startup: str = "earliest", group: str | None = None, streaming: bool = True) -> DataFrame:
    """A Kafka topic with headers; startup is earliest-offset, latest-offset or Spark's own offsets. Needs the Kafka package."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("includeHeaders", "true")
    reader = reader.option("startingOffsets", startup.removesuffix("-offset"))
    return (reader.option("groupIdPrefix", group) if group else reader).load()


def topic_envelope(df: DataFrame) -> DataFrame:
    """(seq, partition, headers, payload, event_time, key) of a Kafka frame; repeated headers keep the last value."""
    last = F.expr("""aggregate(coalesce(headers, cast(array() AS array<struct<key:string,value:binary>>)), cast(map() AS map<string,string>),
        (m, h) -> map_concat(map_filter(m, (k, v) -> k <> h.key), map(h.key, cast(h.value AS string))))""")
    return df.select(F.col("offset").alias("seq"), "partition", last.alias("headers"), F.col("value").cast("string").alias("payload"), F.col("timestamp").alias("event_time"), raw_key(F.col("key")).alias("the_key"))


def raw_key(key: Column) -> Column:
    return key.cast("string")


def read_files(spark: SparkSession, path: str, schema, streaming: bool = True, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """Files as a stream, or as the same frame in batch for replay."""
    if not streaming:
        return spark.read.schema(schema).format(fmt).load(path)
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def clock(spark: SparkSession, rows_per_second: int = 1, pattern: str = "dd/MM/yyyy HH:mm:ss") -> DataFrame:
    """A stream of the formatted current time."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.col("value").alias("seq"), "timestamp", F.date_format("timestamp", pattern).alias("payload"))


def without_registry_prefix(value: Column) -> Column:
    """Bytes without the five that a schema registry puts before them, a zero and the schema's number; others as they are."""
    return F.when(F.substring(value, 1, 1) == F.lit(bytes(1)), value.substr(F.lit(6), F.octet_length(value))).otherwise(value)


def avro_payload(value: Column, schema: str) -> Column:
    """A record from Avro bytes, with or without the five bytes of a registry. Needs the Avro package."""
    from pyspark.sql.avro.functions import from_avro

    return from_avro(without_registry_prefix(value), schema)


def bridge(source: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True):
    """Forward a stream unchanged into files; returns the running query."""
    writer = source.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def show(source: DataFrame, name: str | None = None):
    """Print a stream as it comes, or hold it in memory under a name."""
    writer = source.writeStream.outputMode("append")
    return (writer.format("memory").queryName(name) if name else writer.format("console").option("truncate", "false")).start()
