"""Table definitions, SQL placeholders, messages and time helpers."""

import pytest
from pyspark.sql import functions as F

from eventide.functions import messages as M
from eventide.functions import time as E
from eventide.operators import windows as O
from eventide.plans.tables import StreamTable, run_sql

PLAYS = {"name": "plays", "fields": [{"name": "song", "type": "long"}, {"name": "at", "type": "long_timestamp-millis", "watermark": "`at` - INTERVAL '30' SECONDS"}, {"name": "album", "type": "string", "optional": True}]}

pytestmark = pytest.mark.usefixtures("spark")  # column expressions need a session


def test_three_spellings_agree():
    meta = StreamTable.from_meta(PLAYS)
    ddl = StreamTable.from_ddl("plays", "song BIGINT NOT NULL, at TIMESTAMP NOT NULL, album STRING", "`at` - INTERVAL '30' SECOND")
    avro = StreamTable.from_avro('{"type": "record", "name": "plays", "fields": [{"name": "song", "type": "long"}, {"name": "at", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "album", "type": ["null", "string"]}]}', "`at` - INTERVAL '30' SECONDS")
    assert meta.schema == ddl.schema == avro.schema
    assert (meta.event_time, meta.delay) == (ddl.event_time, ddl.delay) == (avro.event_time, avro.delay) == ("at", "30 seconds")


def test_outer_sections_win_and_empty_means_the_clock():
    spec = PLAYS | {"timeAttributes": {"seen": "", "song": "song - INTERVAL '1' MINUTE"}}
    got = StreamTable.from_meta(spec)
    assert (got.event_time, got.delay, got.processing_time) == ("song", "1 minutes", ["seen"])


def test_event_time_needs_its_column():
    with pytest.raises(ValueError):
        StreamTable.from_ddl("x", "a INT", "b - INTERVAL '1' SECOND")
    with pytest.raises(ValueError):
        E.watermark_declaration("a - 5")


def test_nested_avro(spark):
    text = '{"type": "record", "name": "r", "fields": [{"name": "tags", "type": {"type": "array", "items": "string"}}, {"name": "m", "type": {"type": "map", "values": "int"}}, {"name": "in", "type": {"type": "record", "name": "i", "fields": [{"name": "x", "type": "double"}]}}]}'
    assert StreamTable.from_avro(text).schema.simpleString() == "struct<tags:array<string>,m:map<string,int>,in:struct<x:double>>"


def test_placeholder_needs_its_stream(spark):
    with pytest.raises(KeyError):
        run_sql(spark, "SELECT * FROM [[STREAM:nothing]]", {})
    assert run_sql(spark, "SELECT 1 AS x", {}).first()["x"] == 1


def test_extractors(spark):
    df = spark.createDataFrame([({"eventtime": "7", "t": "x"}, '{"a": {"b": 5}, "s": "9", "z": 1.5}'), ({}, None)], "headers map<string,string>, payload string")
    h, p = F.col("headers"), F.col("payload")
    got = df.select(E.event_time("a.b", h, p), E.event_time("payload.$.a.b", h, p), E.event_time("z", h, p), E.event_time("header.t", h, p), E.event_time("header.eventtime", h, p)).collect()
    assert tuple(got[0]) == (5, 5, None, None, 7) and tuple(got[1]) == (None,) * 5


def test_enrichment_skips_only_what_fails(spark):
    df = spark.createDataFrame([({"a": "1"}, '{"x": 2}')], "headers map<string,string>, payload string")
    out = M.enrich_headers(df, "b=payload.x;c=payload.none;;d=header.a;e=").first()["headers"]
    assert out == {"a": "1", "b": "2", "d": "1"}
    assert M.enrich_headers(df, "").first()["headers"] == {"a": "1"}


def test_two_levels_at_a_boundary(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 00:00:09', 'u', 't', 3), (TIMESTAMP_NTZ '2024-01-01 00:00:07', 'u', 't', 4) AS x(ts, u, t, v)")
    out = {r["window_start"].second: r["total_score"] for r in O.two_level(df, "ts", "2 seconds", "5 seconds", "u", "t", "v").collect()}
    assert out == {10: 3, 5: 4}  # the window that ends at 10 counts there


def test_ties_in_top_k(spark):
    df = spark.createDataFrame([("g", 3, 5), ("g", 1, 5), ("g", 2, 5), ("g", 4, 1)], "g string, k int, n int")
    assert [r["k"] for r in O.top_k(df, ["g"], "n", "k", 2).orderBy("row_num").collect()] == [1, 2]


def test_collect_and_fold_need_keys(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts, 1 AS k")
    with pytest.raises(ValueError):
        O.collect_windows(df, "ts", "1 hour", [], ["k"], "k")
    with pytest.raises(ValueError):
        O.fold_windows(df, "ts", "1 hour", [], lambda a, b: None, "k int")


def test_mapping_gives_one_row_for_each(spark):
    with pytest.raises(Exception, match="one row for each"):
        O.map_messages(spark.range(5), lambda b: b.head(1)).collect()


def test_collected_window_has_the_first_headers(spark):
    rows = [(2, "b", {"content-type": "application/avro"}), (1, "a", {"content-type": "application/json", "x": "1"})]
    df = spark.createDataFrame(rows, "seq int, payload string, headers map<string,string>").selectExpr("*", "timestamp_ntz '2024-01-01 00:00:01' as ts", "'k' as k")
    out = O.collect_windows(df, "ts", "1 minute", ["k"], ["seq"], "payload", "headers").first()
    assert out["payloads"] == ["a", "b"] and out["headers"] == {"content-type": "multipart/json", "x": "1"}


def test_what_a_session_writes_goes_with_it(tmp_path):
    """Tables are in a folder of the session, which release empties and the end of the driver deletes."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
from pyspark.sql import SparkSession
from eventide.sources import shared
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}").getOrCreate()
import os
path = shared.fresh_path(spark, "some")
spark.range(3).write.parquet(path)
assert len([x for x in os.listdir("{tmp_path}") if x.startswith("session-")]) == 1 and spark.read.parquet(path).count() == 3
shared.release(spark)
assert not os.path.exists(path.removeprefix("file://"))
spark.range(3).write.parquet(shared.fresh_path(spark, "other"))
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
    assert not [x for x in os.listdir(tmp_path) if x.startswith("session-")]  # Spark makes an empty folder of its own
