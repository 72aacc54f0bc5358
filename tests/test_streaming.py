"""Streaming forms against batch, and operators that exist only as streams."""

import time

import pytest
from pyspark.sql import functions as F

from eventide.operators import watermark as W
from eventide.sources import messages as S
from eventide.streaming import forms


@pytest.fixture()
def source(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:{s:02d}", f"u{(m + s) % 3}", f"t{m % 2}", m + s) for m in range(0, 30) for s in (5, 35)]
    df = spark.createDataFrame(rows, "at string, u string, t string, v int").withColumn("at", F.to_timestamp("at"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return lambda streaming=True, **more: S.read_files(spark, str(tmp_path / "in"), df.schema, streaming, **more)


def test_windows_equal_batch_but_for_open_ones(spark, source):
    got = forms.run_available(forms.windowed(source(), "at", "1 second", "5 minutes", ["t"], F.count("*").alias("n")).drop("w"))
    batch = source(False).groupBy(F.window("at", "5 minutes").alias("w"), "t").agg(F.count("*").alias("n")).where("w.end <= timestamp'2024-01-01 00:29:35'")
    assert sorted(map(tuple, got.select("window_start", "t", "n").collect())) == sorted(map(tuple, batch.select("w.start", "t", "n").collect()))


def test_two_levels(spark, source):
    got = forms.run_available(forms.two_level_windows(source(), "at", "1 second", "1 minute", "10 minutes", "u", "t", "v"))
    total = source(False).where("at < timestamp'2024-01-01 00:20:00'").agg(F.sum("v")).first()[0]
    assert got.agg(F.sum("total_score")).first()[0] == total


def test_late_rows_go_to_two_places(spark, source, tmp_path):
    def tag(batch):
        rows = batch.select(F.unix_millis("at").alias("ms"), F.hash("u", "v").cast("long").alias("seq"), F.lit(0).alias("part"))
        return W.replay(rows, "ms", ["seq"], "part", 60_000, 300_000, chunk_rows=20)

    main, side = str(tmp_path / "main"), str(tmp_path / "side")
    forms.write_split(source(), tag, "SIDE_CHANNEL", main, side, str(tmp_path / "state")).awaitTermination()
    want = tag(source(False)).groupBy("status").count().collect()
    want = {r["status"]: r["count"] for r in want}
    assert (spark.read.parquet(main).count(), spark.read.parquet(side).count()) == (want.get("VALID", 0), want.get("LATE", 0))


def test_upsert_over_batches(spark, source, tmp_path):
    stream = source(files_per_batch=1)
    forms.upsert(stream, ["u"], ["at"], str(tmp_path / "up"), str(tmp_path / "up-state"), compact=2).awaitTermination()
    got = forms.read_upserted(spark, str(tmp_path / "up"), stream.schema, ["u"], ["at"])
    assert spark.read.parquet(str(tmp_path / "up" / "list")).select("batch").distinct().count() == 3
    want = source(False).groupBy("u").agg(F.max_by("v", "at")).collect()
    assert sorted(map(tuple, got.select("u", "v").collect())) == sorted(map(tuple, want))


def test_idle_windows_are_released(spark, source, tmp_path):
    stream = forms.release_idle(source(), "at", "u", "v", "1 hour", "1 second")
    query = stream.writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "idle")).start()
    end = time.time() + 60
    while time.time() < end and spark.table("idle").count() < 3:
        time.sleep(1)
    query.stop()
    rows = spark.table("idle").collect()
    assert len(rows) == 3 and all(r["partial"] for r in rows) and sum(r["n"] for r in rows) == 60


def test_clock_upper_log(spark, tmp_path):
    ticks = S.clock(spark, 20).withColumn("payload", F.upper(F.concat(F.lit("t "), "payload")))
    query = S.show(ticks, "ticks")
    end = time.time() + 30
    while time.time() < end and not spark.table("ticks").count():
        time.sleep(0.5)
    query.stop()
    assert spark.table("ticks").first()["payload"].startswith("T ")


def test_bridge_forwards_unchanged(spark, source, tmp_path):
    S.bridge(source(), str(tmp_path / "out"), str(tmp_path / "out-state"), "json").awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 60


def test_topic_envelope(spark):
    df = spark.sql("SELECT 1L AS offset, 0 AS partition, array(named_struct('key', 'a', 'value', binary('1')), named_struct('key', 'a', 'value', binary('2'))) AS headers, binary('p') AS value, current_timestamp() AS timestamp, binary('k') AS key")
    row = S.topic_envelope(df).first()
    assert row["headers"] == {"a": "2"} and row["payload"] == "p" and row["the_key"] == "k"


def test_state_store_setting(spark):
    forms.use_state_store(spark)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == forms.ROCKSDB
    forms.use_state_store(spark, "MEMORY")


def test_upsert_merges_versions_and_removes_old_ones(spark, tmp_path):
    import os

    schema = "k int, at int, v string"
    for n in range(9):
        spark.createDataFrame([(k, n * 10 + k, f"{n}:{k}") for k in range(n % 4, 8)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    forms.upsert(stream, ["k"], ["at"], f"file://{tmp_path}/out", f"file://{tmp_path}/state", compact=3).awaitTermination()
    got = {r["k"]: r["v"] for r in forms.read_upserted(spark, f"file://{tmp_path}/out", stream.schema, ["k"], ["at"]).collect()}
    newest = {k: max((n * 10 + k, f"{n}:{k}") for n in range(9) if n % 4 <= k)[1] for k in range(8)}
    assert got == newest
    assert len([x for x in os.listdir(f"{tmp_path}/out/rows") if "=" in x]) <= 6


def test_statements_explain_and_sinks(spark, tmp_path):
    from eventide.plans.tables import run_statements

    spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, k int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, k int").parquet(f"{tmp_path}/in")
    sinks, side, plans = run_statements(spark, [("ones", "SELECT id FROM [[STREAM:rows]] WHERE k = 1"), ("even", "SELECT id FROM [[STREAM:ones]] WHERE id % 2 = 0")], {"rows": stream}, f"file://{tmp_path}/out", explain=[1])
    assert side is None and len(plans) == 1 and "Physical Plan" in plans[0]
    assert sorted(r["id"] for r in sinks["even"].collect()) == [i for i in range(30) if i % 3 == 1 and i % 2 == 0]


def test_late_firings_by_policy(spark):
    from eventide.operators import watermark as W

    df = spark.createDataFrame([(1, False), (2, True)], "n int, late boolean")
    count = lambda p: tuple(x.count() for x in W.split_firings(df, p))
    assert (count("DROP"), count("UPSERT"), count("SIDE_CHANNEL")) == ((1, 0), (2, 0), (1, 1))
