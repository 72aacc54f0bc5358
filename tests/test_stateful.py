"""Streams with state of their own: as-of, bounded joins, levelled upserts, statements side by side, merging folds and pieces."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import windows as O
from eventide.plans.tables import Statements
from eventide.streaming import forms
from eventide.streaming import stateful as K


def files(spark, folder, schema, parts):
    """A stream that gives one part a batch."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_asof_over_batches_with_nulls_and_large_numbers(spark, tmp_path):
    r = random.Random(2)
    rows = [(n, r.choice("ab"), n * 60 + r.randrange(-900, 900), r.choice([None, 2**60 + n, n]) , r.random() < 0.4) for n in range(200)] + [(900, "z", 10**7, None, True)]
    parts = [rows[i : i + 67] for i in (0, 67, 134)]
    stream = files(spark, str(tmp_path), "n long, k string, t long, v long, version boolean", parts).withColumn("at", F.timestamp_seconds("t"))
    left = stream.where("not version").select("n", "k", "at")
    right = stream.where("version").select("k", F.col("at").alias("since"), "v", (F.col("v") / 3).alias("w"))
    got = {x["n"]: (x["v"], x["w"]) for x in forms.run_available(K.as_of_stream(left, right, "k", "at", "since", ["v", "w"], "1 hour")).collect()}
    want = {}
    for n, k, t, _, version in rows:
        if not version:
            past = [(s, v is not None, v or 0, v) for _, q, s, v, own in rows if own and q == k and s <= t]
            v = max(past)[3] if past else None
            want[n] = (v, None if v is None else float(v) / 3)
    assert got == want


def test_upsert_writes_each_row_once_a_level(spark, tmp_path):
    batches, fan = 16, 4
    stream = files(spark, str(tmp_path), "k long, at long", [[(n * 100 + k, n) for k in range(100)] for n in range(batches)])
    out = f"file://{tmp_path}/up"
    written = []
    merged = forms.latest_per_key

    def counted(df, keys, order):
        found = merged(df, keys, order)
        written.append(found.count())
        return found

    forms.latest_per_key = counted
    try:
        forms.upsert(stream, ["k"], ["at"], out, f"{out}-state", compact=fan).awaitTermination()
    finally:
        forms.latest_per_key = merged
    assert forms.read_upserted(spark, out, stream.schema, ["k"], ["at"]).count() == batches * 100
    # a merge of everything at each fourth batch would write 100 * (4 + 8 + 12 + 16) rows besides
    assert sum(written) <= batches * 100 * 2 + batches * 100


def test_outer_join_gives_rows_without_partner_once_closed(spark, tmp_path):
    schema = "k string, at timestamp, side string"
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    rows = [[("a", 0, "l"), ("b", 1, "l"), ("a", 5, "r")], [("c", 200, "l"), ("c", 205, "r")], [("d", 400, "l"), ("d", 401, "r")]]
    parts = [[(k, __import__("datetime").datetime.fromisoformat(at(m)), s) for k, m, s in part] for part in rows]
    stream = files(spark, str(tmp_path), schema, parts)
    left = stream.where("side = 'l'").select("k", F.col("at").alias("x"))
    right = stream.where("side = 'r'").select(F.col("k").alias("q"), F.col("at").alias("y"))
    got = forms.run_available(forms.join_within_time(left, right, "k", "q", "x", "y", "1 minute", "10 minutes", "left_outer"))
    assert sorted((r["k"], r["q"]) for r in got.collect() if r["q"]) == [("a", "a"), ("c", "c"), ("d", "d")]
    assert [r["k"] for r in got.collect() if not r["q"]] == ["b"]


def test_one_failing_statement_stops_all(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(5)], "id int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int").parquet(f"{tmp_path}/in")
    running = Statements(spark, [("fine", "SELECT id FROM [[STREAM:rows]]"), ("bad", "SELECT assert_true(id < 3) AS x, id FROM [[STREAM:fine]]")], {"rows": stream}, f"file://{tmp_path}/out")
    with pytest.raises(Exception):
        running.settle()
    assert running.alive() == 0 and sorted(r["id"] for r in running.rows("fine").collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(Exception):
        Statements(spark, [("ok", "SELECT id FROM [[STREAM:rows]]"), ("wrong", "SELECT no_such FROM [[STREAM:ok]]")], {"rows": stream}, f"file://{tmp_path}/out2")
    assert not [q for q in spark.streams.active if q.isActive]


def test_merging_fold_and_pieces_of_one_hot_key(spark):
    df = spark.range(2000).select(F.timestamp_seconds(F.col("id") % 90).alias("ts"), F.lit("hot").alias("k"), F.col("id").alias("v"), (F.col("id") % 7).alias("g")).repartition(5)
    fold = lambda keys, held: {tuple(r) for r in O.fold_merging(df, "ts", "1 minute", keys, lambda: 0, lambda s, r: s + r["v"], lambda a, b: a + b, lambda g, s: [{"k": str(g[keys[0]]), "at": g["window_start"].minute, "s": s}], "k string, at int, s long", held).collect()}
    for keys in (["k"], ["g"]):
        want = {tuple(r) for r in df.groupBy(F.col(keys[0]).cast("string"), F.minute("ts")).agg(F.sum("v")).collect()}
        assert fold(keys, 10_000) == fold(keys, 2) == want
    got = O.collect_pieces(df, "ts", "1 minute", ["k"], ["v"], "v", most=64, piece_rows=150)
    whole = {r["window_start"]: r["payloads"] for r in O.collect_windows(df, "ts", "1 minute", ["k"], ["v"], "v").collect()}
    pieces = got.collect()
    assert max(len(r["payloads"]) for r in pieces) == 64
    for at, payloads in whole.items():
        own = sorted((r["piece"], r["payloads"]) for r in pieces if r["window_start"] == at)
        assert [p for p, _ in own] == list(range(len(own))) and sum((x for _, x in own), []) == payloads
