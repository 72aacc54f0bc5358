"""Replayed watermarks on small hand-made arrivals, and that chunks don't matter."""

import random

import pytest
from pyspark.sql import functions as F

from eventide.operators import watermark as W


def arrivals(spark, rows):
    return spark.createDataFrame([(n, ts, part) for n, (ts, part) in enumerate(rows)], "seq long, ms long, part int")


def replay(spark, rows, disorder=2000, lateness=0, chunks=4, **more):
    out = W.replay(arrivals(spark, rows), "ms", ["seq"], "part", disorder, lateness, chunk_rows=-(-len(rows) // chunks) or 1, **more)
    return [(r["wm"], r["status"]) for r in out.orderBy("seq").collect()]


def by_hand(rows, disorder, lateness):
    tops, out = {}, []
    for ts, part in rows:
        wm = min(tops.values()) - disorder - 1 if tops else None
        if ts is None:
            status = "DISCARDED"
        elif wm is None or wm <= ts:
            status = "VALID"
        else:
            status = "LATE" if wm - lateness <= ts else "DISCARDED"
        out.append((wm, status))
        if status != "DISCARDED":
            tops[part] = max(tops.get(part, ts), ts)
    return out


def test_edges_of_one_partition(spark):
    rows = [(10_000, 0), (7_999, 0), (7_998, 0), (8_000, 0), (12_000, 0), (9_998, 0), (9_999, 0)]
    got = replay(spark, rows)
    assert [s for _, s in got] == ["VALID", "VALID", "DISCARDED", "VALID", "VALID", "DISCARDED", "VALID"]
    assert got[1][0] == 10_000 - 2000 - 1


def test_slow_partition_holds_the_watermark(spark):
    rows = [(3_000, 0), (1_000, 1), (50_000, 0), (2_000, 1), (60_000, 0), (1_500, 1)]
    got = replay(spark, rows)
    assert got == by_hand(rows, 2000, 0)
    assert [s for _, s in got] == ["VALID"] * 6 and got[4][0] == -1


@pytest.mark.parametrize("chunks", [1, 2, 5, 12])
def test_partition_that_begins_too_late_stays_unknown(spark, chunks):
    """Its discarded rows don't hold the watermark back; it begins with the first row that is not discarded."""
    rows = [(10_000, 0), (1_000, 1), (50_000, 0), (2_000, 1), (49_000, 2), (60_000, 0), (1_500, 1), (57_000, 0), (46_000, 1), (99_000, 2), (99_500, 1), (90_000, 0)]
    got = replay(spark, rows, 2000, 3000, chunks)
    assert got == by_hand(rows, 2000, 3000)
    assert [s for _, s in got][:4] == ["VALID", "DISCARDED", "VALID", "DISCARDED"] and got[8][1] == "LATE"


def test_rows_without_time_are_discarded(spark):
    assert [s for _, s in replay(spark, [(None, 0), (5_000, 0), (None, 1)])] == ["DISCARDED", "VALID", "DISCARDED"]


def test_late_within_lateness(spark):
    rows = [(20_000, 0), (15_000, 0), (11_000, 0), (13_000, 0)]
    assert [s for _, s in replay(spark, rows, 2000, 5000)] == ["VALID", "LATE", "DISCARDED", "LATE"]


@pytest.mark.parametrize("seed", range(4))
def test_chunks_do_not_matter(spark, seed):
    r = random.Random(seed)
    rows = [(None if r.random() < 0.05 else 1000 * n + r.randrange(-20_000, 20_000), r.randrange(3)) for n in range(120)]
    want = by_hand(rows, 3000, 6000)
    for chunks in (1, 7, 60):
        assert replay(spark, rows, 3000, 6000, chunks) == want


@pytest.mark.parametrize("seed", range(3))
def test_partitions_that_lag(spark, seed):
    r = random.Random(seed)
    lag = [r.choice([0, 0, 4_000, 30_000, 90_000]) for _ in range(9)]
    parts = [r.randrange(9) for _ in range(150)]
    rows = [(1000 * n + r.randrange(-3_000, 3_000) - lag[p], p) for n, p in enumerate(parts)]
    assert replay(spark, rows, 3000, 2000, 13) == by_hand(rows, 3000, 2000)


def test_more_partitions_than_columns(spark):
    rows = [(1000 * n, n * 7 % 200) for n in range(600)]
    assert replay(spark, rows, 400_000, 1000, 3) == by_hand(rows, 400_000, 1000)


def test_bursts_of_arrival_numbers_and_gaps(spark):
    rows = [(1000 * n + n * 37 % 11 * 900, n % 3) for n in range(200)]
    seqs = [n if n < 100 else 10**9 + n * n for n in range(200)]
    df = spark.createDataFrame([(s, ts, p) for s, (ts, p) in zip(seqs, rows)], "seq long, ms long, part int")
    out = W.replay(df, "ms", ["seq"], "part", 2000, 1000, chunk_rows=20).orderBy("seq").collect()
    assert [(x["wm"], x["status"]) for x in out] == by_hand(rows, 2000, 1000)


def test_carried_watermark_replaces_time(spark):
    df = spark.createDataFrame([(0, 100, 0, 50), (1, 200, 0, 90), (2, 10, 0, 80)], "seq long, ms long, part int, w long")
    out = W.replay(df, "ms", ["seq"], "part", 0, 0, watermark="w", chunk_rows=2).orderBy("seq").collect()
    assert [(r["wm"], r["status"]) for r in out] == [(None, "VALID"), (50, "VALID"), (90, "DISCARDED")]


def test_late_firing_adds_to_the_window(spark):
    rows = [(1_000, 0), (4_000, 0), (9_000, 0), (3_000, 0), (20_000, 0), (2_000, 0)]
    df = W.replay(arrivals(spark, rows).withColumn("k", F.lit("a")).withColumn("v", F.lit(1)), "ms", ["seq"], "part", 1000, 10_000, chunk_rows=3)
    out = W.fire_lateness(df, "ms", 5_000, ["k"], ["seq"], "v").collect()
    first = {(r["window_start"].second, r["late"]): r["n"] for r in out}
    assert first[0, False] == 2 and first[0, True] == 3 and first[5, False] == 1
    assert [r["seq"] for r in out if r["late"]] == [3]  # row 5 is beyond the lateness


def test_a_jump_emits_every_window(spark):
    rows = [(1_000, 0), (6_000, 0), (11_000, 0), (900_000, 0)]
    df = W.replay(arrivals(spark, rows), "ms", ["seq"], "part", 0, 0, chunk_rows=2)
    out = W.fire_strict(df, "ms", 5_000, [], n=F.count("*")).collect()
    assert len(out) == 4 and {r["n"] for r in out} == {1}


def test_policies(spark):
    df = W.replay(arrivals(spark, [(20_000, 0), (15_000, 0), (1_000, 0)]), "ms", ["seq"], "part", 2000, 5000)
    count = lambda p: tuple(x.count() for x in W.split_late(df, p))
    assert count("DROP") == (1, 0) and count("UPSERT") == (2, 0) and count("SIDE_CHANNEL") == (1, 1)
    with pytest.raises(ValueError):
        W.split_late(df, "OTHER")


def test_empty_stream(spark):
    assert replay(spark, []) == []


def chunk_sizes(spark, seqs, rows):
    df = spark.createDataFrame([(x,) for x in seqs], "seq long")
    return [r["count"] for r in W.in_pieces(df, ["seq"], rows, len(seqs), "_chunk").groupBy("_chunk").count().orderBy("_chunk").collect()]


def test_chunks_are_even_whatever_the_numbers(spark):
    """One row with a number far below all others, and a burst, leave chunks even."""
    for seqs in ([0, *range(10**12, 10**12 + 20_000)], [n if n < 10_000 else 10**9 + n * n for n in range(20_000)]):
        sizes = chunk_sizes(spark, seqs, 1000)
        assert len(sizes) >= 20 and max(sizes) <= 2000 and sum(sizes) == len(seqs)


def test_passes_do_not_grow_with_chunks(spark, monkeypatch):
    """Partitions that begin one chunk apart, each with a discarded row."""
    passes = []
    looked = W._accepted
    monkeypatch.setattr(W, "_accepted", lambda *a: passes.append(1) or looked(*a))
    counts = {}
    for chunks in (4, 12):
        rows = []
        for c in range(chunks):
            for n in range(20):
                t = 1000 * len(rows)
                rows.append((t - 10**9, c) if n == 5 and c else (t, c if n > 5 else max(0, c - 1)))
        passes.clear()
        assert replay(spark, rows, 2000, 1000, chunks) == by_hand(rows, 2000, 1000)
        counts[chunks] = len(passes)
    assert counts[12] <= counts[4] + 1 <= 6


def test_passes_do_not_grow_with_discarded_rows(spark, monkeypatch):
    """Partitions that wait for one another in a chunk: each row of theirs is DISCARDED under the first one until time catches up."""
    passes = []
    looked = W._accepted
    monkeypatch.setattr(W, "_accepted", lambda *a: passes.append(1) or looked(*a))
    rows = [(100_000, 0), *((1000 * n, 1 + n % 3) for n in range(240))]
    assert replay(spark, rows, 0, 10_000, 2) == by_hand(rows, 0, 10_000)
    assert len(passes) <= 3


def test_row_discarded_before_its_partition_begins_does_not_count(spark):
    """Partition 1 has a DISCARDED row with a larger time than the one it begins with, under which partition 3 begins."""
    rows = [(80_000, 0), (50_000, 1), (61_000, 2), (45_000, 1), (27_000, 3), (90_000, 0), (91_000, 2), (92_000, 1), (30_000, 0), (5_000, 4), (95_000, 3), (70_000, 4)]
    for chunks in (3, 6):
        assert replay(spark, rows, 19_999, 0, chunks) == by_hand(rows, 19_999, 0)


def test_firings_of_a_hot_window_in_pieces(spark):
    r = random.Random(5)
    rows = [(r.randrange(100_000), 0) for _ in range(400)]
    df = W.replay(arrivals(spark, rows).withColumn("k", F.when(F.col("seq") % 9 > 0, "hot")).withColumn("v", F.when(F.col("seq") % 7 > 0, F.col("seq"))), "ms", ["seq"], "part", 5_000, 60_000)
    whole = sorted(map(str, W.fire_lateness(df, "ms", 50_000, ["k"], ["seq"], "v").collect()))
    assert whole == sorted(map(str, W.fire_lateness(df, "ms", 50_000, ["k"], ["seq"], "v", piece_rows=17).collect())) and len(whole) > 50


@pytest.mark.parametrize("cuts", [[40], [1, 2, 90], [30, 60, 61, 100]])
def test_state_carried_between_batches(spark, cuts):
    """Whatever the cut into batches, rows are those of one replay."""
    r = random.Random(len(cuts))
    lag = [0, 0, 30_000, 90_000]
    rows = [(1000 * n + r.randrange(-3_000, 3_000) - lag[p], p) for n, p in enumerate(r.randrange(4) for _ in range(120))]
    df, state, got = arrivals(spark, rows).withColumn("part", F.col("part").cast("string")), None, []
    for low, high in zip([0, *cuts], [*cuts, 120]):
        out = W.replay(df.where(f"seq >= {low} and seq < {high}"), "ms", ["seq"], "part", 3000, 2000, chunk_rows=25, state=state)
        found = out.orderBy("seq").collect()
        got += [(x["wm"], x["status"]) for x in found]
        after = W.state_after(out, "ms", "part", state).collect()
        state = spark.createDataFrame([tuple(x) for x in after], "part string, top long")
    assert got == by_hand(rows, 3000, 2000)
