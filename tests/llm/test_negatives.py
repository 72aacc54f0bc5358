"""Hard negatives against SQL and a plain version."""

import math
import random

import numpy as np
import pytest
from compare import check, connect
from conftest import DATA
from pyspark.sql import functions as F

from eventide.llm import negatives


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_whole_tables_by_sql(spark, sf):
    check(negatives.op12_hard_negatives(spark, f"{DATA}/{sf}"), connect(f"{DATA}/{sf}"), negatives.ORACLE)


def by_hand(rows, anchors):
    out, seen = [], []
    usable = lambda r: all(x is not None for x in r) and all(x is not None and math.isfinite(x) for x in r[2])
    rows = [r for r in rows if usable(r)]
    for a in anchors:
        if not usable(a) or a in seen:
            continue
        seen.append(a)
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(a[2], r[2])), r[0], r[1]) for r in rows)
        for s, i, _ in [x for x in scored if x[2] == a[1] and x[1] != a[0]][:5]:
            inside = [x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(a[0], i, n + 1, x[1], -s, -x[0]) for n, x in enumerate(inside[:3])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, v array<double>").repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_ties_copies_nulls_and_lengths(spark, seed, monkeypatch):
    r = random.Random(seed)
    vec = lambda n=6: [float(r.randrange(-9, 10)) for _ in range(n)]
    rows = [(n, r.randrange(3), vec()) for n in range(120)] + [(200 + n, n % 2, [5.0, 4.0, 3.0, 0.0, 0.0, 0.0]) for n in range(60)]
    rows += [(3, 1, vec()), (300, None, vec()), (None, 1, vec()), (301, 1, None), (302, 1, [1.0, None]), (303, 1, [float("nan")]), (304, 2, [float("inf")]), (305, 2, []), (306, 0, vec(3)), (307, 0, vec(3))]
    rows += [rows[10]] * 2
    anchors = [x for x in rows if x[0] is not None and x[0] % 5 == 0] + [(400, 9, vec())]
    monkeypatch.setattr(negatives, "BLOCK", 40)
    got = negatives.hard_negatives(frame(spark, rows), frame(spark, anchors).withColumn("block", F.lit(1)))
    assert sorted(tuple(x) for x in got.collect()) == by_hand(rows, anchors)


def test_negative_and_zero_scores(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 3.0]), (2, 2, [0.0, 1.0]), (3, 2, [-1.0, 0.0]), (4, 1, [-2.0, 0.0]), (5, 2, [0.0, 2.0])]
    got = sorted(tuple(x) for x in negatives.hard_negatives(frame(spark, rows), frame(spark, rows[:1])).collect())
    assert got == by_hand(rows, rows[:1]) == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 5, 0, 0)]


def test_no_rows_and_no_anchors(spark):
    none = spark.createDataFrame([], "id long, label long, v array<double>")
    some = frame(spark, [(1, 1, [1.0])])
    assert negatives.hard_negatives(none, none).count() == negatives.hard_negatives(some, none).count() == negatives.hard_negatives(none, some).count() == 0


def test_scores_beyond_doubles(spark):
    big = float(2**29 + 1)
    rows = [(n, n % 2, [big, big - n]) for n in range(8)] + [(9, 1, [big * 0.75 // 1, big * 0.75 // 1])]
    got = sorted(tuple(x) for x in negatives.hard_negatives(frame(spark, rows), frame(spark, rows[:1])).collect())
    assert got == by_hand(rows, rows[:1])


@pytest.mark.parametrize("seed", range(6))
def test_index_finds_all_pairs_and_prunes(seed):
    g = np.random.default_rng(seed)
    v = np.floor(g.normal(size=(400, 40)) * 30 / (1 + np.arange(40)))
    q = v[:50]
    all_scores = q @ v.T
    for least in (np.full(50, -1e18), np.zeros(50), np.quantile(all_scores, 0.99, axis=1), all_scores.max(1)):
        index = negatives.Index(v, q, float(least.min()))
        i, j, s = index.search(q, least)
        assert set(zip(i, j)) == set(zip(*np.nonzero(all_scores >= least[:, None]))) and (all_scores[i, j] == s).all()
    assert index.cut.mean() < 40  # some dimensions are not indexed
