"""Plans: filters and columns reach the scan, aggregation is partial, ranking is limited early, as-of on hot keys."""

import io
import random
import re
from contextlib import redirect_stdout

from conftest import DATA
from eventide.operators import watermark as W
from eventide.operators import windows as O
from eventide.plans import catalog

FOLDER = f"{DATA}/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(catalog.iot_error_count(spark, FOLDER))
    assert "EqualTo(event_type,error)" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,props:string>" in text
    assert text.count("Exchange") == 2 * 1 or "partial_count" in text
    assert "Python" not in text


def test_ranking_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(catalog.topk_per_window(spark, FOLDER))


def test_replay_has_no_global_window_over_rows(spark):
    text = plan(W.replay(catalog.arrivals(spark, FOLDER), "ms", ["seq", "event_id"], "part", catalog.DISORDER, catalog.LATENESS, chunk_rows=100))
    assert "SinglePartition" not in text
    assert "hashpartitioning(_chunk" in text


def test_as_of_against_brute_force(spark):
    r = random.Random(8)
    right = [(r.choice("abh"), r.randrange(500) * 3600, r.randrange(100)) for _ in range(60)] + [(None, 5, 1), ("a", None, 2)]
    left = [(n, r.choice("abch"), r.randrange(500) * 3600) for n in range(200)] + [(900, None, 5), (901, "a", None)]
    at = "timestamp_seconds(t)"
    a = spark.createDataFrame(left, "n int, k string, t long").selectExpr("n", "k", f"{at} as at")
    b = spark.createDataFrame(right, "k string, t long, v int").selectExpr("k", f"{at} as since", "v")
    got = {x["n"]: x["v"] for x in O.as_of(a, b, "k", "at", "since", ["v"], "6 hours").collect()}
    for n, k, t in left:
        past = [(s, v) for q, s, v in right if q == k and k is not None and t is not None and s is not None and s <= t]
        assert got[n] == (max(past)[1] if past else None)
