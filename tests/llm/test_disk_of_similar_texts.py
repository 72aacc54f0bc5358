"""What the search for near duplicates holds on disk: tables and shuffles of one step, and texts only of pairs that may be similar."""

import random
from pathlib import Path

import numpy as np
import pytest

from eventide.llm import simhash
from eventide.sources.shared import session_dir
from test_operators import components_by_hand, frame, jaccard


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


def asked(monkeypatch, seen=lambda: None):
    """Fills with the pairs of each comparison as it begins; seen is called then."""
    pairs, compared = [], simhash.compared

    def spy(some, *args, **kwargs):
        seen()
        pairs.append({(x["u"], x["v"]) for x in some.collect()})
        return compared(some, *args, **kwargs)

    monkeypatch.setattr(simhash, "compared", spy)
    return pairs


def long_texts():
    """Texts of 3,000 words of which each two share 12, so that many of their prefixes meet; two pairs of similarity near 0.8, and short texts."""
    r = random.Random(5)
    words = lambda n: ["w%d" % r.randrange(10**7) for _ in range(n)]
    parts = [[] for _ in range(16)]
    for a in range(16):
        for b in range(a):
            both = words(12)
            parts[a] += both
            parts[b] += both
    rows = [" ".join(x + words(3000 - len(x))) for x in parts]
    for cut in (2800, 2690):
        body = words(cut)
        rows += [" ".join(body + words(3000 - cut)) for _ in range(2)]
    rows += [" ".join(words(n)) for n in (1, 60, 500)]
    return rows


def test_long_texts_that_meet_by_chance_are_not_compared(spark, monkeypatch):
    rows = long_texts()
    want = {(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a], rows[b]) >= 0.8}
    pairs = asked(monkeypatch)
    got = {(x["u"], x["v"]) for x in simhash.similar(frame(spark, rows)).collect()}
    assert len(want) == 2 and got == want
    assert len(pairs[-1]) <= 2


def test_tables_and_shuffles_go_with_their_step(spark, monkeypatch):
    folder, tables = session_dir(spark).removeprefix("file://"), []
    seen = lambda: tables.append({p.name.partition("-")[0] for p in Path(folder).glob("scratch-*/*")})
    asked(monkeypatch, seen)
    before, scratches = shuffle_files(spark), set(Path(folder).glob("scratch-*"))
    left = {x["doc_id"] for x in simhash.keep_one(frame(spark, long_texts())).select("doc_id").collect()}
    assert left == set(range(23)) - {17, 19}
    assert "sketches" in tables[0] and not tables[1] & {"sketches", "named", "lanes", "cells", "texts", "at", "held", "sized"}
    assert set(Path(folder).glob("scratch-*")) <= scratches
    assert len(shuffle_files(spark) - before) <= 8  # of the last query, which is the caller's


@pytest.mark.parametrize("keys", [40, simhash.KEYS])
def test_turns_change_no_pair(spark, monkeypatch, keys):
    monkeypatch.setattr(simhash, "KEYS", keys)
    monkeypatch.setattr(simhash, "MOVED", 1)
    r = random.Random(6)
    words = lambda n: ["w%d" % r.randrange(10**6) for _ in range(n)]
    base = words(90)
    rows = [" ".join(base[:k] + words(1) + base[k + 1 :]) for k in range(0, 90, 4)] + [" ".join(words(40)) for _ in range(10)]
    want = {(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a], rows[b]) >= 0.8}
    pairs = frame(spark, rows).selectExpr("doc_id AS u").crossJoin(frame(spark, rows).selectExpr("doc_id AS v")).where("u > v")
    assert len(want) > 50
    assert {(x["u"], x["v"]) for x in simhash.compared(pairs, frame(spark, rows), 5, 0.8).collect()} == want
    got = {(x["u"], x["v"]) for x in simhash.similar(frame(spark, rows)).collect()}
    assert got <= want and components_by_hand(len(rows), got) == components_by_hand(len(rows), want)


def test_wide_parities_bound_the_difference_of_sets():
    rng = np.random.default_rng(4)
    for n, more in ((700, 0), (1365, 1), (1366, 300), (2730, 2), (5000, 1250), (5000, 5000), (20000, 4000)):
        values = np.unique(rng.integers(0, 1 << 63, 3 * n + more).astype(np.uint64))
        for own in (0, n // 20, n):
            a, b = values[:n], values[own : own + n + more]
            x, y = simhash._wide(a), simhash._wide(b)
            differ, differs = simhash._differ(x, y), len(np.setxor1d(a, b))
            assert differ <= differs and differ == simhash._differ(y, x) and differ % 2 == differs % 2
            if own == n:  # sets with nothing in common can't pass for similar
                assert differ > 0.2 / 1.8 * (len(a) + len(b))
    assert simhash._wide(values[:682]) is None and len(simhash._wide(values[:683])) == 2 * simhash.WORDS
