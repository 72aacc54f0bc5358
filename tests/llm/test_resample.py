"""Importance resampling against plain joins, hashes and sorting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from eventide.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def by_hand(docs, items):
    """Rows (doc_id, n_features, weight, score, rank) in the order of docs."""
    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    s, t = Counter(bucket(f) for _, x in docs for f in runs(x)[1]), Counter(bucket(f) for x in items for f in runs(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in s}
    out = []
    for i, x in docs:
        words, own = runs(x)
        weight = sum(gain[bucket(f)] for f in own)
        h = None if i is None else int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], -r[2], -r[1]))
    for n, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = n + 1
    return [tuple(r[:5]) for r in out]


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables_by_hand(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/{sf}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/{sf}/benchmark.parquet").collect()]
    got = [tuple(r) for r in resample.op11_importance(spark, f"{DATA}/{sf}").collect()]
    assert plain(got) == plain(by_hand(docs, items))
    assert sum(r[4] is not None for r in got) > 0


def test_ties_nulls_repeats_and_other_columns(spark):
    text = "One two three four five. " * 6
    docs = [(n % 37, text if n % 3 else text + "x" * n) for n in range(100)] + [(None, text), (None, None), (5, None), (6, ""), (7, "only three words"), (5, "é" * 3000 + " 中文 é A1b2 " * 30)]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, rank int, score int, key int").repartition(5)
    target = spark.createDataFrame([("two three four", 1), (None, 2)], "text string, bucket int")
    got = resample.rank(resample.weigh(frame, target))
    assert plain(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain(by_hand(docs, ["two three four", None]))
    kept = resample.sample(frame, target)
    assert kept.columns == frame.columns and kept.count() > 0


def test_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.rank(resample.weigh(none, one)).count() == 0
    assert [r["weight"] for r in resample.weigh(one, none).collect()] == [by_hand([(1, "a b c")], [])[0][2]]


def test_a_text_longer_than_blocks(monkeypatch):
    """Runs across the blocks of a text are those of the whole text."""
    text = "aé b1 " + "word" * 60 + " cc ddd x " * 40
    want = Counter(zlib.crc32(f.encode()) % 10000 for f in runs(text)[1])
    for block in (1, 7, 64, 500):
        monkeypatch.setattr(resample, "BLOCK", block)
        got = Counter(int(b) for _, _, found in resample.features([text], 10000) for b in found)
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=200)), max_size=6))
def test_any_texts(texts):
    got = Counter((int(r), int(b)) for rows, _, found in resample.features(texts, 10000) for r, b in zip(rows, found))
    want = Counter((n, zlib.crc32(f.encode("utf-8", "surrogatepass")) % 10000) for n, t in enumerate(texts) for f in runs(t)[1])
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40), st.binary(min_size=1, max_size=400))
def test_composed_checksums(a, b):
    crc = resample.move(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)]))
    assert int(crc[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)
