"""Importance resampling of documents towards a target text, by hashed runs of words.

A document's features are its runs of one to three consecutive words; a feature's bucket is the CRC-32 of its words joined
by one space, modulo a number of buckets. A bucket's gain says how much more frequent it is in the target than in the
documents, and a document's weight is the sum of gains over its features. The documents to draw are those with the highest
weight plus Gumbel noise, which is a draw without replacement in proportion to exp(weight).

No run of words is ever joined and hashed. Texts go block by block through an Aho-Corasick automaton over the block's
distinct words, each between delimiters, which emits for each word its CRC and length. CRC-32 is linear: the CRC of two
adjacent pieces is that of the first one, moved on by the second one's length, xor that of the second. So the payloads
of two and three neighbours give the buckets of their runs by table look-ups over whole arrays.

Scale: both passes over the documents are maps without a shuffle of texts. The first gives one row a bucket and task at most,
so counts are pre-aggregated and no key is hot; what reaches the driver is a number for each bucket, whatever the corpus. The second gives
one narrow row a document. Ranking deals those by ranges of the score and numbers them within each range, so no task orders
all. Blocks bound memory whatever the length of a text: a text longer than a block goes on with its last two words.

Null and empty texts have no words, features or weight (0). Rows with one id and text are alike and each keep a rank of
their own; rows without an id have no random number, so no score and no rank, and don't count towards the size of the draw. Ties of the score go
to the smaller id. Without a target text, or without documents, counts are 0 and the formula holds. Other columns, whatever
their names, are left where they are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow, materialize

BUCKETS = 10_000
BLOCK = 1 << 20  # bytes of text that go through one automaton
SHORT = 64  # pieces up to this length are moved by one table for each length
#: A-Z become a-z; bytes of words stay, all others are delimiters.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _moved(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """crc moved on by the length that a table (4, 256) stands for."""
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


@lru_cache(1)
def _short_tables() -> np.ndarray:
    """(SHORT + 1, 4, 256): the CRC of each value of each byte, moved on by so many zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    tables = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(SHORT):
        tables.append(tables[-1] >> 8 ^ step[tables[-1] & 255])
    return np.stack(tables)


@lru_cache(4096)
def _long_table(length: int) -> np.ndarray:
    """The table of any length, from those of its halves."""
    if length <= SHORT:
        return _short_tables()[length]
    half = _long_table(length // 2)
    table = _moved(half, half)
    return _moved(_short_tables()[1], table) if length % 2 else table


def move(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each crc moved on by so many bytes: xor the crc of those bytes, it is that of both pieces together."""
    flat, at = _short_tables().reshape(-1), np.minimum(lengths, SHORT) * 1024
    out = flat[at + (crc & 255)] ^ flat[at + 256 + (crc >> 8 & 255)] ^ flat[at + 512 + (crc >> 16 & 255)] ^ flat[at + 768 + (crc >> 24)]
    for n in np.unique(lengths[lengths > SHORT]):
        rows = lengths == n
        out[rows] = _moved(_long_table(int(n)), crc[rows])
    return out


def _blocks(texts: Iterable[str | None]) -> Iterator[list[tuple[int, list[bytes], int]]]:
    """Pieces (row, words, how many of them belong to the piece before) of about BLOCK bytes at a time."""
    held, size = [], 0
    for row, text in enumerate(texts):
        data, at, tail = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES), 0, []
        while at < len(data):
            end = at + BLOCK if at + BLOCK < len(data) else len(data)
            end = end if end == len(data) else data.find(b" ", end) if data.find(b" ", end) >= 0 else len(data)
            words = tail + data[at:end].split()
            held.append((row, words, len(tail)))
            size, at, tail = size + end - at, end, words[-2:]
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def emitted(pieces: list[tuple[int, list[bytes], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the pieces in turn: its CRC, the CRC of a space and it, and the length of those, as an automaton emits them."""
    words = list(dict.fromkeys(w for _, own, _ in pieces for w in own))
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    found = ahocorasick.Automaton()
    for n, w in enumerate(words):
        found.add_word(f" {w.decode('latin-1')} ", n)  # a character for each byte
    found.make_automaton()
    text = f" {b' '.join(w for _, own, _ in pieces for w in own).decode('latin-1')} "
    ids = np.fromiter((n for _, n in found.iter(text)), np.int64)
    alone = np.array([zlib.crc32(w) for w in words], np.uint32)
    after = np.array([zlib.crc32(w, 0xE96CCF45) for w in words], np.uint32)  # 0xE96CCF45: the CRC-32 of one space
    return alone[ids], after[ids], np.array([len(w) + 1 for w in words], np.int64)[ids]


def features(texts: Iterable[str | None], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, length of the run in words, bucket) of every feature, a block at a time; whole texts, in order of their ends."""
    for pieces in _blocks(texts):
        alone, after, length = emitted(pieces)
        sizes = np.array([len(w) for _, w, _ in pieces])
        rows = np.repeat([r for r, _, _ in pieces], sizes)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        own = place >= np.repeat([t for _, _, t in pieces], sizes)
        crc = alone
        for run in range(3):
            if run:
                crc = np.concatenate([crc[:1], move(crc[:-1], length[1:]) ^ after[1:]])
            fits = own & (place >= run)
            yield rows[fits], np.full(int(fits.sum()), run + 1), (crc[fits] % np.uint32(buckets)).astype(np.int64)


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of all texts are in each bucket that has any."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(batch.column(0).to_pylist(), buckets):
                counts += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    return df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the logarithm of how much more frequent each bucket is in the target, from two tables of counts."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, frame in ((s, source), (t, target)):
        for r in frame.collect():  # a row a bucket
            counts[r["bucket"]] = r["n"]
    total_s, total_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * total_s / ((a + 1.0) * total_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weigh(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """(key, n_words, n_features, weight, score) of each row of docs."""
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets), buckets)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        words, all_runs, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for rows, run, found in features(batch.column(1).to_pylist(), buckets):
            count = np.bincount(rows, minlength=n)
            all_runs += count
            words += count if len(run) and run[0] == 1 else 0
            weight += np.bincount(rows, gain[found], n).astype(np.int64)  # sums of whole numbers far below 2 ** 53
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, all_runs, weight))], names=["key", "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    out = map_arrow(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), score, f"key {kind}, n_words long, n_features long, weight long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))
    return out.withColumn("score", F.col("weight") + noise).withColumnRenamed("key", key)


def rank(scored: DataFrame, percent: int = 5, least_words: int = 20, key: str = "doc_id") -> DataFrame:
    """scored with rank: 1, 2, 3 ... for the rows drawn, those of the highest scores among texts of enough words, else null.

    Rows are dealt by ranges of (score, key), numbered within ranges, and moved on by the sizes of the ranges before.
    """
    scored = materialize(scored, "scored")
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    order = [F.desc("score"), F.asc(key), F.desc("weight"), F.desc("n_features")]
    ranged = materialize(scored.where(fit).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    drawn = scored.where(fit).count() * percent // 100
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)).cast("long")
    placed = ranged.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_before") + within).drop("_range", "_before")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.where(~F.coalesce(fit, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def sample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, key: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = 42) -> DataFrame:
    """The documents drawn, all columns, by a key that tells documents apart."""
    drawn = rank(weigh(docs, target, key, text, target_text, seed=seed), percent, least_words, key).where("rank is not null")
    return docs.join(drawn.select(key).distinct(), key, "left_semi")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw 5 % of documents towards the benchmark: doc_id, n_features, weight, score and rank of each."""
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rank(weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")
