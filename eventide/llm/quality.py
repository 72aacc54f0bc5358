"""Quality rules by weak supervision: rules vote or abstain, and their accuracies are estimated.

Each rule votes good (1), bad (2) or abstains (0) on a document. Documents are counted by their pattern of
votes, so the number of groups is bounded by 3 ** rules however many documents there are; on those counts
expectation-maximisation estimates each rule's votes within good and bad documents and the share of good
ones. A document is kept if the posterior probability that it is good is at least ``keep_at``: at 0.05 it goes only if
the rules speak against it by 19 to 1, as a good document lost counts for more than a bad one kept. Posteriors of most
documents are near 0 or 1 (tests hold them against labels), so the bound moves few.

Counts over all documents; nothing is sampled. Null texts are empty ones, with no words; rows with one id
and repeated rows each count and are each given a result; other columns pass through where rows are
filtered and are left aside otherwise. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

WHITE = bytes([9, 10, 11, 12, 13, 32])
TRAIL = bytes(range(0x80, 0xC0))  # bytes that begin no code point
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(0xC0, 0x100))  # a code point outside ASCII counts as a letter
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_distinct", "n_exclaim")

#: (name, amount, of what, good below, bad above); swapped bounds: good above, bad below. Between them the rule abstains.
RULES = (
    ("symbols", "n_symbols", "n_words", 0.05, 0.25),
    ("letters", "n_letters", "word_chars", 0.93, 0.70),
    ("repeats", "n_repeat_words", "n_words", 0.10, 0.30),
    ("duplicate lines", "n_dup_lines", "n_lines", 0.20, 0.50),
    ("capitals", "n_upper", "word_chars", 0.10, 0.30),
    ("distinct words", "n_distinct", "n_words", 0.45, 0.12),
    ("long words", "word_chars", "n_words", 7.0, 10.0),
    ("short words", "word_chars", "n_words", 3.8, 3.2),
    ("exclamations", "n_exclaim", "n_words", 0.05, 0.30),
)


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside three-word windows that occur twice or more, and distinct words."""
    n, first = len(words), {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
    if n < 4:
        return 0, len(first)
    pairs = ids[:-2] * n + ids[1:-1]
    if n >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, window, times = np.unique(pairs * n + ids[2:], return_inverse=True, return_counts=True)
    twice = times[window] > 1
    inside = np.zeros(n, bool)
    for at in range(3):
        inside[at : n - 2 + at] |= twice
    return int(inside.sum()), len(first)


def features(data: bytes) -> tuple[int, ...]:
    """FEATURES of a UTF-8 text."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats, distinct = repeated_words(words)
    without = lambda some: len(data.translate(None, some))
    size = len(data)
    return (len(words), without(TRAIL + WHITE), size - without(SYMBOLS), len(lines) - len(set(lines)), repeats, len(lines), size - without(UPPER), size - without(LETTERS), distinct, data.count(b"!"))


def votes(row: tuple[int, ...]) -> int:
    """The votes of all rules on a document, as digits of a base-3 number."""
    at, pattern = dict(zip(FEATURES, row)), 0
    for _, amount, of, good, bad in RULES:
        share = at[amount] / max(at[of], 1)
        vote = (1 if share < good else 2 if share > bad else 0) if good < bad else (1 if share > good else 2 if share < bad else 0)
        pattern = 3 * pattern + vote
    return pattern


def failed(row: tuple[int, ...]) -> bool:
    """The base rules: under 50 words, or over half of them in repeated windows."""
    return row[0] < 50 or 100 * row[4] > 50 * row[0]


def _digest(batch: pa.RecordBatch) -> list[tuple[int, ...]]:
    return [features(x.as_py() or b"") for x in batch.column(batch.num_columns - 1).cast(pa.binary())]


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, FEATURES, pattern, base_failed)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = _digest(batch)
        cols = list(zip(*rows)) or [()] * len(FEATURES)
        arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in cols), pa.array(list(map(votes, rows)), pa.int32()), pa.array(list(map(failed, rows)), pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", *FEATURES, "pattern", "base_failed"])

    schema = ", ".join(f"{x} long" for x in ("doc_id", *FEATURES)) + ", pattern int, base_failed boolean"
    return map_arrow(docs.select(F.col(id_col).alias("doc_id").cast("long"), F.col(text_col).alias("text")), run, schema)


def fit(patterns: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """The posterior probability of good for each vote pattern, from how many documents have it."""
    keys = np.array(sorted(patterns), np.int64)
    weight = np.array([patterns[k] for k in keys.tolist()], float)
    n = len(RULES)
    vote = (keys[:, None] // 3 ** np.arange(n - 1, -1, -1)) % 3
    hot = np.eye(3)[vote]
    good, bad = (vote == 1).sum(1), (vote == 2).sum(1)
    p = (1 + good) / (2 + good + 4 * bad)  # rules say good far more often than bad, so a vote of bad counts for more
    for _ in range(rounds):
        old = p
        counts = np.stack([np.einsum("k,krv->rv", weight * q, hot) for q in (p, 1 - p)])
        prior = np.array([(weight * p).sum(), (weight * (1 - p)).sum()]) + 1
        rates = (counts + 0.5) / (counts + 0.5).sum(2, keepdims=True)
        log = np.log(prior / prior.sum())[:, None] + np.einsum("krv,crv->ck", hot, np.log(rates))
        p = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        if np.abs(p - old).max() < 1e-9:
            break
    return dict(zip(keys.tolist(), p.tolist()))


def posteriors(featured: DataFrame) -> dict[int, float]:
    """fit() over all documents; only the counts of vote patterns reach the driver."""
    return fit({r["pattern"]: r["n"] for r in featured.groupBy("pattern").agg(F.count("*").alias("n")).collect()} or {0: 1})


def score(docs: DataFrame, keep_at: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, FEATURES, base_failed, quality, kept) for each row of docs; quality is the posterior."""
    featured = materialize(document_features(docs, id_col, text_col), "quality")
    by = docs.sparkSession.createDataFrame(sorted(posteriors(featured).items()), "pattern int, quality double")
    # at most 3 ** len(RULES) rows
    return featured.join(F.broadcast(by), "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at)).drop("pattern")


def keep_good(docs: DataFrame, keep_at: float = 0.05, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass the base rules and have a posterior of keep_at or more, with all their columns.

    Texts are read twice, to count patterns and to filter, in place of writing all of them once more.
    """
    by = posteriors(document_features(docs.select(F.lit(0).alias("doc_id"), text_col), "doc_id", text_col))
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(x.as_py() or b"") for x in batch.column(at).cast(pa.binary())]
        return batch.filter(pa.array([not failed(r) and by[votes(r)] >= keep_at for r in rows], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op7_quality(spark, sf_dir: str) -> DataFrame:
    scored = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
