"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND.

Every training text is cut into passages of ``2 * stride`` words that overlap by half, so that an item of
up to ``stride`` words lies whole in one of them; stride is the length of the longest item, 64 at least.
Each passage is a query. An item's BM25 impacts are divided by their sum, so a score is the share of
the item's weight that the passage has; all items with ``threshold`` or more are retrieved. The index keeps
postings by item with the largest impact of each block of postings, and WAND skips items and blocks that
cannot reach the threshold. Terms so common that no item has more than half of the threshold in them are
non-essential: a passage is searched only if some item may reach the threshold by its other terms and that.

A retrieved pair is then verified: an item's first two thirds count as its question and the rest as its
answer. The passage must have ``overlap`` of the item's five-word shingles and of the answer's words, and the
share of the question's shingles is given too. A changed word spoils five shingles, so short answers are
judged by words. (Items too short for shingles are compared as a whole.)

Document frequencies, mean length and passage width are those of all items, counted on Spark. The index is broadcast in
blocks of items whose text is under BLOCK_BYTES together, one pass over the documents for each, and only postings are
divided: scores and rows don't depend on the blocks. Null and empty texts match nothing; items without a
word are never found; repeated rows and ids each give their rows; other columns of documents pass through
``keep_clean`` and are left aside in ``search``. Empty tables on either side give an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize
from .licenses import TABLE

BLOCK_BYTES = 8 << 20  # of text; an index takes about fifty times that in the driver and in each worker
POSTINGS = 8  # in a block of the index
K1, B = 1.2, 0.75
WIDTH = 5


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in lower case, accents and all."""
    return (text or "").lower().encode().translate(TABLE).split()


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[i:] for i in range(WIDTH)))) if len(words) >= WIDTH else {tuple(words)} - {()}


class Statistics(NamedTuple):
    """Of all items with a word: how many, their words, the longest one's, and the number of items with a term."""

    n: int
    words: int
    longest: int
    spread: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[list[bytes]]) -> Statistics:
        return cls(len(texts), sum(map(len, texts)), max(map(len, texts), default=0), Counter(t for words in texts for t in set(words)))


class Index:
    """Items by term, with normalised BM25 impacts and block maxima; statistics are those of these items if none are given."""

    def __init__(self, items: list[tuple[int, str | None]], statistics: Statistics | None = None):
        self.ids, texts = [], []
        for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            words = words_of(text)
            if words:
                self.ids.append(i)
                texts.append(words)
        n, total, longest, spread = statistics or Statistics.of(texts)
        mean = total / max(n, 1)
        self.vocab = {t: k for k, t in enumerate(sorted({t for words in texts for t in words}))}
        self.stride = max(64, longest)
        postings: list[list[tuple[int, float]]] = [[] for _ in self.vocab]
        self.parts = []
        for d, words in enumerate(texts):
            raw = {t: np.log(1 + (n - spread[t] + 0.5) / (spread[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean)) for t, f in Counter(words).items()}
            total = sum(raw.values())
            for t, x in raw.items():
                postings[self.vocab[t]].append((d, x / total))
            cut = max(1, 2 * len(words) // 3)
            self.parts.append((shingles(words), shingles(words[:cut]), set(words[cut:])))
        self.items = [[d for d, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.blocks = [[max(p[a : a + POSTINGS]) for a in range(0, len(p), POSTINGS)] for p in self.impacts]
        self.most = np.array([max(p) for p in self.impacts] or [0.0])
        self.rare: dict[bytes, int] | None = None

    def split(self, threshold: float) -> None:
        """Divide the terms into common ones and essential ones, whose postings are kept as arrays too."""
        held, self.slack, common = np.zeros(len(self.ids)), 0.0, set()
        for t in sorted(range(len(self.items)), key=lambda t: -len(self.items[t])):
            held[self.items[t]] += self.impacts[t]
            if held.max() > threshold / 2:
                break
            self.slack = held.max()
            common.add(t)
        kept = [(word, t) for word, t in self.vocab.items() if t not in common]
        self.rare = {word: n for n, (word, _) in enumerate(kept)}
        self.first = np.cumsum([0, *(len(self.items[t]) for _, t in kept)])
        self.flat = np.array([d for _, t in kept for d in self.items[t]], np.int64)
        self.weight = np.array([x for _, t in kept for x in self.impacts[t]])

    def hopeful(self, words: list[bytes], threshold: float) -> list[int]:
        """The passages, by their first stride, in which some item may reach threshold."""
        if self.rare is None:
            self.split(threshold)
        terms = np.fromiter(map(self.rare.get, words, repeat(-1)), np.int64, len(words))
        known = np.flatnonzero(terms >= 0)
        if not len(known):
            return []
        pairs = np.unique(known // self.stride * len(self.rare) + terms[known])
        at, term = np.divmod(pairs, len(self.rare))
        sizes = self.first[term + 1] - self.first[term]
        place = np.arange(sizes.sum()) + np.repeat(self.first[term] - np.cumsum(sizes) + sizes, sizes)
        keys, where = np.unique(np.repeat(at, sizes) * len(self.ids) + self.flat[place], return_inverse=True)
        sums = np.bincount(where, self.weight[place])
        after = np.searchsorted(keys, keys + len(self.ids))
        both = sums + np.where(keys[np.minimum(after, len(keys) - 1)] == keys + len(self.ids), sums[np.minimum(after, len(keys) - 1)], 0)
        least = threshold - self.slack - 1e-6
        found = set((keys[both >= least] // len(self.ids)).tolist())
        found |= set((keys[sums >= least] // len(self.ids) - 1).tolist())
        last = max(0, (len(words) - 1) // self.stride - 1)  # a lone last stride lies whole in the passage before
        return sorted({min(max(p, 0), last) for p in found})

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score over these distinct terms reaches threshold."""
        items, impacts, blocks, most = self.items, self.impacts, self.blocks, self.most
        at = [[items[t][0], t, 0] for t in terms]
        out = []
        while at:
            at.sort()
            bound, pivot = 0.0, None
            for n, (d, t, _) in enumerate(at):
                bound += most[t]
                if bound >= threshold:
                    pivot = n
                    break
            if pivot is None:
                break
            item = at[pivot][0]
            while pivot + 1 < len(at) and at[pivot + 1][0] == item:
                pivot += 1
            if at[0][0] == item:
                here = at[: pivot + 1]
                if sum(blocks[t][p // POSTINGS] for _, t, p in here) >= threshold:
                    if (score := sum(impacts[t][p] for _, t, p in here)) >= threshold:
                        out.append((item, score))
                    to = item + 1
                else:
                    # no item up to the end of the first of these blocks, or to the next list, can reach it
                    ends = [items[t][min(len(items[t]), (p // POSTINGS + 1) * POSTINGS) - 1] + 1 for _, t, p in here]
                    to = max(item + 1, min(ends + ([at[pivot + 1][0]] if pivot + 1 < len(at) else [])))
            else:
                here, to = [x for x in at[: pivot + 1] if x[0] < item], item
            for x in here:
                x[2] = bisect_left(items[x[1]], to, x[2])
                x[0] = items[x[1]][x[2]] if x[2] < len(items[x[1]]) else -1
            at = [x for x in at if x[0] >= 0]
        return out

    def matches(self, text: str | None, threshold: float, overlap: float) -> list[tuple[int, float, float, float, float]]:
        """(item id, score, overlap, question overlap, answer overlap) of all verified items of a text."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        best: dict[int, tuple[float, ...]] = {}
        for p in self.hopeful(words, threshold):
            passage = words[p * self.stride : (p + 2) * self.stride]
            terms = sorted({self.vocab[w] for w in passage if w in self.vocab})
            found = self.search(terms, threshold - 1e-9)
            if found:
                grams, there = shingles(passage), set(passage)
                for d, score in found:
                    whole, question, answer = self.parts[d]
                    share = (len(whole & grams) / len(whole), len(question & grams) / max(len(question), 1), len(answer & there) / len(answer) if answer else 1.0)
                    if min(share[0], share[2]) >= overlap and (d not in best or (score, *share) > best[d]):
                        best[d] = (score, *share)
        return [(self.ids[d], *v) for d, v in sorted(best.items())]


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The items' indexes, one per block of at most about BLOCK_BYTES of text, under the statistics of all items."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))

    def terms(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [set(words_of(x.as_py())) for x in batch.column(0)]
        return pa.RecordBatch.from_arrays([pa.array([t for words in found for t in words], pa.binary())], names=["term"])

    def lengths(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([len(words_of(x.as_py())) for x in batch.column(0)], pa.int64())], names=["n"])

    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n, words, longest = map_arrow(rows.select("t"), lengths, "n long").where("n > 0").agg(F.count("n"), F.sum("n"), F.max("n")).first()
    blocks = -(-total // BLOCK_BYTES) or 1
    spread = materialize(map_arrow(rows.select("t"), terms, "term binary").groupBy("term").agg(F.count("*").alias("n")), "spread")
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        counted = spread if blocks == 1 else spread.join(map_arrow(block.select("t"), terms, "term binary").distinct(), "term")
        yield Index([tuple(r) for r in block.collect()], Statistics(n, words or 0, longest or 0, {bytes(r["term"]): r["n"] for r in counted.collect()}))


def search(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap) of each contaminated document and item."""
    sc = docs.sparkSession.sparkContext
    rows, out = docs.select(F.col(id_col).alias("doc_id").cast("long"), F.col(text_col).alias("text")), None
    for index in indexes(items):
        held = sc.broadcast(index)

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            found = [(i, *m) for i, x in zip(batch.column(0).to_pylist(), batch.column(1)) for m in held.value.matches(x.as_py(), threshold, overlap)]
            cols = list(zip(*found)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

        part = map_arrow(rows, run, "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = 0.6, overlap: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that have no verified item."""
    sc, at = docs.sparkSession.sparkContext, docs.columns.index(text_col)
    for index in indexes(items):
        held = sc.broadcast(index)

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            return batch.filter(pa.array([not held.value.matches(x.as_py(), threshold, overlap) for x in batch.column(at)], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
