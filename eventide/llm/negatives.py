"""Hard negatives of anchors by threshold joins over an inverted index of vectors.

An anchor's positives are its best rows of the same label. Each positive has a window of scores below its own, and the best
rows of other labels within it are the hard negatives. Windows start with a high threshold; those that don't fill with enough
rows are asked for again with a lower one, down to their lower end, so that most rows are ruled out by bounds.

Rows are indexed batch by batch. Dimensions are taken by falling weight; of each row those are left out of the index that can't lift
a pair to the threshold, as the norm of the row's rest times the largest norm of a query's rest is below it. Rows are ordered
by how many dimensions they keep, so that the postings of a dimension are the rows before a place. Scores are accumulated
over blocks of dimensions, and after each block pairs are dropped whose partial score plus the product of the remaining norms
is below the query's threshold. What is left is scored exactly.

Scale: anchors go in blocks of a bounded size (BLOCK numbers), dealt evenly whatever their ids, each sent to the executors; all rows
are read where they lie, in a map for each block and round, and are neither shuffled nor replicated. A task keeps the best few
rows of each window, so what is shuffled is that many rows a window and task, whatever ties or copies there are; no label or vector
is a key. Work grows as anchors times rows, less what the bounds rule out. The driver holds a block of anchors and its windows.

Rows with a null id, label, vector or component, or one that isn't finite, take no part. Rows with an anchor's own id are not
its positives; other repeated rows are rows of their own, and a
repeated anchor (id, label and vector) gives its rows once. Vectors of unequal
length are taken as filled up with zeros, empty ones as zero. Ties of the score go to the smaller id. Scores are whole numbers
of 64 bits; larger ones stop the job. No anchors, or a label without others, give no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, materialize

BLOCK = 1 << 21  # numbers in the vectors of a block of anchors: 16 MB
QUERIES = 1024  # anchors that are scored at a time against a batch of rows
STEP = 8  # dimensions between two rounds of pruning
LOWERED = (1 / 16, 1 / 4, 1)  # how much of a window each round covers, from its upper end
NONE = -(2**63 - 1)
EXACT = float(2**53)


class Index:
    """An inverted index of whole-number vectors for queries of given norms and thresholds."""

    def __init__(self, v: np.ndarray, queries: np.ndarray, least: float):
        self.order = np.argsort(-np.square(v).sum(0), kind="stable")
        v, q = v[:, self.order], queries[:, self.order]
        rest, longest = _rest(v), _rest(q).max(0, initial=0)
        reach = rest * longest * (1 + 1e-9) >= max(least, np.finfo(float).tiny)
        cut = reach.sum(1) if least > 0 else np.full(len(v), v.shape[1])
        self.rows = np.argsort(-cut, kind="stable")
        self.full, self.rest, self.cut = v[self.rows], rest[self.rows], cut[self.rows]
        self.kept = np.where(np.arange(v.shape[1]) < self.cut[:, None], self.full, 0)
        self.postings = [int(np.searchsorted(-self.cut, -d, side="left")) for d in range(v.shape[1])]  # rows with more than d dimensions

    def search(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all pairs whose score is at least the query's threshold."""
        q = queries[:, self.order]
        rest = _rest(q)
        partial, alive = np.zeros((len(q), len(self.full))), None
        for a in range(0, q.shape[1], STEP):
            n = self.postings[a]
            if not n:
                break
            b = min(a + STEP, q.shape[1])
            partial[:, :n] += q[:, a:b] @ self.kept[:n, a:b].T
            at = np.minimum(self.cut, b)  # what is not accumulated yet begins there
            bound = partial + rest[:, at] * self.rest[np.arange(len(at)), at]
            alive = bound + np.abs(bound) * 1e-9 + 1 >= least[:, None]
            if alive.mean() < 0.01:
                break
        if alive is None:  # nothing is indexed
            bound = rest[:, self.cut] * self.rest[np.arange(len(self.cut)), self.cut]
            alive = bound * (1 + 1e-9) + 1 >= least[:, None]
        i, j = np.nonzero(alive)
        large = _rest(q)[:, 0].max(initial=0) * self.rest[:, 0].max(initial=0) >= EXACT
        if large:
            score = np.array([sum(int(x) * int(y) for x, y in zip(q[a], self.full[b])) for a, b in zip(i, j)], np.int64).reshape(-1)
        elif len(i) * 20 > alive.size:
            score = (q @ self.full.T)[i, j].astype(np.int64)
        else:
            score = np.concatenate([np.einsum("nd,nd->n", q[i[s : s + 65536]], self.full[j[s : s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)]).astype(np.int64)
        fits = score >= least[i]
        return i[fits], self.rows[j[fits]], score[fits]


def _rest(v: np.ndarray) -> np.ndarray:
    """(rows, dimensions + 1): the norm of each row from a dimension on."""
    squares = np.square(v)[:, ::-1].cumsum(1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(v), 1))], 1))


class Best:
    """The best k (score, id) of each of n queries, ties by the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.k = np.full((n, k), NONE), np.zeros((n, k), np.int64), k

    def add(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(i):
            return
        order = np.lexsort((ids, -score, i))
        i, score, ids = i[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        few = place < self.k
        names, at = i[first], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(i)]))
        s, x = np.full((len(names), self.k), NONE), np.zeros((len(names), self.k), np.int64)
        s[at[few], place[few]], x[at[few], place[few]] = score[few], ids[few]
        s, x = np.concatenate([self.score[names], s], 1), np.concatenate([self.id[names], x], 1)
        best = np.lexsort((x, -s), axis=1)[:, : self.k]
        self.score[names], self.id[names] = np.take_along_axis(s, best, 1), np.take_along_axis(x, best, 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _scan(rows: DataFrame, block: dict, width: int, windows: list[dict] | None, k: int) -> DataFrame:
    """The best k rows of each anchor of a block, of its own label, or of each of its windows, of other labels: (query, id, score), by task."""
    sent = rows.sparkSession.sparkContext.broadcast((block, windows))
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, wanted = sent.value
        names, labels, v = anchors["id"], anchors["label"], anchors["v"]
        if wanted is None:
            owner, low, high = np.arange(len(names)), np.full(len(names), NONE), np.full(len(names), 2**63 - 1)
        else:
            owner, low, high = (np.array([w[c] for w in wanted], np.int64) for c in ("anchor", "low", "high"))
        best = Best(len(owner), k)
        by = np.argsort(owner, kind="stable")  # windows by anchor
        asked = np.unique(owner)
        for batch in batches:
            ids, kinds, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), width)
            for s in range(0, len(asked), QUERIES):
                own = asked[s : s + QUERIES]
                held = by[np.searchsorted(owner[by], own[0]) : np.searchsorted(owner[by], own[-1], side="right")]
                if wanted is None:  # what is already found is the threshold
                    low[held] = np.maximum(best.score[held, -1], NONE)
                else:
                    low[held] = np.maximum(low[held], best.score[held, -1])
                least = np.full(len(own), np.inf)
                np.minimum.at(least, np.searchsorted(own, owner[held]), low[held].astype(float))
                i, j, score = Index(x, v[own], float(least.min())).search(v[own], least)
                same = labels[own][i] == kinds[j]
                fits = same & (names[own][i] != ids[j]) if wanted is None else ~same
                i, j, score = i[fits], j[fits], score[fits]
                mine = held  # one window of each anchor at a time
                while len(mine):
                    at = np.searchsorted(own, owner[mine])
                    first = np.r_[True, at[1:] != at[:-1]]
                    window = np.full(len(own), -1)
                    window[at[first]] = mine[first]
                    w = window[i]
                    inside = (w >= 0) & (score >= low[w]) & (score <= high[w])
                    best.add(w[inside], score[inside], ids[j[inside]])
                    mine = mine[~first]
        w, place = np.nonzero(best.score > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(best.id[w, place]), pa.array(best.score[w, place])], names=["query", "id", "score"])

    found = rows.select("id", "label", "v").mapInArrow(run, "query long, id long, score long")
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of anchors among rows.

    Both are (id long, label long, v array<double> of whole numbers). A window is from low to high percent of a positive's score.
    """
    spark = rows.sparkSession
    whole = lambda df: df.where("id is not null and label is not null and v is not null").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    width = max(1, whole(rows).agg(F.max(F.size("v"))).first()[0] or 0, whole(anchors).agg(F.max(F.size("v"))).first()[0] or 0)
    filled = lambda df: whole(df).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))).alias("v"))
    rows, anchors = materialize(filled(rows), "vectors"), filled(anchors).distinct()
    blocks = max(1, -(-anchors.count() * width // BLOCK))
    dealt = materialize(anchors.repartition(blocks).withColumn("block", F.spark_partition_id()), "anchors")  # dealt one after another: even blocks
    out, kinds = fresh_path(spark, "negatives"), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kinds).write.parquet(out)
    for n in range(blocks):
        held = dealt.where(F.col("block") == n).drop("block").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        block = {"id": held["id"].to_numpy(), "label": held["label"].to_numpy(), "v": _matrix(held["v"].combine_chunks(), width)}
        open_windows = []
        for r in _scan(rows, block, width, None, positives).collect():  # so many rows an anchor of the block
            a, b = -(-low * r["score"] // 100), high * r["score"] // 100
            if a <= b:
                open_windows.append({"anchor": r["query"], "positive": r["id"], "score": r["score"], "floor": a, "high": b})
        for part in LOWERED:
            if not open_windows:
                break
            for w in open_windows:
                w["low"] = w["floor"] if part == 1 else w["high"] - int((w["high"] - w["floor"]) * part)
            found = materialize(_scan(rows, block, width, open_windows, negatives), "found")
            full = set(range(len(open_windows))) if part == 1 else {r["query"] for r in found.where(F.col("rank") == negatives).select("query").collect()}
            names = pa.table({"query": pa.array(sorted(full), pa.int64()), **{c: pa.array([f(open_windows[q]) for q in sorted(full)], pa.int64()) for c, f in (("anchor_id", lambda w: int(block["id"][w["anchor"]])), ("positive_id", lambda w: w["positive"]), ("positive_score", lambda w: w["score"]))}})
            done = found.join(F.broadcast(spark.createDataFrame(names)), "query")
            done.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
            open_windows = [w for q, w in enumerate(open_windows) if q not in full]
    return spark.read.schema(kinds).parquet(out)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of embeddings whose vec_id is divisible by 50, with labels changed where it is by 7."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").alias("id"), label.alias("label"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")).alias("v"))
    return hard_negatives(rows, rows.where("id % 50 = 0"))


ORACLE = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
neg AS (SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other_id) AS rank
    FROM pos p JOIN pairs n ON n.anchor_id = p.anchor_id WHERE NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3"""
