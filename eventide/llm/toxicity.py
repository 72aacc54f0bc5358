"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling, over characters and words.

A word's input is its own embedding, if it is frequent enough in the training sample, beside what a bidirectional recurrent layer
over its characters gives, pooled by attention; so unseen forms of a word, in any language, still have an input. A second
bidirectional layer reads windows of words and is pooled by attention into one logit. Windows overlap by half and cover the whole
text, however long; a document's score is that of its highest window. The network is trained in numpy, by gradients written out here.

Only documents have labels, not windows. So the first rounds of training take windows of a document at random, and the others
those that the network finds highest: the one that makes a toxic document toxic, and those that a clean one is nearest to it.
In the last rounds toxic labels whose document has no window above DOUBT are taken for mistakes.

Scale: training reads a bounded sample of labelled rows (SAMPLE of either label, the first by hash, and WINDOWS windows of
each), whatever the corpus. Scoring is one map over all documents without a shuffle; the network, under 2 MB, goes with the task. A
task holds windows of a batch and a bounded table of words it has met, whose inputs are computed once; texts of any
length go through in pieces of bounded size.

Null, empty and wordless texts score 0. Repeated rows score alike. Rows without a label, and labels that aren't 0 or 1, don't
train; of several labels of one document the larger counts. Without labelled rows of both kinds all scores are 0. Nothing but the text is an
input. Other columns are not looked at. Runs of letters and digits longer than PIECE characters are read as several words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow

SAMPLE = {1: 2000, 0: 3000}  # labelled rows to learn from, by label
WINDOWS = 8  # windows of a labelled row
LENGTH = 48  # words in a window; neighbours overlap by half
PIECE = 16
WORDS = re.compile(rf"[^\W_]{{1,{PIECE}}}")
CHARACTERS = 509  # code points share embeddings modulo this prime
VOCABULARY = 20_000
WIDTH = 8  # of embeddings and of states in either direction
HELD = 200_000  # words whose inputs a task keeps
AT_ONCE = 2048  # windows scored together
DOUBT = -2.0  # logit


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def window_starts(n: int) -> list[int]:
    """Starts of overlapping windows that cover n words; the last one ends with the text."""
    if n <= LENGTH:
        return [0] if n else []
    return [*range(0, n - LENGTH, LENGTH // 2), n - LENGTH]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _gate(x: np.ndarray) -> np.ndarray:
    """The same, in place; of very low values exp is infinite and the gate 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _steps(projected, u: np.ndarray, times, counts: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (times, n, width) of a gated layer; projected(t, m) is the input of the first m rows at t, already multiplied.

    Rows are ordered by falling size: at t the first counts[t] are there, the others' states are left at zero.
    """
    k = WIDTH
    h = np.zeros((int(counts.max(initial=0)), k), np.float32)
    out = np.zeros((len(times), len(h), k), np.float32)
    with np.errstate(over="ignore"):
        for t in times:
            m = int(counts[t])
            own, old = projected(t, m), h[:m]
            back = old @ u
            gates = _gate(own[:, : 2 * k] + back[:, : 2 * k])
            r, z = gates[:, :k], gates[:, k:]
            c = r * back[:, 2 * k :]
            c += own[:, 2 * k :]
            c *= 2
            c = _gate(c)
            c *= 2
            c -= 1
            if keep is not None:
                keep.append((t, old.copy(), r, z, c, back[:, 2 * k :]))
            new = np.subtract(old, c, out=out[t, :m])
            new *= z
            new += c
            h[:m] = new
    return out


class Network:
    """Parameters by name, their gradients, and scoring. c: over characters, w: over words; f and b: forward and backward."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        g, k = np.random.default_rng(seed), WIDTH
        self.vocabulary = vocabulary
        make = lambda *shape: (g.normal(size=shape) * shape[0] ** -0.5).astype(np.float32)
        self.p = {"chars": make(CHARACTERS, k) * 10, "words": make(len(vocabulary) + 1, k) * 0, "v_c": make(2 * k), "v_w": make(2 * k), "out": make(2 * k), "bias": np.zeros(1, np.float32)}
        for layer, size in (("c", k), ("w", 3 * k)):
            for way in "fb":
                self.p |= {f"W_{layer}{way}": make(size, 3 * k), f"U_{layer}{way}": make(k, 3 * k), f"b_{layer}{way}": np.zeros(3 * k, np.float32)}

    def layer(self, name: str, x: np.ndarray, counts: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Both directions over x (times, n, size), side by side."""
        out = []
        for way in "fb":
            own = x @ self.p[f"W_{name}{way}"] + self.p[f"b_{name}{way}"]
            held = None if keep is None else keep.setdefault(name + way, [])
            times = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
            out.append(_steps(lambda t, m, own=own: own[t, :m], self.p[f"U_{name}{way}"], times, counts, held))
        return np.concatenate(out, 2)

    def layer_back(self, name: str, x: np.ndarray, keep: dict, d: np.ndarray, grads: dict) -> np.ndarray:
        """Gradient of x from that of the layer's states."""
        k, dx = WIDTH, np.zeros_like(x)
        for way, part in (("f", d[:, :, :k]), ("b", d[:, :, k:])):
            u, carried = self.p[f"U_{name}{way}"], np.zeros(x.shape[1:2] + (k,), np.float32)
            du, dp = np.zeros_like(u), np.zeros(x.shape[:2] + (3 * k,), np.float32)
            for t, h, r, z, c, back in reversed(keep[name + way]):
                m = len(h)
                dn = part[t, :m] + carried[:m]
                dc = dn * (1 - z) * (1 - c * c)
                dr, dz = dc * back * r * (1 - r), dn * (h - c) * z * (1 - z)
                dp[t, :m] = np.concatenate([dr, dz, dc], 1)
                through = np.concatenate([dr, dz, dc * r], 1)
                du += h.T @ through
                carried[:m] = dn * z + through @ u.T
            flat = dp.reshape(-1, 3 * k)
            grads[f"U_{name}{way}"], grads[f"W_{name}{way}"], grads[f"b_{name}{way}"] = du, x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
            dx += dp @ self.p[f"W_{name}{way}"].T
        return dx

    def pool(self, states: np.ndarray, v: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States (times, n, size) weighted by attention, and the weights; mask (times, n) says what is there."""
        e = np.where(mask, states @ v, -1e9)
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        return np.einsum("tn,tns->ns", a, states), a

    @staticmethod
    def pool_back(states: np.ndarray, v: np.ndarray, a: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        da = np.einsum("tns,ns->tn", states, d)
        de = a * (da - (a * da).sum(0))
        return a[:, :, None] * d + de[:, :, None] * v, np.einsum("tn,tns->s", de, states)

    def spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Character numbers (times, n) of words ordered by falling length, and which of them are there."""
        ids = np.zeros((PIECE, len(words)), np.int64)
        sizes = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32) % CHARACTERS
        rows = np.repeat(np.arange(len(words)), sizes)
        ids[np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes), rows] = codes
        longest = int(sizes.max(initial=1))
        return ids[:longest], np.arange(longest)[:, None] < sizes

    def gradients(self, words: list[str], at: np.ndarray, mask: np.ndarray, y: np.ndarray, known: np.ndarray) -> tuple[dict, float]:
        """Of the mean loss of windows: at (times, n) are places in words, known their numbers in the vocabulary. Words and windows fall in length."""
        k, grads, keep = WIDTH, {}, {}
        ids, there = self.spelled(words)
        x_c = self.p["chars"][ids]
        s_c = self.layer("c", x_c, there.sum(1), keep)
        pooled_c, a_c = self.pool(s_c, self.p["v_c"], there)
        x_w = np.concatenate([self.p["words"][known], pooled_c[at]], 2)
        s_w = self.layer("w", x_w, mask.sum(1), keep)
        pooled_w, a_w = self.pool(s_w, self.p["v_w"], mask)
        p = _sigmoid(pooled_w @ self.p["out"] + self.p["bias"])
        d = ((p - y) / len(y)).astype(np.float32)
        grads["out"], grads["bias"] = pooled_w.T @ d, d.sum(keepdims=True)
        ds, grads["v_w"] = self.pool_back(s_w, self.p["v_w"], a_w, d[:, None] * self.p["out"])
        dx = self.layer_back("w", x_w, keep, ds, grads)
        flat, places = dx.reshape(-1, 3 * k), at.reshape(-1)
        total = lambda rows, d, n: np.stack([np.bincount(rows, c, n) for c in d.T], 1).astype(np.float32)
        grads["words"] = total(known.reshape(-1), flat[:, :k], len(self.p["words"]))
        grads["words"][0] = 0
        dc, grads["v_c"] = self.pool_back(s_c, self.p["v_c"], a_c, total(places, flat[:, k:], len(words)))
        dx = self.layer_back("c", x_c, keep, dc, grads)
        grads["chars"] = total(ids.reshape(-1), dx.reshape(-1, k), CHARACTERS)
        return grads, float(-np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))

    # ---- scoring

    def inputs(self, words: list[str]) -> np.ndarray:
        """What each word gives both directions of the second layer, already multiplied: (n, 6 * WIDTH)."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        out = np.zeros((len(words), 6 * WIDTH), np.float32)
        for s in range(0, len(words), 4096):
            own = order[s : s + 4096]
            part = [words[i] for i in own]
            ids, there = self.spelled(part)
            pooled, _ = self.pool(self.layer("c", self.p["chars"][ids], there.sum(1)), self.p["v_c"], there)
            x = np.concatenate([self.p["words"][[self.vocabulary.get(w, 0) for w in part]], pooled], 1)
            out[own] = np.concatenate([x @ self.p[f"W_w{way}"] + self.p[f"b_w{way}"] for way in "fb"], 1)
        return out

    def logits(self, table: np.ndarray, at: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Of windows (times, n) of rows of a table of inputs, ordered by falling size; without sizes all are full."""
        k, times = WIDTH, range(len(at))
        there = None if sizes is None else np.arange(len(at))[:, None] < sizes
        counts = np.full(len(at), at.shape[1]) if there is None else there.sum(1)
        states = [_steps(lambda t, m, c=c: table[at[t, :m], c : c + 3 * k], self.p[f"U_w{way}"], times if c == 0 else times[::-1], counts) for way, c in (("f", 0), ("b", 3 * k))]
        e = sum(s @ v for s, v in zip(states, (self.p["v_w"][:k], self.p["v_w"][k:])))
        e = e if there is None else np.where(there, e, -1e9)
        a = np.exp(e - e.max(0))
        out = sum((s @ o) for s, o in zip(states, (self.p["out"][:k], self.p["out"][k:])))
        return (a * out).sum(0) / a.sum(0) + self.p["bias"][0]


class Scorer:
    """Scores of texts, with the inputs of words met so far."""

    def __init__(self, network: Network):
        self.network, self.place, self.table = network, {}, np.zeros((0, 6 * WIDTH), np.float32)

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self.place) > HELD:
            self.place, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        if new:
            self.table = np.concatenate([self.table, self.network.inputs(new)])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
        place = self.place
        return np.array([place[w] for w in words], np.int64)

    def windows(self, pieces: list[list[str]]) -> np.ndarray:
        """The highest logit of each piece, -inf without words."""
        out = np.full(len(pieces), -np.inf)
        ids = self.look_up([w for p in pieces for w in p])
        ends = np.cumsum([len(p) for p in pieces])
        full, short = ([], []), []
        for n, (p, end) in enumerate(zip(pieces, ends)):
            if len(p) < LENGTH:
                short += [n] if p else []
            else:
                starts = window_starts(len(p))
                full[0].extend(end - len(p) + s for s in starts)
                full[1].extend([n] * len(starts))
        for s in range(0, len(full[0]), AT_ONCE):
            at = np.array(full[0][s : s + AT_ONCE]) + np.arange(LENGTH)[:, None]
            np.maximum.at(out, full[1][s : s + AT_ONCE], self.network.logits(self.table, ids[at]))
        short.sort(key=lambda n: -len(pieces[n]))
        for s in range(0, len(short), AT_ONCE):
            own = np.array(short[s : s + AT_ONCE])
            sizes = np.array([len(pieces[n]) for n in own])
            places = np.minimum(np.arange(sizes.max())[:, None], sizes - 1)
            out[own] = self.network.logits(self.table, ids[ends[own] - sizes + places], sizes)
        return out

    def scores(self, texts: list[str | None], block: int = 1 << 18) -> np.ndarray:
        """The score of each text, some blocks of words at a time; blocks of one text overlap by half a window."""
        out, held, owners, size = np.full(len(texts), -np.inf), [], [], 0

        def done() -> None:
            if held:
                np.maximum.at(out, owners, self.windows(held))

        for n, text in enumerate(texts):
            words, at = words_of(text), 0
            while at < len(words):
                part = words[at : at + block]
                held.append(part)
                owners.append(n)
                size += len(part)
                at = at + block - LENGTH // 2 if at + block < len(words) else len(words)
                if size >= block:
                    done()
                    held, owners, size = [], [], 0
        done()
        return np.round(np.where(np.isinf(out), 0, _sigmoid(out)), 6)


def fit(rows: list[tuple[int, list[str]]], owners: list[int], rounds: int = 10, first: int = 3, steps: int = 30, rate: float = 0.01, seed: int = 7) -> Network | None:
    """A network from windows (label, words) of documents; owners says whose each is. None without both labels.

    Each round takes a window of every document in about that many steps, in smaller ones if there are few.
    """
    labels = np.array([y for y, _ in rows])
    if not len(rows) or labels.min() == labels.max():
        return None
    g = np.random.default_rng(seed)
    met = Counter(w for d, w in {(o, w) for o, (_, words) in zip(owners, rows) for w in words})
    frequent = [w for w, n in sorted(met.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n >= 3]
    net = Network({w: n + 1 for n, w in enumerate(frequent)}, seed)
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    _, owner = np.unique(owners, return_inverse=True)
    done = 0
    for turn in range(rounds):
        worth = g.random(len(rows)) if turn < first else Scorer(net).windows([w for _, w in rows])
        order = np.lexsort((-worth, owner))
        chosen = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]  # of each document one
        rest = np.setdiff1d(np.flatnonzero(labels == 0), chosen)
        extra = rest[np.argsort(-worth[rest], kind="stable")][: len(chosen) // 4]  # and those of clean ones that are highest, or any
        if turn >= 2 * first:  # labels that the network can't see a reason for by now are taken for wrong ones
            chosen = chosen[(labels[chosen] == 0) | (worth[chosen] > DOUBT)]
        chosen = g.permutation(np.concatenate([chosen, extra]))
        toxic, clean = chosen[labels[chosen] == 1], chosen[labels[chosen] == 0]
        n = min(steps, max(1, len(toxic) // 2))
        for s in range(n):  # both labels have a say in every step
            own = sorted([*toxic[s::n], *clean[s::n]], key=lambda i: -len(rows[i][1]))
            pieces = [rows[i][1] for i in own]
            words = sorted(dict.fromkeys(w for p in pieces for w in p), key=lambda w: -len(w))
            place = {w: i for i, w in enumerate(words)}
            at, mask = np.zeros((len(pieces[0]), len(own)), np.int64), np.zeros((len(pieces[0]), len(own)), bool)
            for i, p in enumerate(pieces):
                at[: len(p), i], mask[: len(p), i] = [place[w] for w in p], True
            known = np.array([net.vocabulary.get(w, 0) for w in words])[at]
            known[g.random(known.shape) < 0.3] = 0  # so that spelling counts too
            grads, _ = net.gradients(words, at, mask, labels[own], known)
            done += 1
            pace = rate * min(1, 2 * (1 - turn / rounds))
            for k, d in grads.items():
                d = d + 1e-5 * net.p[k]
                mean[k] += 0.1 * (d - mean[k])
                square[k] += 0.001 * (d * d - square[k])
                net.p[k] -= (pace * (mean[k] / (1 - 0.9**done)) / (np.sqrt(square[k] / (1 - 0.999**done)) + 1e-8)).astype(np.float32)
    return net


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training, by its key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_windows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(label, key, words) of up to WINDOWS windows of up to SAMPLE rows of each label that are not held out."""
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)").where(~held_out("key"))
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    few = [known.where(F.col("label") == y).orderBy(F.xxhash64("key"), "key").limit(n) for y, n in SAMPLE.items()]
    # as many rows as SAMPLE says, so they can be broadcast
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(few[0].unionByName(few[1])), "key")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k, t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = words_of(t)
            starts = window_starts(len(words))
            for s in starts if len(starts) <= WINDOWS else [starts[i * len(starts) // WINDOWS] for i in range(WINDOWS)]:
                out.append((y, k, " ".join(words[s : s + LENGTH])))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int32(), batch.schema.field(0).type, pa.string()))], names=["label", "key", "words"])

    return map_arrow(rows.select("key", "text", "label"), cut, f"label int, key {rows.schema['key'].dataType.simpleString()}, words string")


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", seed: int = 7) -> Network | None:
    """A network from the labelled rows that are not held out."""
    rows = sorted((r["key"], r["words"], r["label"]) for r in training_windows(docs, labels, key, text, label).collect())
    return fit([(y, w.split()) for _, w, y in rows], [k for k, _, _ in rows], seed=seed)


def score(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network) if network else None
        for batch in batches:
            found = scorer.scores(batch.column(1).to_pylist()) if scorer else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["key", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double, predicted int")
    return out.withColumnRenamed("key", key)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of those that are not held out: doc_id, held_out, score, predicted."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
