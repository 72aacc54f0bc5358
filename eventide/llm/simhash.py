"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A text's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Two fingerprints
within ``radius`` bits have segment bit counts within ``radius`` in Manhattan distance, so a range join in
the space of segment counts finds every pair: the 32 counts of two bits each form five groups, a
distance of 2 touches at most two groups, and so the grid cells made of three groups' counts hold each
pair together at least once. Pairs in a cell are held against the Manhattan bound and then compared
exactly. Cells are made of distinct fingerprints, copies being one point.

A cell beyond ``cell_limit`` points is divided by the same embedding with segments of one bit, where the Manhattan
distance is the distance itself: its range join of radius two meets at the grid points within one of each, and
no more than 65 fingerprints can share such a point. So work stays linear whatever the cell holds.

Null, empty or blank texts have fingerprint zero and are linked like any other. Rows with equal ids are
kept, each with its fingerprint. Other columns are left aside. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import around, bounded_batches, connected, few_ids, map_arrow, materialize, scratch

SEED = 42
GROUPS = ((0, 7), (7, 14), (14, 20), (20, 26), (26, 32))  # of the 32 two-bit segments
CHUNK = 1 << 16
SAMPLE_TEXTS = 1 << 14  # about so many texts are counted for the order of shingles
COMMON = 1 << 15  # so many of their most common shingles come last in it
SHARE = 1024  # texts held against one text in a task
WORDS = 8  # 64-bit words in the parities of a shingle set; long texts have more besides
KEYS = 1 << 24  # about so many shingles of prefixes meet at once, or more if that takes over PIECES turns
PIECES = 8
MOVED = 1 << 30  # so many bytes of texts are compared at once, or as many as the texts have themselves


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """The XXH64 values of the shingles of a text with a word, repeats included."""
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, max(1, len(words) - width + 1))


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the values."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(bits) // 255 * 255
        if full:
            counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    words = (data or b"").lower().split()
    return _majority(_hashes(words, width)) if words else 0


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary())
        fps = np.array([fingerprint(x.as_py(), width) for x in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id").cast("long"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def _cells(fp: Column) -> Column:
    """The keys of the ten grid cells of a fingerprint."""
    count = lambda i: F.bit_count(F.shiftrightunsigned(fp, 2 * i).bitwiseAND(F.lit(3)))
    group = [sum((count(i) * F.lit(3 ** (i - a)) for i in range(a, b)), F.lit(0)).cast("long") for a, b in GROUPS]
    keys = []
    for n, (a, b, c) in enumerate(combinations(range(5), 3)):
        keys.append(((F.lit(n).cast("long") * 2187 + group[a]) * 2187 + group[b]) * 2187 + group[c])
    return F.array(*keys)


def _manhattan(a: str, b: str) -> str:
    part = lambda c, i: f"bit_count(shiftrightunsigned({c}, {8 * i}) & 255L)"
    return " + ".join(f"abs({part(a, i)} - {part(b, i)})" for i in range(8))


def links(points: DataFrame, cell_limit: int = 64) -> DataFrame:
    """Edges (u, v) between the node ids of distinct fingerprints (fp, node) that differ in at most two bits.

    Pairs from small cells are all given; dense cells give star edges with the same components.
    """
    # dealt anew first, as each point makes ten cells and the counts of points before it were merged into few tasks
    cells = materialize(points.repartition("fp").select(F.explode(_cells(F.col("fp"))).alias("cell"), "fp", "node"), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    held = materialize(cells.join(sizes, "cell"), "dense")
    small = held.where(F.col("size") <= cell_limit)
    left, right = small.select("cell", F.col("fp").alias("fa"), F.col("node").alias("u")), small.select("cell", F.col("fp").alias("fb"), F.col("node").alias("v"))
    near = F.expr(f"fa < fb and {_manhattan('fa', 'fb')} <= 2 and bit_count(fa ^ fb) <= 2")
    pairs = left.join(right, (left["cell"] == right["cell"]) & near).select("u", "v")
    dense = held.where(F.col("size") > cell_limit).select("fp", "node").distinct()
    around = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    stars = dense.select(F.explode(around).alias("at"), "node").groupBy("at").agg(F.collect_list("node").alias("nodes")).where("size(nodes) > 1")
    stars = stars.select(F.array_min("nodes").alias("v"), F.explode("nodes").alias("u")).where("u <> v")
    return pairs.unionByName(stars.select("u", "v")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, cell_limit: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id): component_id is the smallest id linked directly or through others."""
    prints = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    points = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    labels = connected(links(points, cell_limit))
    points = points.join(labels, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(points, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _lanes(hashes: np.ndarray, lanes: int) -> list[int]:
    """Fingerprints of samples of a shingle set: each the bitwise majority of the three smallest values under one mixing."""
    out = []
    with np.errstate(over="ignore"):
        for i in range(lanes):
            x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * i * 0xD1B54A32D192ED03 & (1 << 64) - 1)
            x ^= x >> np.uint64(29)
            a, b, c = np.partition(x, 2)[:3] if len(x) > 2 else (x[0], x[0], x[-1])
            out.append(int((a & b) | (a & c) | (b & c)))
    return out


def common_shingles(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The hashes, in order, of at most COMMON shingles that are most common in a sample of the texts, and their counts there."""
    share = max(1, docs.count() // SAMPLE_TEXTS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = ((x.as_py() or b"").lower().split() for x in batch.column(0).cast(pa.binary()))
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(_hashes(words, width)) for words in texts if words)]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["key", "n"])

    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(share)) == 0).select(F.col(text_col).alias("text"))
    counts = map_arrow(sample, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()  # bounded, whatever the corpus
    keys = top.column("key").to_numpy().view(np.uint64)
    at = np.argsort(keys)
    return keys[at], top.column("n").to_numpy()[at]


def _rare(hashes: np.ndarray, similarity: float, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set in an order with common ones last and else by hash, and how many of them are not common.

    Two sets of this similarity share one of the first (1 - similarity) * n + 1.
    """
    weight = np.zeros(len(hashes), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        weight = np.where(keys[at] == hashes, counts[at], 0)
    size = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    return hashes[np.lexsort((hashes, weight))[:size]], min(size, int((weight == 0).sum()))


def _parities(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """For each of 64 * words classes of shingles whether the set has an odd number: two sets differ in as many shingles at least as in bits."""
    odd = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _wide(hashes: np.ndarray) -> np.ndarray | None:
    """Parities in classes enough for a set that has more shingles than WORDS tell apart: bits of chance differ by half, which has to be more than the similarity leaves."""
    words = WORDS
    while 4 * 64 * words < 3 * len(hashes):
        words *= 2
    return _parities(hashes, words) if words > WORDS else None


def _differ(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two sets' parities differ; those of more classes are first folded to as many as the other has."""
    n = min(len(x), len(y))
    odd = np.bitwise_xor.reduce(x.reshape(-1, n)) ^ np.bitwise_xor.reduce(y.reshape(-1, n))
    return int(np.bitwise_count(odd.view(np.uint64)).sum())  # of signed ones it would count absolute values


SKETCH = "doc_id long, same binary, fp long, lanes array<long>, rare array<long>, n_rare int, size int, bits array<long>, wide array<long>"


def sketches(docs: DataFrame, width: int, lanes: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, same, fp, lanes, rare, n_rare, size, bits, wide) of each text with a word.

    A digest of its words, its fingerprint, those of its samples, its rarest shingles and how many of them are not
    common as ``_rare`` gives them, how many different shingles it has, their parities, and those of more classes for long texts.
    """
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, width, id_col, text_col))  # COMMON values at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            words = (x.as_py() or b"").lower().split()
            if not words:
                continue
            hashes = _hashes(words, width)
            fp, hashes = _majority(hashes), np.unique(hashes)
            rare, n_rare = _rare(hashes, similarity, *held.value)
            rows.append((doc, xxhash.xxh3_128_digest(b" ".join(words)), fp, _lanes(hashes, lanes), rare.view(np.int64), n_rare, len(hashes), _parities(hashes), _wide(hashes)))
        cols = list(zip(*rows)) or [()] * 9
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        longs = pa.list_(pa.int64())
        arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(signed(cols[2])), pa.array([signed(x).tolist() for x in cols[3]], longs), pa.array(list(cols[4]), longs), pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int32()), pa.array(list(cols[7]), longs), pa.array(list(cols[8]), longs)]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "same", "fp", "lanes", "rare", "n_rare", "size", "bits", "wide"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id").cast("long"), F.col(text_col).alias("text")), run, SKETCH)


def _alike(similarity: float) -> str:
    """Whether the parities of sets a and b leave them room for the similarity."""
    differ = " + ".join(f"bit_count(a.bits[{i}] ^ b.bits[{i}])" for i in range(WORDS))
    return f"{differ} <= {(1 - similarity) / (1 + similarity)!r}D * (a.size + b.size) + 1e-6"


def _shingled(text: str, width: int) -> frozenset:
    words = text.encode().lower().split()
    return frozenset(zip(*(words[i:] for i in range(width)))) if len(words) >= width else frozenset([tuple(words)])


def _still_alike(pairs: DataFrame, at: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) of which some texts' wide parities leave room for the similarity, or aren't there."""
    sets = at.select("doc_id", "size", "wide")
    both = pairs.join(sets.alias("a"), F.col("u") == F.col("a.doc_id")).join(sets.alias("b"), F.col("v") == F.col("b.doc_id"))
    both = both.select("u", "v", F.col("a.size") + F.col("b.size"), "a.wide", "b.wide")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        (x, x_at), (y, y_at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in batch.columns[3:])
        for i, size in enumerate(batch.column(2).to_pylist()):
            a, b = x[x_at[i] : x_at[i + 1]], y[y_at[i] : y_at[i + 1]]
            keep.append(not len(a) or not len(b) or _differ(a, b) <= (1 - similarity) / (1 + similarity) * size + 1e-6)
        return batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(both.toDF("u", "v", "sizes", "x", "y"), run, "u long, v long").distinct()


def apart(at: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v), u > v, of texts (doc_id, rare, n_rare, size, bits, wide, part) in different components, part, that could have the similarity.

    Texts of this similarity share one of their rarest shingles, and the first they share leaves enough after it
    in both; in the smaller text it is even among the first (1 - s) / (1 + s) of its shingles. And their parities differ in
    few bits; of long texts, which meet by chance the more the more texts there are, only the wide ones tell. Shingles within one
    component only are dropped first; common ones, known from the sample, never meet there, so no task gets a hot one. Where many
    texts share a shingle, those of its largest component are not held against each other.

    Shingles meet in up to PIECES turns, each with its share of them, so that only one share's tables and shuffles are on disk.
    """
    home = around()
    total = at.agg(F.sum((1 - similarity) * F.col("size") + 1)).first()[0] or 0
    pieces = max(1, min(PIECES, math.ceil(total / KEYS)))
    found = []
    for piece in range(pieces):
        with scratch(at.sparkSession):
            met = _meeting(at, piece, pieces, similarity)
            found.append(materialize(_still_alike(met, at, similarity), "found", home))
    return reduce(DataFrame.unionByName, found).distinct()


def _meeting(at: DataFrame, piece: int, pieces: int, similarity: float) -> DataFrame:
    """The pairs that meet in a piece's share of the shingles and that the parities of all texts don't rule out."""
    keys = at.select("doc_id", "part", "n_rare", F.posexplode("rare").alias("pos", "key"))
    if pieces > 1:
        keys = keys.where(F.pmod(F.xxhash64("key"), F.lit(pieces)) == piece)
    keys = keys.select("doc_id", "part", "pos", "key", F.when(F.col("pos") >= F.col("n_rare"), F.col("doc_id")).alias("spread"))
    together = Window.partitionBy("key", "spread")
    mixed = keys.withColumn("lo", F.min("part").over(together)).withColumn("hi", F.max("part").over(together)).where("lo < hi or spread is not null")
    held = materialize(mixed.select("doc_id", "part", "pos", "key"), "held")
    most = held.groupBy("key", "part").count().groupBy("key").agg(F.max_by("part", F.struct("count", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    met = materialize(held.join(most, "key").select("doc_id", "pos", "key", "part", (F.col("part") == F.col("most")).alias("top")), "met")
    met = materialize(met.join(at.select("doc_id", "size", "bits"), "doc_id"), "sized")
    first = met.where(F.col("pos") <= F.col("size") * ((1 - similarity) / (1 + similarity)) + 1e-6)
    fits = F.expr(f"""a.key = b.key and a.part <> b.part and (b.size < a.size or b.size = a.size and b.doc_id < a.doc_id)
        and least(a.size - a.pos, b.size - b.pos) + 1e-6 >= {similarity!r}D / (1 + {similarity!r}D) * (a.size + b.size) and {_alike(similarity)}""")
    meet = lambda a, b: a.alias("a").join(b.alias("b"), fits).select(F.greatest("a.doc_id", "b.doc_id").alias("u"), F.least("a.doc_id", "b.doc_id").alias("v"))
    pairs = meet(met.where("not top"), first).unionByName(meet(met.where("top"), first.where("not top"))).where("u <> v").distinct()
    return materialize(pairs, "meeting")


def compared(pairs: DataFrame, docs: DataFrame, width: int, similarity: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those of the pairs (u, v) of which some texts have the similarity, compared word by word, as a written table.

    Only texts in a pair are moved. A pair's text u is held against that of v as texts stream by, sorted with v
    first; of a v in many pairs these are dealt over tasks by about SHARE, so v's text is not copied for each of them.
    Pairs whose texts have more bytes than MOVED and than all these texts once are compared in turns, each of about so many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, known = None, frozenset()
        for batch in batches:
            keep: tuple[list, list] = ([], [])
            for v, tie, share, u, t in zip(*(c.to_pylist() for c in batch.columns)):
                if u is None:
                    head, known = (v, tie, share), _shingled(t, width)
                    continue
                assert head == (v, tie, share)
                grams = _shingled(t, width)
                common = len(known & grams)
                if common >= similarity * (len(known) + len(grams) - common):
                    keep[0].append(u)
                    keep[1].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in keep], names=["u", "v"])

    home, found = around(), []
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        need = materialize(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct(), "need")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("tie"), F.octet_length(text_col).cast("long").alias("bytes"))
        texts = materialize(texts.join(few_ids(need), "id", "left_semi").where("t is not null").dropDuplicates(["id", "tie"]), "texts")
        shares = pairs.groupBy("v").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
        asked = pairs.join(shares, "v").join(texts.select(F.col("id").alias("v"), "tie"), "v").select("u", "v", "tie", F.pmod(F.xxhash64("u"), F.col("shares")).alias("share"))
        asked = materialize(asked, "asked")
        moved = asked.groupBy("u").count().join(texts.select(F.col("id").alias("u"), "bytes"), "u").agg(F.sum(F.col("count") * F.col("bytes"))).first()[0] or 0
        held = texts.agg(F.sum("bytes")).first()[0] or 0
        turns = max(1, math.ceil(moved / max(MOVED, held)))
        for turn in range(turns):
            now = asked if turns == 1 else asked.where(F.pmod(F.xxhash64("u", "v"), F.lit(turns)) == turn)
            first = now.select("v", "tie", "share").distinct().join(texts.withColumnRenamed("id", "v"), ["v", "tie"]).select("v", "tie", "share", F.lit(None).cast("long").alias("u"), "t")
            others = now.join(texts.select(F.col("id").alias("u"), "t"), "u").select("v", "tie", "share", "u", "t")
            both = first.unionByName(others).repartition("v", "tie", "share").sortWithinPartitions("v", "tie", "share", "u")  # nulls first
            found.append(materialize(both.mapInArrow(run, "u long, v long"), "alike", home))
    return reduce(DataFrame.unionByName, found)


def _first_pass(prints: DataFrame, docs: DataFrame, width: int, similarity: float, few: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) of the first pass over sketches, and the texts that are no copies of others."""
    # written first, so that the join deals both sides anew and can divide a text of very many copies
    first = materialize(prints.groupBy("same").agg(F.min("doc_id").alias("first")), "first")
    named = materialize(prints.select("doc_id", "same", "fp", "lanes").join(first, "same").drop("same"), "named")
    copies = named.where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    alone = named.where("doc_id = first").drop("first")
    keyed = alone.select("doc_id", F.posexplode("lanes").alias("lane", "key"))
    size = keyed.groupBy("lane", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).where("n > 1")
    held = materialize(keyed.join(size, ["lane", "key"]), "lanes")
    small = held.where(F.col("n") <= few)
    pairs = small.alias("a").join(small.alias("b"), F.expr("a.lane = b.lane and a.key = b.key and a.doc_id > b.doc_id")).select(F.col("a.doc_id").alias("u"), F.col("b.doc_id").alias("v"))
    large = held.where(F.col("n") > few).withColumn("salt", F.pmod(F.xxhash64("doc_id", "lane"), F.ceil(F.col("n") / few)))
    salted = large.groupBy("lane", "key", "salt").agg(F.min("doc_id").alias("near"))
    stars = large.select(F.col("doc_id").alias("u"), F.col("low").alias("v")).unionByName(large.join(salted, ["lane", "key", "salt"]).select(F.col("doc_id").alias("u"), F.col("near").alias("v")))
    points = alone.groupBy("fp").agg(F.min("doc_id").alias("node"))
    same_fp = alone.join(points, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    grid = links(points).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = materialize(pairs.unionByName(stars).unionByName(same_fp).unionByName(grid).where("u <> v").distinct(), "near")
    sized = prints.select("doc_id", "size", "bits")
    alike = pairs.join(sized.alias("a"), F.col("u") == F.col("a.doc_id")).join(sized.alias("b"), F.col("v") == F.col("b.doc_id")).where(_alike(similarity))
    pairs = materialize(alike.select("u", "v").distinct(), "pairs")
    edges = compared(pairs, docs, width, similarity, id_col, text_col).unionByName(copies).distinct()
    return edges, alone


def _linked(docs: DataFrame, width: int, similarity: float, lanes: int, few: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The edges of the first pass, their components, and the edges of the second pass.

    What only one step reads is removed after it, as sketches and prefixes each take nearly half as much as the texts.
    """
    spark, home = docs.sparkSession, around()
    with scratch(spark, shuffles=True) as both:
        with scratch(spark) as second:
            with scratch(spark):
                prints = materialize(sketches(docs.where(F.col(id_col).isNotNull()), width, lanes, similarity, id_col, text_col), "sketches")
                edges, alone = _first_pass(prints, docs, width, similarity, few, id_col, text_col)
                edges = materialize(edges, "edges", home)
                labels = materialize(connected(edges), "labels", home)
                shown = prints.select("doc_id", "rare", "n_rare", "size", "bits", "wide").join(alone.select("doc_id").distinct(), "doc_id", "left_semi")
                at = shown.join(labels, F.col("doc_id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "doc_id")).drop("node", "component")
                at = materialize(at, "at", second)
            rest = materialize(apart(at, similarity), "rest", both)
        return edges, labels, materialize(compared(rest, docs, width, similarity, id_col, text_col).distinct(), "linked", home)


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8, lanes: int = 12, few: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edges (u, v), u > v, between ids of texts whose sets of word shingles have a Jaccard similarity of ``similarity``.

    Texts with equal words are linked to the smallest id among them and stand for one. A first pass links most
    groups by few comparisons: texts that share a fingerprint of a sample of the shingle set ("lane"), or whose
    whole fingerprints are within two bits in the grid, are compared exactly. Up to ``few`` texts that
    share such a fingerprint are all compared; of more, each is compared to the smallest id there and to the
    smallest of its salted share of about ``few``.

    The second pass (``apart``) compares whatever pairs of texts the first has not linked, directly or through others, and
    could have the similarity. So the edges have the components of all pairs, and pairs within one may be left out.
    """
    edges, _, rest = _linked(docs, width, similarity, lanes, few, id_col, text_col)
    return edges.unionByName(rest).distinct()


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: of each group linked by ``similar`` the row with the smallest id stays.

    All columns stay. Texts without a word and rows without an id are in no group. Of rows with equal id and text
    one stays; rows with one id and different texts are one document and go or stay together.
    """
    with scratch(docs.sparkSession, shuffles=True):
        _, labels, rest = _linked(docs, width, similarity, 12, 16, id_col, text_col)
        # the components so far are stars, so few steps are left
        groups = connected(labels.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest))
        gone = materialize(groups.where("node <> component").select(F.col("node").alias(id_col)), "gone", keep=True)
        twice = materialize(docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col), "twice", keep=True)
    left = docs.join(few_ids(gone), id_col, "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return left
    single = left.join(few_ids(twice), id_col, "left_anti").select(*docs.columns)
    return single.unionByName(left.join(few_ids(twice), id_col, "left_semi").select(*docs.columns).dropDuplicates([id_col, text_col]))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
