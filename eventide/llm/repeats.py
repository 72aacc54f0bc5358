"""Repeated passages by an enhanced suffix array over content-chosen places.

A byte is removed if it lies in a string of LENGTH bytes that also starts somewhere else. Every such string
("window") contains GRAM-byte strings; the one with the smallest hash, the leftmost on ties, is its anchor, so
equal windows have anchors with equal fingerprints at equal offsets. An anchor's row stands for all
windows it owns, about (LENGTH - GRAM) / 2 of them, and knows the hash of their union ("hull").

0. A text of LENGTH bytes or more that occurs twice or more is removed whole. One of its copies stands for all of them in
   what follows, so groups of copies and repeated rows cost what one text costs.
1. Anchors whose fingerprint occurs once are done. Where all anchors of a fingerprint have one hull, all their
   windows repeat. So do those of a hull that occurs twice.
2. What remains are anchors whose surroundings differ: one per hull is gathered by fingerprint, with the
   bytes around it. There their suffixes are sorted, common prefixes of neighbours give the tree of prefix
   intervals by a stack scan, and in each interval the bytes to the left are compared: members that agree on
   enough of them repeat, those in an interval whose left sides are all alike say nothing new. An interval
   and its left classes are maximal repeats with all their occurrences (``repeat_groups``), not only
   neighbours in the array. Left sides are sorted once; intervals take their common lengths from a table of range minima.
3. A task sorts MEMBERS suffixes of a fingerprint at most. Where there are more, they are divided by ranges of the place of
   the anchor in the window, of half the size each time: windows with the anchor in lo..hi-1 share lo bytes left of it and
   length - hi + 1 bytes right of it, so each half is a group of members by one more prefix (128-bit digests), in
   which all its repeats are found. Members alone in their group are done. After log2(length) steps at most a group shares whole windows.

Passages of some number of words are found likewise in rows of 32-bit codes of words, a code for a byte (``coded``): they
may be shorter than LENGTH bytes and differ in white space.

Places of one hull in a text at equal steps (a line over and over) are one row. No step holds a group of unbounded size, and copies collapse into counts before anything is compared.
Texts are bytes in UTF-8, known by their MD5, cut into overlapping segments so that memory doesn't grow with their
length. Null and short texts have no windows. Rows of one id and text, or without an id, count as places of their own
and get equal results; other columns are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, few_ids, materialize, scratch

LENGTH = 400
GRAM = 128
MEMBERS = 1 << 15
SEGMENT = 1 << 19
WORDS = 51
WORD_GRAM = 16
SPACES = b" \t\n\v\f\r"
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A table of 64-bit values for bytes, and powers of an odd base and of its inverse."""
    base = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)[which]
    table = _mix(np.arange(1, 257, dtype=np.uint64) * M1 + np.uint64(which))
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, pow(base, -1, 1 << 64), np.uint64)]))
    return table, up, down


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * M2
        return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of all substrings of some bytes or codes, from one pass."""

    def __init__(self, data: np.ndarray, which: int = 0):
        table, up, self.down = _powers(which, 1 << max(10, (len(data)).bit_length()))
        with np.errstate(over="ignore"):
            values = table[data] if data.dtype == np.uint8 else _mix((data.astype(np.uint64) + np.uint64(1)) * M1 + np.uint64(which))
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(data)])])

    def of(self, start, end) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of the windows of several texts in a row: (text number, place in data, least and greatest offset, fingerprint, hull).

    bounds holds where each text starts, and the end. Windows across two texts are left out.
    """
    span = length - gram + 1
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    hashes = Hashes(data)
    grams = hashes.grams(gram)
    bits = np.uint64(max(20, len(grams).bit_length()))
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    pad = -len(packed) % span
    rows = np.concatenate([packed, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, span)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(tail[:n], head[span - 1 : span - 1 + n]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(n)
    text = np.searchsorted(bounds, start, side="right") - 1
    start = start[start + length <= bounds[text + 1]]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    place, text = place[start], text[start]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (np.diff(start) != 1)]))
    last = np.concatenate([first[1:], [len(start)]]) - 1
    at = place[first]
    most, least = at - start[first], at - start[last]
    return text[first], at, least, most, grams[at], hashes.of(at - most, at - least + length)


def word_codes(texts: list[bytes | None]) -> list[bytes]:
    """The words of each text as 32-bit codes in a row; words are what stands between ASCII white space."""
    out, held, size = [], [], 0
    for x in texts:
        data = x or b""
        if held and size + len(data) >= SEGMENT:
            out += _codes(held)
            held, size = [], 0
        if len(data) >= SEGMENT:
            out.append(b"".join(_long_codes(data)))
        else:
            held.append(data)
            size += len(data) + 1
    return out + _codes(held)


def _codes(texts: list[bytes]) -> list[bytes]:
    if not any(texts):
        return [b""] * len(texts)
    data = np.frombuffer(b" ".join(texts), np.uint8)
    inside = ~np.isin(data, np.frombuffer(SPACES, np.uint8))
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edges[::2], edges[1::2]
    codes = Hashes(data).of(start, end).astype(np.uint32)
    cuts = np.searchsorted(start, np.cumsum([0, *(len(x) + 1 for x in texts)]))
    return [codes[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]


def _long_codes(data: bytes) -> Iterator[bytes]:
    """Those of a text in pieces cut at white space; words of SEGMENT bytes or more have a digest's."""
    a = 0
    while len(data) - a >= SEGMENT:
        cut = max(data.rfind(x, a, a + SEGMENT) for x in SPACES)
        if cut < 0:
            cut = min((x for x in (data.find(x, a + SEGMENT) for x in SPACES) if x >= 0), default=len(data))
            yield hashlib.md5(data[a:cut]).digest()[:4]
        else:
            yield from _codes([data[a:cut]])
        a = cut + 1
    yield from _codes([data[a:]])


def _segments(ids, texts, length: int, unit: int = 1) -> Iterator[tuple[np.ndarray, list, np.ndarray, np.ndarray]]:
    """Texts packed together up to SEGMENT bytes (or codes of unit bytes); longer ones in pieces that overlap by a window less a byte."""
    held, meta, size = [], [], 0
    for text, x in zip(ids, texts):
        data = x or b""
        for a in range(0, len(data) // unit - length + 1, SEGMENT):
            piece = data[a * unit : (a + SEGMENT + length - 1) * unit]
            if size and size + len(piece) // unit > SEGMENT:
                yield _pack(held, meta, unit)
                held, meta, size = [], [], 0
            held.append(piece)
            meta.append((text, a))
            size += len(piece) // unit
    if held:
        yield _pack(held, meta, unit)


def _pack(held, meta, unit):
    bounds = np.cumsum([0, *(len(x) // unit for x in held)])
    ids, offset = zip(*meta)
    return np.frombuffer(b"".join(held), np.uint8 if unit == 1 else np.uint32), list(ids), bounds, np.array(offset, np.int64)


ANCHOR = "fp long, hull long, id binary, pos int, a short, b short, step int, times int"


def _runs(text: np.ndarray, fp: np.ndarray, hull: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, step, size) of runs of rows: places of one hull in a text at equal steps."""
    order = np.lexsort((pos, hull, fp, text))
    one, other = order[:-1], order[1:]
    gap = np.where((text[one] == text[other]) & (fp[one] == fp[other]) & (hull[one] == hull[other]), pos[other] - pos[one], 0)
    before = np.concatenate([[0], gap[:-1]])
    starts = np.flatnonzero(np.concatenate([[True], (gap == 0) | (before != 0) & (gap != before)]))
    size = np.diff(np.concatenate([starts, [len(order)]]))
    return order[starts], np.where(size > 1, np.concatenate([gap, [0]])[starts], 0), size


def anchor_rows(rows: DataFrame, length: int, gram: int, coded: bool = False) -> DataFrame:
    """Anchors of all texts of rows (id, data), a row for each run of them: ``times`` places, from pos on, ``step`` apart."""
    unit = 4 if coded else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for data, ids, bounds, offset in _segments(batch.column(0).to_pylist(), word_codes(texts) if coded else texts, length, unit):
                text, at, least, most, fp, hull = anchors(data, bounds, length, gram)
                if not len(text):
                    continue
                pos = at - bounds[text] + offset[text]
                first, step, times = _runs(text, fp, hull, pos)
                text, fp, hull, pos, least, most = (x[first] for x in (text, fp, hull, pos, least, most))
                arrays = [pa.array(fp.view(np.int64)), pa.array(hull.view(np.int64)), pa.array(ids, pa.binary()).take(pa.array(text)), pa.array(pos.astype(np.int32)), pa.array(least.astype(np.int16)), pa.array(most.astype(np.int16))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(step.astype(np.int32)), pa.array(times.astype(np.int32))], names=["fp", "hull", "id", "pos", "a", "b", "step", "times"])

    bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, ANCHOR)


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of rows of two matrices of equal shape."""
    differ = x != y
    return np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1])


def prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The intervals (common prefix, first, last) of a suffix array, inner ones first, by a stack scan.

    lcp[i] is the common prefix of suffixes i - 1 and i; intervals of under ``least`` are left out.
    """
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        here = lcp[i] if i < len(lcp) else 0
        left = i - 1
        while stack[-1][0] > here:
            size, left = stack.pop()
            if size >= least:
                yield size, left, i - 1
        if here > stack[-1][0]:
            stack.append((here, left))


def _neighbours(order: list[int], parts: list[bytes], same: np.ndarray | None = None) -> np.ndarray:
    """The common prefix of each of the parts in this order with the one before it, 0 for the first and where same differs."""
    widest, step, out = max(max(map(len, parts)), 1), 4096, [np.zeros(1, np.int64)]
    for a in range(1, len(order), step):
        some = order[a - 1 : a + step]
        # ends of unequal texts never match: each row is padded with its own end mark
        rows = np.full((len(some), widest), 256, np.uint16)
        for row, i in zip(rows, some):
            row[: len(parts[i])] = np.frombuffer(parts[i], np.uint8)
        sizes = np.array([len(parts[i]) for i in some])
        shared = np.minimum(_common(rows[1:], rows[:-1]), np.minimum(sizes[1:], sizes[:-1]))
        if same is not None:
            shared = np.where(same[some[1:]] == same[some[:-1]], shared, 0)
        out.append(shared)
    return np.concatenate(out)


class _Minima:
    """Smallest values of ranges of an array, from those of ranges whose sizes are powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values.astype(np.int32)]
        while 2 << len(self.levels) - 1 <= len(values):
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The smallest of values[first : last + 1], element by element."""
        out, size = np.empty(len(first), np.int64), last - first + 1
        level = np.frexp(size)[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][first[at]], self.levels[k][last[at] - (1 << int(k)) + 1])
        return out


def repeat_groups(fps: list[int], lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[list[int], int, np.ndarray]]:
    """Repeats through the anchors of a bin: (members, common bytes right of the anchor, each one's common bytes left).

    lefts are reversed. A member's common bytes are the most it shares with any other member. Intervals in which no
    member's left side allows a repeat of length bytes are left out.
    """
    order = sorted(range(len(fps)), key=lambda i: (fps[i], rights[i]))
    by_left = sorted(range(len(fps)), key=lefts.__getitem__)
    rank = np.empty(len(fps), np.int64)
    rank[by_left] = np.arange(len(fps))
    shared_left = _Minima(_neighbours(by_left, lefts))
    lcp = _neighbours(order, rights, np.array(fps, np.int64)).tolist()
    places = np.array(order)
    for size, lo, hi in prefix_intervals(lcp, max(1, length - max(map(len, lefts)))):
        at = np.sort(rank[places[lo : hi + 1]])
        shared = shared_left.of(at[:-1] + 1, at[1:])
        best = np.maximum(np.concatenate([[0], shared]), np.concatenate([shared, [0]]))
        if best.max() + size >= length:
            yield [by_left[i] for i in at], size, best


def _bins(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple]]:
    """Rows sorted by fingerprint, in bins of whole fingerprints with about most rows."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if len(held) >= most and row[0] != held[-1][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


SPAN = "id binary, s int, e int"
MEMBER = "key binary, id binary, pos int, a short, b short, single boolean, lo short, hi short, left_side binary, right_side binary"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.binary(), pa.int32(), pa.int32()])], names=["id", "s", "e"])


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, members: int = MEMBERS, coded: bool = False) -> DataFrame:
    """(id, s, e): spans of repeated bytes of texts (id, data), ids being unique; spans of a text may overlap.

    coded: of words, in which all numbers count then.
    """
    unit = 4 if coded else 1
    with scratch(texts.sparkSession):
        found = materialize(anchor_rows(texts, length, gram, coded), "found")
        shared = found.groupBy("fp").agg(F.sum("times").alias("n"), F.min("hull").alias("lo"), F.max("hull").alias("hi")).where("n > 1")
        # written first, so that the join deals both sides anew and can divide a fingerprint of very many rows
        shared = materialize(shared.select("fp", (F.col("lo") == F.col("hi")).alias("one")), "shared")
        held = materialize(found.join(shared, "fp"), "anchors", True)

    def whole(runs: DataFrame) -> DataFrame:
        # a span for each place of a run, or one where they touch
        at = f"""if(step <= b - a + {length}, array(struct(pos - b AS s, pos - a + {length} + (times - 1) * step AS e)),
            transform(sequence(0, times - 1), i -> struct(pos - b + i * step AS s, pos - a + {length} + i * step AS e)))"""
        return runs.select("id", F.inline(F.expr(at)))

    done = whole(held.where("one"))
    mixed = held.where("not one")
    # one anchor per hull stands for it
    hulls = mixed.groupBy("fp", "hull").agg(F.sum("times").alias("n"), F.min(F.struct("id", "pos", "a", "b")).alias("at"))
    hulls = materialize(hulls, "hulls")
    # by a merge join, in which hulls of very many rows can be divided; a broadcast would leave them as they are dealt
    done = done.unionByName(whole(mixed.join(hulls.where("n > 1").select("fp", "hull").hint("merge"), ["fp", "hull"])))
    # where a hull stands alone, it is compared with the others
    groups = hulls.groupBy("fp").agg(F.count("*").alias("m"), F.min("n").alias("alone")).where("alone = 1")
    # written first as well: a fingerprint of very many hulls can be divided
    groups = materialize(groups.select("fp", "m"), "groups")
    wanted = hulls.join(groups, "fp").select("at.id", F.struct("fp", "at.pos", "at.a", "at.b", (F.col("n") == 1).alias("single"), "m").alias("w"))
    asked = wanted.groupBy("id").agg(F.collect_list("w").alias("ws"))  # no more than the text has anchors

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            ids, asked_of, texts = (c.to_pylist() for c in batch.columns)
            for text, ws, data in zip(ids, asked_of, word_codes(texts) if coded else texts):
                for w in ws:
                    p = w["pos"]
                    key = w["fp"].to_bytes(8, "little", signed=True)
                    left, right = data[(p - w["b"]) * unit : p * unit][::-1], data[p * unit : (p - w["a"] + length) * unit]
                    out.append((key, text, p, w["a"], w["b"], w["single"], 0, length - gram + 1, left, right, w["m"]))
                    size += 700
                    if size > 8 << 20:
                        yield _members(out, ["m"])
                        out, size = [], 0
            if out:
                yield _members(out, ["m"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _bins(batches, 4096):
            out = []
            number = {key: i for i, key in enumerate(dict.fromkeys(r[0] for r in rows))}
            for group, size, best in repeat_groups([number[r[0]] for r in rows], [r[6] for r in rows], [r[7] for r in rows], length * unit):
                for i, left in zip(group, best.tolist()):
                    _, text, p, a, b, single, _, _ = rows[i]
                    low, high = max(a, length - size // unit), min(b, left // unit)
                    if single and low <= high:
                        out.append((text, p - high, p - low + length))
            yield _spans(out)

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, p, a, b, single, lo, hi, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                mid = (lo + hi) // 2
                if a < mid and b >= lo:
                    out.append((hashlib.md5(b"r" + key + right[: (length - mid + 1) * unit]).digest(), text, p, a, b, single, lo, mid, left, right))
                if b >= mid and a < hi:
                    out.append((hashlib.md5(b"l" + key + left[: mid * unit]).digest(), text, p, a, b, single, mid, hi, left, right))
            if out:
                yield _members(out)

    around = materialize(asked.join(texts, "id").select("id", "ws", "data").mapInArrow(cut, f"{MEMBER}, m long"), "around")
    while True:  # as often as length - gram + 1 can be halved, at most
        few = around.where(F.col("m") <= members).select("key", "id", "pos", "a", "b", "single", "left_side", "right_side")
        done = done.unionByName(few.repartition("key").sortWithinPartitions("key").mapInArrow(scan, SPAN))
        more = around.where(F.col("m") > members)
        if more.isEmpty():
            return done
        # a range of one place: what its members share is the whole window
        done = done.unionByName(more.where("single and hi - lo = 1").select("id", (F.col("pos") - F.col("lo")).alias("s"), (F.col("pos") - F.col("lo") + length).alias("e")))
        halves = materialize(more.where("hi - lo > 1").drop("m").mapInArrow(halve, MEMBER), "halves")
        sizes = halves.groupBy("key").agg(F.count("*").alias("m"), F.max("single").alias("asked")).where("m > 1 and asked")
        around = materialize(halves.join(materialize(sizes.select("key", "m"), "sizes"), "key"), "around")


def _members(rows: list[tuple], more: list[str] | None = None) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int16(), pa.int16(), pa.bool_(), pa.int16(), pa.int16(), pa.binary(), pa.binary(), pa.int64()]
    names = ["key", "id", "pos", "a", "b", "single", "lo", "hi", "left_side", "right_side", *(more or [])]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal runs."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, members: int = MEMBERS, id_col: str = "doc_id", text_col: str = "text", words: int | None = None, word_gram: int = WORD_GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs; kept is what is left, as bytes.

    words: n_repeat_words comes before kept, the number of words in runs of so many words that also start anywhere else.
    """
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.unhex(F.md5(data)).alias("id"), data.alias("data"))
    size, least = F.octet_length("data"), min(length, 2 * words - 1) if words else length
    copied = few_ids(materialize(rows.where(size >= least).groupBy("id").agg(F.count("*").alias("n"), F.min("doc").alias("doc")).where("n > 1").select("id", "doc"), "copied"))
    alone = rows.join(copied.select("id"), "id", "left_anti")
    # one copy of each copied text: those of its smallest id, and of these any
    stand_in = rows.join(copied.withColumnRenamed("doc", "least"), "id").where("doc <=> least").select("id", "data").dropDuplicates(["id"])
    texts = alone.where(size >= least).select("id", "data").unionByName(stand_in)
    spans = repeated_spans(texts.where(size >= length), length, gram, members).withColumn("word", F.lit(False))
    if words:
        spans = spans.unionByName(repeated_spans(texts, words, word_gram, members, coded=True).withColumn("word", F.lit(True)))
    spans = spans.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("s", "e", "word"))).alias("spans"))  # no more than the text has anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, data, spans in zip(*(c.to_pylist() for c in batch.columns)):
                gone = merged([(x["s"], x["e"]) for x in spans or [] if not x["word"]])
                kept = b"".join(data[a:b] for (_, a), (b, _) in zip([(0, 0), *gone], [*gone, (len(data), 0)]))
                again = sum(e - s for s, e in merged([(x["s"], x["e"]) for x in spans or [] if x["word"]]))
                out.append((doc, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), again, kept))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeat_words", "kept"])

    short = rows.where(size < least).select("doc", "data", F.lit(None).cast("array<struct<s:int,e:int,word:boolean>>").alias("spans"))
    left = alone.where(size >= least).join(spans, "id", "left").select("doc", "data", "spans").unionByName(short)
    left = left.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeat_words long, kept binary")
    # copies: all of their words repeat, and their bytes if there are enough
    whole, n = size >= length, F.expr(r"regexp_count(cast(data AS string), r'[^\x20\x09-\x0D]+')")
    kept = F.when(whole, F.lit(b"")).otherwise(F.col("data"))
    gone = rows.join(copied.select("id"), "id", "left_semi").select(
        F.col("doc").alias("doc_id"),
        size.cast("long").alias("n_bytes"),
        F.when(whole, size).otherwise(0).cast("long").alias("n_removed"),
        whole.cast("long").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"),
        F.when(n >= (words or 0), n).otherwise(0).cast("long").alias("n_repeat_words"),
        kept.alias("kept"),
    )
    out = left.unionByName(gone)
    return out if words else out.drop("n_repeat_words")


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=WORDS).drop("kept")
