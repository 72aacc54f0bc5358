"""Token ids in binary files: plane-shuffled blocks with a chunk index.

A file holds the ids of a range of documents in ascending id order. Ids are cut into blocks of a fixed
number; a block's 32-bit ids are transposed into four byte planes or 32 bit planes, planes without a set
bit are left out, and each plane is compressed with zstandard. The tail holds the chunk index (offset, ids
and plane sizes of each block) and the document index (id and token count of each document), so any
document can be read without the rest:

    blocks | index (zlib-free JSON, zstandard) | length of the index, 8 bytes little-endian | MAGIC

A file is closed at FILE_IDS ids and the next one begun, so that files, and the tasks that read them, are bounded whatever
the number of partitions. A task writes under a name of its own attempt and then moves the file, so a repeated task leaves one
whole file. Files are reached through pyarrow's file systems (file, hdfs, s3, gs) by the folder's URI.

Null and empty texts have only the end id. Rows with one id are all kept, ordered by a hash of their text.
Other columns are left aside. An empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_symbols, tokenizer_path
from .common import bounded_batches, fresh_path, materialize

MAGIC = b"EVTPLANE"
BLOCK = 1 << 16
FILE_IDS = 1 << 26
LEVEL = 1
CACHE = 300_000  # pieces kept by a worker in each of two generations
LONG = 48  # longer pieces are not kept
PLAIN = re.compile("[\n\0]?[!-~\u00a1-\u024f]+")
# The pattern by which byte-level tokenizer files split text.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SPACES = [*map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)), " \n", "\n "]


class _Words(dict):
    """Id bytes of what the splitter cuts out, by the library's own model."""

    def __init__(self, model):
        super().__init__()
        self.model, self.table = model, {i: ord(c) for i, c in enumerate(byte_symbols())}
        self.space = chr(self.table[32])

    def __missing__(self, word: str) -> bytes:
        if word.isascii():  # printable by PLAIN, so all but the space stand for themselves
            shown = word.replace(" ", self.space)
        else:
            shown = word.encode().decode("latin-1").translate(self.table)
        value = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[word] = value
        return value


class ByteEncoder:
    """Ids of whole texts by a byte-level tokenizer file of the tokenizers library.

    Its splitter never joins what stands on two sides of a lone space or line end, so a text's pieces
    between them are encoded once each, by the library's splitting pattern and model, and kept. Texts with other
    white space there, and pieces with characters outside the Latin blocks, are encoded by the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        #: whether the file has the settings that pieces are built for; with others the library encodes texts whole
        self.fits = plain and model["type"] == "BPE" and spec["normalizer"] is None and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True)
        self.known = _Pieces(self)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.line = self._whole("\n") if self.fits else b""
        self.words = _Words(self.tokenizer.model)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, p: str) -> bytes:
        if p[:1] == "\n":
            return self.line + (self._whole(p[1:]) if p[1:] else b"")
        return (self._whole(p[1:]) if p[1:] else b"") if p[:1] == "\0" else self._whole(" " + p)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.fits or "  " in text or "\n\n" in text or any(w in text and (w + " " in text or " " + w in text or w + "\n" in text or "\n" + w in text) for w in SPACES) or "\0" in text or ("<" in text and self.special.search(text)):
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, ("\0" + text.replace("\n", " \n")).split(" ")))


class _Pieces(dict):
    """Id bytes of pieces; "\\n" before a piece stands for a line end, "\\0" for nothing, else a space is meant."""

    def __init__(self, encoder: ByteEncoder):
        super().__init__()
        self.encoder, self.older = encoder, {}

    def __missing__(self, p: str) -> bytes:
        value = self.older.pop(p, None)
        if value is None:
            value = self._encode(p)
        if len(p) <= LONG:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[p] = value
        return value

    def _encode(self, p: str) -> bytes:
        if not PLAIN.fullmatch(p):
            return self.encoder._piece(p)
        words = self.encoder.words
        if p.isalpha():
            return words[" " + p]
        lone = p[0] in "\n\0"
        value = b"".join(map(words.__getitem__, PATTERN.findall(p[1:] if lone else " " + p)))
        return self.encoder.line + value if p[0] == "\n" else value


_LOADED: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    if path not in _LOADED:
        _LOADED[path] = ByteEncoder(path)
    return _LOADED[path]


def pack(ids: np.ndarray, planes: str = "byte") -> tuple[list[int], bytes]:
    """A block's compressed planes: their sizes, 0 for a plane without a set bit, and their bytes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bit":
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = np.ascontiguousarray(raw.T)
    packer = zstandard.ZstdCompressor(level=LEVEL)
    parts = [packer.compress(x.tobytes()) if x.any() else b"" for x in rows]
    return [len(p) for p in parts], b"".join(parts)


def unpack(data: bytes, sizes: list[int], n: int) -> np.ndarray:
    """The ids of a block of n."""
    width = n if len(sizes) == 4 else (n + 7) // 8
    rows, at, reader = np.zeros((len(sizes), width), np.uint8), 0, zstandard.ZstdDecompressor()
    for row, size in zip(rows, sizes):
        if size:
            row[:] = np.frombuffer(reader.decompress(data[at : at + size], max_output_size=width), np.uint8)
        at += size
    if len(sizes) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class Writer:
    """Writes one file from runs of ids."""

    def __init__(self, stream, planes: str):
        self.stream, self.planes, self.held, self.size, self.at, self.n = stream, planes, [], 0, 0, 0
        self.blocks, self.doc_ids, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.n += len(ids) // 4
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 4 * BLOCK:
            self.flush(False)

    def flush(self, last: bool) -> None:
        data = b"".join(self.held)
        end = len(data) if last else len(data) // (4 * BLOCK) * (4 * BLOCK)
        for a in range(0, end, 4 * BLOCK):
            part = np.frombuffer(data[a : min(end, a + 4 * BLOCK)], "<u4")
            sizes, packed = pack(part, self.planes)
            self.blocks.append([self.at, len(part), sizes])
            self.stream.write(packed)
            self.at += len(packed)
        self.held, self.size = [data[end:]], len(data) - end

    def close(self) -> None:
        self.flush(True)
        tail = zstandard.ZstdCompressor(level=LEVEL).compress(json.dumps({"blocks": self.blocks, "doc_ids": self.doc_ids, "counts": self.counts}).encode())
        self.stream.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
        self.stream.close()


def read_file(source) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, its ids as bytes) for each document of an open file, block by block."""
    size = source.size()
    source.seek(size - 16)
    end = source.read(16)
    if end[8:] != MAGIC:
        raise ValueError("not a token file")
    length = int.from_bytes(end[:8], "little")
    source.seek(size - 16 - length)
    index = json.loads(zstandard.ZstdDecompressor().decompress(source.read(length)))
    blocks, held, have = iter(index["blocks"]), [], 0
    for doc_id, count in zip(index["doc_ids"], index["counts"]):
        while have < 4 * count:
            at, n, sizes = next(blocks)
            source.seek(at)
            held.append(unpack(source.read(sum(sizes)), sizes, n).tobytes())
            have += 4 * n
        data = held[0] if len(held) == 1 else b"".join(held)
        yield doc_id, data[: 4 * count]
        have -= 4 * count
        held = [data[4 * count :]]


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0, planes: str = "byte", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode docs into files in folder, in ascending id order; rows (shard, part, path, n_docs, n_tokens) of the files."""
    spark = docs.sparkSession
    bounded_batches(spark)
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = file_system(folder)
        shard, writer, part = task.partitionId(), None, 0
        enc = byte_encoder(tokenizer)

        def closed() -> pa.RecordBatch:
            name = f"part-{shard:05d}-{part:05d}.ids"
            writer.close()
            fs.move(draft, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [len(writer.counts)], "n_tokens": [sum(writer.counts)]})

        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                for doc_id, ids in zip(batch.column(0)[a : a + 200].to_pylist(), map(enc.encode, batch.column(1)[a : a + 200].to_pylist())):
                    if writer is not None and writer.n >= FILE_IDS:
                        yield closed()
                        writer, part = None, part + 1
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        draft = f"{base}/part-{shard:05d}-{part:05d}.{task.taskAttemptId()}"
                        writer = Writer(fs.open_output_stream(draft), planes)
                    writer.add(doc_id, ids + end)
        if writer is not None:
            yield closed()

    return materialize(rows.mapInArrow(run, "shard int, part int, path string, n_docs long, n_tokens long"), "shards")


def read_tokens(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """Read the files back: (doc_id, start, n_tokens, ids_crc32[, ids]) of each document, start over all files."""
    parts = max(1, min(shards.count(), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = file_system(path)
                rows, held, at = [], 0, base
                with fs.open_input_file(name) as source:
                    for doc_id, ids in read_file(source):
                        rows.append((doc_id, at, len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                        at += len(ids) // 4
                        held += len(ids) if with_ids else 100
                        if held > 4 << 20:
                            yield _rows(rows, with_ids)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows, with_ids)

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = shards.select("path", before.cast("long").alias("base")).repartition(parts)
    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.binary())] * with_ids
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, tokenizer_path("byte_bpe_50k.json"), fresh_path(spark, "token-files")))
