"""BPE encoding and decoding by a deterministic automaton compiled from the merges.

Compilation starts from one state for each base symbol, with arcs to all of them, and applies the merges in order by a
gadget each. The gadget of merge (a, b) -> c makes the state of c as a copy of b's, takes arc b from a's state, and gives
an arc c to every state that still has arc a; where a's state has no arc b any more, the merge never happens and makes nothing.
All arcs with one label lead to one state, so the automaton is a table of bits: which state has which arc. When all
gadgets are done, states with equal arcs are merged into one, and labels with equal sources, which leaves a small table. Its size
is bounded by the vocabulary's. It is compiled once, on the driver, and sent to the workers.

A text is a right encoding if and only if it is a path of this automaton, so encoding a pre-split word needs no merging
and no merge is kept: transitions over the word's symbols propose the tokens that end at each place, longest first, and
the one with an arc from the token before it is the only one that fits. Decoding emits arc labels.

Words are bounded only by the text; each is encoded whole in time linear in its length. Null and empty texts have no
tokens and decode to the empty text. Repeated rows and ids are each given a result; other columns are left aside;
an empty table gives an empty result. Tokenizer files of other settings than those built here are refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

START = -1
CACHE = 200_000  # words kept by a worker in each of two generations
TABLE = 500_000  # transitions kept by a worker
LONG = 48  # longer words are not kept
SPLIT_ONLY = re.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\p{White_Space}+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


class Automaton:
    """The automaton of a merge list; symbols are bytes, or bytes + 256 where they end a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.size = max(vocab.values()) + 1
        self.length, self.labels = [1] * self.size, [""] * self.size
        for token, i in vocab.items():
            self.labels[i] = token
        symbols: dict[int, tuple[int, ...]] = {}
        for b, ch in enumerate(byte_symbols()):
            for sym, token in ((b, ch), (b + 256, ch + suffix)):
                if token in vocab and (sym < 256 or suffix):
                    symbols[vocab[token]] = (sym,)
        self._compile([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], symbols)
        for token, seq in symbols.items():
            self.length[token] = len(seq)
        self._table(symbols)
        self.arcs = _Arcs(self)

    def _compile(self, merges: list[tuple[int, int, int]], symbols: dict[int, tuple[int, ...]]) -> None:
        """Apply a gadget for each merge in order, then merge equal states and equal labels; symbols gets the tokens that merges make."""
        state = {token: n for n, token in enumerate([START, *(t for t, seq in symbols.items() if seq[0] < 256)])}
        column = {token: n for n, token in enumerate(symbols)}
        # by eight states: a byte for each label, a bit for each state that has it; what no state reaches takes no memory
        arcs = np.zeros(((len(state) + len(merges) + 7) // 8, len(column) + len(merges)), np.uint8)
        arcs[: (len(state) + 7) // 8, : len(column)] = np.packbits(np.ones(len(state), bool), bitorder="little")[:, None]
        for a, b, c in merges:
            at = state.get(a)
            if at is None or b not in column or not arcs[at >> 3, column[b]] >> (at & 7) & 1:
                continue  # no path a, b is left by the merges before it
            known, column[c] = len(column), len(column)
            symbols[c] = symbols[a] + symbols[b]
            if b in state:
                old, new = state[b], state.setdefault(c, len(state))
                arcs[new >> 3, :known] |= (arcs[old >> 3, :known] >> (old & 7) & 1) << (new & 7)
            arcs[at >> 3, column[b]] &= 255 ^ 1 << (at & 7)
            used = (len(state) + 7) // 8
            arcs[:used, known] = arcs[:used, column[a]]
        arcs = arcs[: (len(state) + 7) // 8, : len(column)]
        sources: dict[bytes, int] = {}
        self.arc_class = [0] * self.size
        names = list(column)
        for first in range(0, len(names), 1024):
            for token, row in zip(names[first : first + 1024], np.ascontiguousarray(arcs[:, first : first + 1024].T)):
                self.arc_class[token] = sources.setdefault(row.tobytes(), len(sources))
        packed = np.frombuffer(b"".join(sources), np.uint8).reshape(len(sources), -1)
        same: dict[bytes, int] = {}
        self.state_class = [0] * (self.size + 1)
        tokens = list(state)
        for first in range(0, packed.shape[1], 128):
            rows = np.packbits(np.unpackbits(packed[:, first : first + 128], axis=1, bitorder="little").T, axis=1, bitorder="little")
            for token, row in zip(tokens[8 * first : 8 * (first + 128)], rows):
                self.state_class[token + 1] = same.setdefault(row.tobytes(), len(same))
        self.rows = list(same)  # by class of states: a bit for each class of labels

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "arcs"}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.arcs = _Arcs(self)

    def _table(self, symbols: dict[int, tuple[int, ...]]) -> None:
        """Transitions over symbols; each state's longest token that ends there, each token's next shorter one."""
        self.next: dict[int, int] = {}
        parent, ends = [(0, 0)], [START]
        for token, seq in sorted(symbols.items()):
            at = 0
            for s in seq:
                to = self.next.get(at * 512 + s)
                if to is None:
                    to = self.next[at * 512 + s] = len(parent)
                    parent.append((at, s))
                    ends.append(START)
                at = to
            ends[at] = token
        self.back = [0] * len(parent)
        self.longest, self.shorter = list(ends), [START] * self.size
        depth = [0] * len(parent)
        for i in range(1, len(parent)):
            depth[i] = depth[parent[i][0]] + 1
        for i in sorted(range(1, len(parent)), key=depth.__getitem__):
            up, s = parent[i]
            self.back[i] = self.step(self.back[up], s) if up else 0
            below = self.longest[self.back[i]]
            if ends[i] == START:
                self.longest[i] = below
            else:
                self.shorter[ends[i]] = below

    def step(self, state: int, symbol: int) -> int:
        at = state
        while (to := self.next.get(at * 512 + symbol)) is None:
            if not at:
                return 0
            at = self.back[at]
        if at != state and len(self.next) < TABLE:
            self.next[state * 512 + symbol] = to
        return to

    def arc(self, x: int, y: int) -> bool:
        """Whether the state after token x has an arc labelled y."""
        at = self.arc_class[y]
        return bool(self.rows[self.state_class[x + 1]][at >> 3] >> (at & 7) & 1)

    def encode(self, symbols: list[int]) -> list[int]:
        last, state = [START], 0
        size, arcs, length, shorter, get = self.size, self.arcs, self.length, self.shorter, self.next.get
        for n, s in enumerate(symbols, 1):
            to = get(state * 512 + s)
            state = self.step(state, s) if to is None else to
            token = self.longest[state]
            while not arcs[(last[n - length[token]] + 1) * size + token]:
                token = shorter[token]
            last.append(token)
        out, n = [], len(symbols)
        while n:
            out.append(last[n])
            n -= length[last[n]]
        return out[::-1]


class _Arcs(dict):
    """Arcs read from the table so far, by one key."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, key: int) -> bool:
        if len(self) > 600_000:
            self.clear()
        x, y = divmod(key, self.automaton.size)
        value = self[key] = self.automaton.arc(x - 1, y)
        return value


class WordEncoder(dict):
    """A tokenizer file of the word kind: NFC, lower case, words with an end mark.

    As a mapping: from what stands between white space to id bytes, which stay for later.
    """

    def __init__(self, path: str, automaton: Automaton | None = None):
        super().__init__()
        self.older: dict[str, bytes] = {}
        spec = json.load(open(path, encoding="utf-8"))
        model, steps = spec["model"], [spec[k] for k in ("normalizer", "pre_tokenizer", "decoder")]
        pattern = self._pattern(steps)
        if pattern is None or model["type"] != "BPE" or not model["end_of_word_suffix"] or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: only BPE with word ends, NFC, lower case and a splitting pattern is built here")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = automaton or Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        if any(t.get(k) for t in spec["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word")) or not all(t["content"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens are only built here as they stand in the text")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = list(self.automaton.labels)
        for token, i in self.special.items():
            self.labels += [""] * (i + 1 - len(self.labels))
            self.labels[i] = token
        self.outer = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(pattern)

    @staticmethod
    def _pattern(steps: list) -> str | None:
        """The file's splitting pattern, if its other settings are those that are built here."""
        try:
            (normal, before, decoder), kinds = steps, lambda x, k: [y["type"] for y in x[k]]
            split, bytewise = before["pretokenizers"]
            spaces = normal["normalizers"][1]
            fits = kinds(normal, "normalizers") == ["NFC", "Replace", "Lowercase"] and (spaces["pattern"], spaces["content"]) == ({"Regex": r"\s+"}, " ") and decoder is None
            fits &= (split["type"], split["behavior"], split["invert"], bytewise["type"], bytewise["add_prefix_space"], bytewise["use_regex"]) == ("Split", "Removed", True, "ByteLevel", False, False)
            return split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}") if fits else None
        except (KeyError, TypeError, ValueError):
            return None

    def __missing__(self, chunk: str) -> bytes:
        value = self.older.pop(chunk, None)
        if value is None:
            value = self._encode(chunk)
        if len(chunk) <= LONG:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[chunk] = value
        return value

    def _encode(self, chunk: str) -> bytes:
        ids: list[int] = []
        for word in self.words.findall(chunk):
            data = word.encode("utf-8", "surrogatepass")
            ids += self.automaton.encode([*data[:-1], data[-1] + 256])
        return np.array(ids, "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split also splits at four control characters that are no white space here
        chunks = text.split() if not SPLIT_ONLY.search(text) else WHITE.split(text)
        return b"".join(map(self.__getitem__, chunks))

    def encode(self, text: str) -> np.ndarray:
        if not any(token in text for token in self.special):
            return np.frombuffer(self._plain(text), "<u4")
        parts, at = [], 0
        for m in self.outer.finditer(text):
            parts += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return np.frombuffer(b"".join([*parts, self._plain(text[at:])]), "<u4")

    def decode(self, ids) -> str:
        """The labels of the arcs along ids, special tokens included."""
        return " ".join(map(self.labels.__getitem__, ids))


_LOADED: dict[str, WordEncoder] = {}


def encoder(path: str, held: Broadcast | None = None) -> WordEncoder:
    """This process's encoder of a tokenizer file; held has its automaton, which else is compiled here."""
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path, held.value if held else None)
    return _LOADED[path]


def _sent(docs: DataFrame, tokenizer: str) -> Broadcast:
    """The automaton, compiled on the driver; its size is bounded by the vocabulary."""
    return docs.sparkSession.sparkContext.broadcast(encoder(tokenizer).automaton)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids: binary of little-endian 32-bit ids, decoded: string) for each row of docs."""
    held = _sent(docs, tokenizer)

    def run(batch: pa.RecordBatch):
        enc = encoder(tokenizer, held)
        texts = batch.column(1)
        for a in range(0, len(texts), 100):
            ids = [enc.encode(x.as_py() or "") for x in texts[a : a + 100]]
            decoded = [enc.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 100], pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id").cast("long"), F.col(text_col).alias("text")), run, "doc_id long, ids binary, decoded string")


def encode_decode_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what encode_decode gives, made where it is made."""
    held = _sent(docs, tokenizer)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(tokenizer, held)
        rows = []
        for x in batch.column(1):
            ids = enc.encode(x.as_py() or "")
            decoded = enc.decode(ids.tolist())
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col(id_col).alias("doc_id").cast("long"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    return encode_decode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
