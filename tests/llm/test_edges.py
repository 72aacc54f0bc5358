"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every query and stage."""

import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from eventide.llm import queries

LONG = "word another third " * 20000 + "z" * 5000
NAMES = sorted(n for n in queries.queries())


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(1, "a text of words"), (1, "a text of words"), (2, None), (3, ""), (4, " \n\t "), (None, "no id here"), (None, None), (5, LONG), (6, "other"), (6, "texts"), (7, "a text of words"), (8, "x" * 900), (9, "x" * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(7).alias(c) for c in ("fp", "node", "hull", "tie", "doc", "data", "base", "spans", "_t", "pattern", "quality", "same", "lanes", "u", "v", "component", "c0")))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    items = [(1, "what is this thing here called"), (2, None), (3, ""), (None, "one two"), (1, "what is this thing here called")]
    spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).write.parquet(f"{folder}/benchmark.parquet")
    pages = [(1, "http://a.com/x", "<article><p>Hi there.</p></article>"), (2, None, None), (3, "", ""), (4, "http://a.com/x", "<div"), (5, "nonsense", "plain"), (None, "http://b.com", "<p>x" * 3000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("at", F.lit(3)).withColumn("headers", F.lit("h")).write.parquet(f"{folder}/pages.parquet")
    vectors = [(0, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, [0.25, 0.0], 2), (50, None, 1), (100, [None, 1.0], 1), (150, [1.0, 0.5, 0.5], None), (200, [], 1), (None, [1.0, 1.0], 1), (0, [0.5, 0.25], 1), (250, [float("nan"), 1.0], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("block", F.lit("b")).write.parquet(f"{folder}/embeddings.parquet")
    labels = [(i, i, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, None, None), (3, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("t")).withColumn("key", F.lit(4)).write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "pages", "embeddings", "labels"):
        spark.read.parquet(f"{odd}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    got = queries.queries()[name](spark, odd).collect()
    if name == "op12_hard_negatives":  # rows without a label or whole vector take no part
        assert {r["anchor_id"] for r in got} <= {0, 200}
    elif name != "op4_decontamination":
        assert len(got) == (6 if name in ("op6_revisits", "op9_main_text") else 13)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, empty, name):
    assert queries.queries()[name](spark, empty).count() == 0


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_rows(spark, odd, empty, stage):
    name, fn = corpus_pipeline.STAGES[stage]
    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        got = fn(spark, docs, folder)
        assert stage == len(corpus_pipeline.STAGES) - 1 or got.columns == docs.columns
        assert got.count() <= docs.count()
    if name == "near duplicates":
        left = sorted((r["doc_id"] or 0, r["text"] or "") for r in fn(spark, spark.read.parquet(f"{odd}/documents.parquet"), odd).collect() if r["doc_id"] != 5)
        assert left == [(0, ""), (0, "no id here"), (1, "a text of words"), (2, ""), (3, ""), (4, " \n\t "), (6, "other"), (6, "texts"), (8, "x" * 900)]


def kept_by_hand(docs: dict[int, str]) -> list[int]:
    """The documents that pass the quality rules, by a plain EM over each document's votes."""
    from test_operators import quality_by_hand

    votes, good = {}, {}
    for i, t in docs.items():
        n, chars, symbols, lines, repeats = quality_by_hand(t)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        letters, capitals = len(re.findall(r"[A-Za-z]|[^\x00-\x7f]", t)), len(re.findall("[A-Z]", t))
        # bytes C0-FF begin a code point outside ASCII; continuation bytes are not counted
        shares = [(symbols / max(n, 1), 0.05, 0.25), (letters / max(chars, 1), 0.93, 0.70), (repeats / max(n, 1), 0.10, 0.30), (lines / max(len([x for x in t.split("\n") if x.strip(" \t\n\r\v\f")]), 1), 0.20, 0.50), (capitals / max(chars, 1), 0.10, 0.30), (len(set(words)) / max(n, 1), 0.45, 0.12), (chars / max(n, 1), 7.0, 10.0), (chars / max(n, 1), 3.8, 3.2), (t.count("!") / max(n, 1), 0.05, 0.30)]
        votes[i] = [(1 if x < g else 2 if x > b else 0) if g < b else (1 if x > g else 2 if x < b else 0) for x, g, b in shares]
        good[i] = (1 + votes[i].count(1)) / (2 + votes[i].count(1) + 4 * votes[i].count(2))
    for _ in range(200):
        prior = [sum(good.values()) + 1, sum(1 - p for p in good.values()) + 1]
        rates = []
        for side in (0, 1):
            weight = {i: p if side == 0 else 1 - p for i, p in good.items()}
            counts = [[0.5 + sum(w for i, w in weight.items() if votes[i][r] == v) for v in range(3)] for r in range(9)]
            rates.append([[x / sum(c) for x in c] for c in counts])
        for i, v in votes.items():
            log = [math.log(prior[s] / sum(prior)) + sum(math.log(rates[s][r][x]) for r, x in enumerate(v)) for s in (0, 1)]
            good[i] = 1 / (1 + math.exp(min(500, max(-500, log[1] - log[0]))))
    base = {i: quality_by_hand(t) for i, t in docs.items()}
    return sorted(i for i in docs if base[i][0] >= 50 and 100 * base[i][4] <= 50 * base[i][0] and good[i] >= 0.05)


def test_pipeline_by_hand(spark):
    """All stages by brute force on the smallest tables: what stays, its redacted texts, and their tokens by the library."""
    from conftest import DATA
    from eventide.llm import bpe, pii
    from test_operators import contaminated_by_hand, spans_by_hand

    folder = f"{DATA}/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    kept = kept_by_hand(docs)
    grams = {i: set(zip(*(docs[i].encode().lower().split()[k:] for k in range(5)))) for i in kept}
    up = {i: i for i in kept}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, a in enumerate(kept):
        for b in kept[:n]:
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    single = [(i, docs[i]) for i in kept if find(i) == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    dirty = {x[0] for x in contaminated_by_hand(single, items)}
    want = {i: t for i, t in single if i not in dirty}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(want)

    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(sorted(want.items()), "doc_id long, text string")).collect()}
    lib = Tokenizer.from_file(bpe.tokenizer_path("word_bpe_49k.json"))
    for i, t in want.items():
        spans = sorted((s["start"], s["end"], s["kind"]) for s in found[i])
        assert {(s, e) for _, s, e in spans_by_hand(t)} <= {(s, e) for s, e, _ in spans}
        clean, at, end = [], 0, 0
        for s, e, kind in spans:
            if s >= end:
                clean += [t[at:s], f"[{kind.upper()}]"]
            at = end = max(end, e)
        clean = "".join([*clean, t[at:]])
        ids = lib.encode(clean, add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_odd_rows_have_defined_values(spark, odd):
    """Values, not only counts, for null, empty, repeated and long rows."""
    q = {n: queries.queries()[n](spark, odd).collect() for n in ("op1_repeats", "op5_licenses", "op7_quality", "op8_bpe_automaton", "op10_pii")}
    of = lambda n, i: [r for r in q[n] if r["doc_id"] == i]
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"]) for i in (2, 3, 8, 9) for r in of("op1_repeats", i)] == [(0, 0, 0), (0, 0, 0), (900, 900, 1), (900, 900, 1)]
    assert all((r["n_words"], r["labels"], r["score"], r["first_word"]) == (0, "", 0.0, None) for i in (2, 3, 4) for r in of("op5_licenses", i))
    assert all((r["n_words"], r["base_failed"], r["kept"]) == (0, True, False) for i in (2, 3, 4) for r in of("op7_quality", i))
    assert all((r["n_tokens"], r["decoded_sha256"]) == (0, hashlib.sha256(b"").hexdigest()) for i in (2, 3, 4) for r in of("op8_bpe_automaton", i))
    assert len(of("op8_bpe_automaton", 1)) == 2 and len({r["ids_sha256"] for r in of("op8_bpe_automaton", 1) + of("op8_bpe_automaton", 7)}) == 1
    assert all((r["spans"], r["n_email"], r["base_sha256"]) == ("", 0, hashlib.sha256(b"").hexdigest()) for i in (2, 3) for r in of("op10_pii", i))
    assert queries.queries()["op4_decontamination"](spark, odd).count() == 0


def test_ascii_words_are_encoded_as_the_library_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    from eventide.llm.tokenfile import ByteEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    signs = "".join(map(chr, range(33, 127)))
    texts = [signs, " ".join(signs), f"a{signs} b\n{signs[::-1]}", *(f"x{c} {c}y é{c}\n{c}" for c in signs)]
    mine, whole = ByteEncoder(path), Tokenizer.from_file(path)
    for t in texts:
        assert [int.from_bytes(b, "little") for b in (mine.encode(t)[i : i + 4] for i in range(0, len(mine.encode(t)), 4))] == whole.encode(t, add_special_tokens=False).ids
