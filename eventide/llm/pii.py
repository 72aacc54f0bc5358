"""Personal data: candidate spans, boosted trees over format and context features, calibrated redaction.

Everything runs on Spark's own functions and without a shuffle. Four base kinds are found by their patterns
and checks and always kept. High-recall generators then propose further spans, which may overlap: tokens
that could be credentials, values of any form after key words, groups of digits that could be identifiers (also with up
to three separators between digits), and mail addresses spelled out. Each
gets format features (lengths, character classes, digit runs, check digit) and context features (what
stands before it); boosted trees score it, compiled to CASE expressions; a threshold per generator,
calibrated on held-out rows for precision, selects spans. A span that overlaps a base span or one chosen
before it is left out.

The trees are fitted on what the generators cut from SAMPLE made-up texts and a quarter more of known kind
(``training_rows``), with features from the same expressions. Positions are code points, ends exclusive. Null texts are empty and have no
spans. Repeated rows and ids are all kept. An empty table gives an empty result.

Time is linear in the text, whatever it holds (but for sorting its spans). Patterns start only where a run of their
characters starts, or where the last match ended. Places, the text before a candidate, overlaps and what is left
between redacted spans come from scans (``_scan``), which append to blocks of bounded size and never look back into the text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting

SAMPLE = 6000
PRECISION = 0.99

# The contract's kinds and patterns; the starts and possessive forms give the same matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
# What every match of IP holds, every match of CARD, GROUPS or WIDE, and every match of KEYED; texts without it are spared these.
DOTTED = r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"
SEVEN = r"[0-9](?:[ ().-]{0,4}+[0-9]){6}"
KEYS_END = r"""[dtnyhDTNYH]["']?\s{0,3}[=:]|[Rr][Ee][Rr]\s"""
# Generators of further candidates.
TOKEN = r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9]|AKIA|ASIA|gh[po]_|sk-|xox[bp]-)[A-Za-z0-9_/+-]{16,}+"
GROUPS = r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[ .-]{0,3}+[0-9](?:[ ().-]?+[0-9]){4,}+|\(?[0-9](?:[ ().-]?+[0-9]){6,}+)[A-Za-z]?+"  # those that end in a letter are dropped
WIDE = r"(?<![0-9A-Za-z+.-])\(?[0-9](?:[ ().-]{0,3}+[0-9]){6,}+[A-Za-z]?+"
KEYED = r"""(?i)(?<![a-z])(?:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|secret[_-]?key|auth)["']?\s{0,3}[=:]|bearer\s)\s{0,3}(?:"[^"\n]++"|'[^'\n]++'|[^\s"'<>,;]++)"""
KEYED_VALUE = r"""(?i)^(?:[a-z_-]+["']?\s*[=:]|bearer\s)\s*["']?(.*?)["']?$"""
SPELLED = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++ ?[\[(] ?at ?[\])] ?[\p{L}0-9-]++(?: ?[\[(] ?dot ?[\])] ?[\p{L}0-9-]++)++"
MORE = {"secret": (TOKEN,), "value": (KEYED,), "identifier": (GROUPS, WIDE), "spelled": (SPELLED,)}
DOMAINS = "com|org|net|edu|gov|mil|int|info|io|dev|app|ai|au|br|ca|ch|cn|de|es|eu|fr|in|it|jp|nl|pl|ru|uk|us"  # fixed values: common top-level domains
BEFORE = 28  # characters before a candidate that features look at
BLOCK = 256
PIECE = 256

FEATURES = {
    "n": "length(v)",
    "digits": "length(v) - length(translate(v, '0123456789', ''))",
    "upper": "length(regexp_replace(v, '[^A-Z]', ''))",
    "lower": "length(regexp_replace(v, '[^a-z]', ''))",
    "hexes": "length(regexp_replace(v, '[^0-9a-f]', ''))",
    "vowels": "length(regexp_replace(v, '[^aeiouAEIOU]', ''))",
    "runs": "size(split(v, '[0-9]+')) - 1",
    "seps": "length(regexp_replace(v, '[A-Za-z0-9]', ''))",
    "luhn": "int(coalesce(luhn_check(regexp_replace(v, '[^0-9]', '')), false))",
    "akia": "int(v rlike '^(AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-)')",
    "ssn": "int(v rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$')",
    "given": r"""int(b rlike '(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer)["\']?\\s*[=:]?\\s*["\']?$')""",
    "named": r"int(b rlike '(?i)(ssn|social security|passport|account|iban|phone|tel|call|mobile|fax)[a-z ]{0,12}[.:#]?\\s*$')",
    "quoted": r"""int(b rlike '["\'=:]\\s*$')""",
    "assigned": r"""int(b rlike '=\\s*["\']?$')""",
    "marked": r"""int(b rlike '["\']$')""",
    "domain": rf"int(v rlike '(?i)[\\])] ?({DOMAINS})$')",
    "blank": r"int(v rlike '(?i)^(none|null|nil|true|false|yes|no|undefined|[*.x]+|[$%{\\x5B(&].*)$')",
}


SPAN = "struct<kind:string,start:int,end:int>"
FOUND = "struct<kind:string,start:int,end:int,v:string,b:string>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _scan(xs: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What step(state, x) -> (state, out) gives out for each x in order, as an array of the SQL type kind.

    An array grows by a copy, so outputs are appended to blocks of BLOCK, and those to the whole: BLOCK / 2 + n / (2 * BLOCK ** 2)
    copied pointers for each of n elements.
    """

    def one(acc: Column, x: Column) -> Column:
        def grown(pair: Column) -> Column:
            return F.struct(pair["s"].alias("s"), F.array_append(acc["o"], pair["o"]).alias("o"))

        after, out = step(acc["s"], x)
        return _let(F.struct(after.alias("s"), out.alias("o")), grown)

    def block(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["s"].alias("s"), _none(kind).alias("o")), one)
        return _let(done, lambda r: F.struct(r["s"].alias("s"), F.array_append(acc["o"], r["o"]).alias("o")))

    def blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))
        return F.flatten(F.aggregate(cut, F.struct(zero.alias("s"), _none(f"array<{kind}>").alias("o")), block)["o"])

    return _let(xs, blocks)


def _spans(text: Column, pattern: str, kind: str) -> Column:
    """array<FOUND> of the matches of pattern, each with the BEFORE characters before it as b."""

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        before = F.right(F.concat(state["tail"], x["p"]), F.lit(BEFORE))
        after = F.struct(end.alias("at"), F.right(F.concat(before, x["m"]), F.lit(BEFORE)).alias("tail"))
        return after, F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("v"), before.alias("b"))

    def located(found: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        zipped = F.zip_with(pieces, found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        return _scan(zipped, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, FOUND)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, located(found)).otherwise(_none(FOUND)))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _gated(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(_none(FOUND))


def base_spans(text: Column) -> Column:
    """The four base kinds, kinds in order, then by start."""
    # leading zeros count for nothing; what remains has three digits at most before it is read as a number
    ip_fits = lambda s: F.forall(F.split(s["v"], "\\."), lambda o: F.length(F.ltrim(o, F.lit("0"))).between(0, 3) & (F.substring(F.concat(F.lit("0"), o), -4, 4).cast("int") <= 255))
    card_fits = lambda s: F.length(s["v"]).between(13, 37) & F.length(_digits(s["v"])).between(13, 19) & F.call_function("luhn_check", _digits(s["v"]))
    phone_fits = lambda s: F.length(_digits(s["v"])).between(9, 15)
    return F.concat(
        _gated(text.contains("@"), _spans(text, EMAIL, "email")),
        _gated(text.rlike(DOTTED), F.filter(_spans(text, IP, "ip"), ip_fits)),
        _gated(text.rlike(SEVEN), F.filter(_spans(text, CARD, "card"), card_fits)),
        _gated(text.contains("+"), F.filter(_spans(text, PHONE, "phone"), phone_fits)),
    )


def candidates(text: Column) -> Column:
    """Spans proposed beyond the base kinds."""

    def value(s: Column) -> Column:
        # the value's place in the match is that after the key word, and before a closing quote
        def placed(v: Column) -> Column:
            end = s["end"] - F.when(s["v"].rlike("[\"']$"), 1).otherwise(0)
            before = s["v"].substr(F.lit(1), end - F.length(v) - s["start"])
            return F.struct(s["kind"].alias("kind"), (end - F.length(v)).alias("start"), end.alias("end"), v.alias("v"), F.right(F.concat(s["b"], before), F.lit(BEFORE)).alias("b"))

        return _let(F.regexp_extract(s["v"], KEYED_VALUE, 1), placed)

    keyed = _gated(text.rlike(KEYS_END), F.transform(_spans(text, KEYED, "value"), value))
    spelled = _gated(text.rlike("[\\[(] ?at ?[\\])]"), _spans(text, SPELLED, "spelled"))
    groups = _gated(text.rlike(SEVEN), F.concat(_spans(text, GROUPS, "identifier"), _spans(text, WIDE, "identifier")))
    return F.concat(_spans(text, TOKEN, "secret"), F.filter(keyed, lambda s: s["end"] > s["start"]), F.filter(groups, lambda s: ~s["v"].rlike("[A-Za-z]$")), spelled)


def training_rows(n: int = SAMPLE, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(kind, text before, candidate, label): made-up candidates, personal or not, of each generator."""
    r = random.Random(seed)
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    syllables = ["tion", "an", "er", "the", "re", "heit", "ung", "que", "ment", "ción", "ing", "ver", "os", "eau"]
    words = lambda k: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(k))
    digit, hexa, alnum = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    mixed = alnum + "abcdefghijklmnopqrstuvwxyz"
    keys = ["password=", "password: ", 'token = "', "token=", "api_key: ", "secret=", "passwd=", "Bearer ", 'access_key="']
    names = ["ssn ", "SSN: ", "call ", "phone: ", "tel. ", "account no. ", "passport ", "mobile "]
    out = []
    for _ in range(n):
        plain = words(3) + " "
        what = r.randrange(14)
        if what == 0:
            out.append(("secret", plain + r.choice(keys), pick(hexa, r.choice([16, 18, 24, 32, 40, 64])), 1))
        elif what == 1:
            out.append(("secret", plain, "AKIA" + pick(alnum, 16), 1))
        elif what == 2:
            out.append(("secret", plain + r.choice(keys), pick(mixed, r.randint(16, 48)), 1))
        elif what == 3:
            out.append(("secret", plain, r.choice(["ghp_", "sk-"]) + pick(mixed, r.randint(24, 40)), 1))
        elif what == 4:
            out.append(("secret", plain, words(4).replace(" ", r.choice("-_/")) + pick(digit, r.randint(1, 4)), 0))
        elif what == 5:
            out.append(("secret", plain, pick(digit, r.randint(16, 24)), 0))
        elif what == 6:
            out.append(("secret", plain, "/".join(words(1) for _ in range(r.randint(3, 6))) + f"/{r.randint(1, 2030)}", 0))
        elif what == 7:
            out.append(("secret", plain, pick(hexa, r.choice([16, 32, 40])), 0))
        elif what == 8:
            out.append(("identifier", plain + r.choice(names), r.choice(["{}-{}-{}", "({}) {}-{}"]).format(pick(digit, 3), pick(digit, r.choice([2, 3])), pick(digit, 4)), 1))
        elif what == 9:
            out.append(("identifier", plain, f"{pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}", 1))
        elif what == 10:
            out.append(("identifier", plain, r.choice([pick(digit, r.randint(7, 20)), f"{r.randint(1900, 2030)}-{pick(digit, 2)}-{pick(digit, 2)}", " ".join(pick(digit, r.randint(1, 4)) for _ in range(r.randint(4, 8)))]), 0))
        elif what == 11:
            out.append(("identifier", plain, ".".join(pick(digit, r.randint(1, 3)) for _ in range(4)), 0))
        elif what == 12:
            out.append(("spelled", plain, f"{words(1)}.{pick(digit, 2)} [at] {words(1)} [dot] {r.choice(['com', 'org', 'net'])}", 1))
        else:
            # an address ends in a top-level domain; other words in such brackets are none
            ends = r.random() < 0.5
            out.append(("spelled", plain, f"{words(1)} (at) {words(1)} (dot) {r.choice(DOMAINS.split('|')) if ends else 'x' + words(1)}", int(ends)))
    plainer = [k for k in keys if k != "Bearer "]
    for _ in range(n // 4):
        plain, what = words(3) + " ", r.randrange(8)
        if what < 3:
            v = r.choice([words(1).replace(" ", "")[:10] + pick(digit, r.randint(1, 4)), pick(digit, r.randint(4, 8)), pick(mixed, r.randint(4, 15)), pick(mixed, 5) + r.choice("!@#$%^&*") + pick(mixed, 4)])
            out.append(("value", plain + r.choice(plainer), v, 1))
        elif what < 5:
            out.append(("value", plain + r.choice(["password=", "token=", "secret=", 'password = "', "passwd=", 'api_key="', "pwd='"]), words(r.choice([1, 2, 3])).replace(" ", ""), 1))
        elif what == 5:
            out.append(("value", plain + r.choice(["password: ", "token: ", "secret: ", "auth: "]), words(1), 0))
        elif what == 6:
            out.append(("value", plain + r.choice(plainer), r.choice(["None", "null", "true", "false", "****", "xxxx", "${PASS}", "%s", "{token}", "$1"]), 0))
        else:
            gap = lambda: r.choice([" - ", ". ", " ", "-", " -", ") "])
            a, b, c = pick(digit, 3), pick(digit, r.choice([2, 3])), pick(digit, 4)
            if r.random() < 0.5:
                out.append(("identifier", plain + r.choice(names), f"{a}{gap().replace(')', ' ')}{b}{gap().replace(')', ' ')}{c}", 1))
            elif r.random() < 0.5:
                out.append(("identifier", plain, f"({a}) {b}-{c}", 1))
            else:
                out.append(("identifier", plain, f"{r.randint(1900, 2030)}. {r.randint(1, 500)}. {r.randint(1900, 2030)}", 0))
    return out


def _featured(c: str) -> str:
    """A struct of the features of candidate c, a struct with v and b, as a SQL expression."""
    fields = []
    for name, e in FEATURES.items():
        fields.append(f"double({_bind(e, c)}) AS {name}")
    return f"struct({', '.join(fields)})"


def _bind(expression: str, c: str) -> str:
    return re.sub(r"(?<![A-Za-z'\[_\\])\b([vb])\b(?=[,) ])", lambda m: f"{c}.{m[1]}", expression)


@cache
def _models(app: str) -> dict[str, tuple[boosting.Boosted, float]]:
    """Per generator its trees and threshold: fitted on one half of the made-up rows, calibrated on the other."""
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(b + v + (b[-1] if b[-1] in "\"'" else "") + " end", len(b), len(b) + len(v), y) for _, b, v, y in training_rows()], "t string, low int, high int, y int")
    # what the generators cut from the rows, whatever the corpus; parts of a made-up candidate have its label
    cut = rows.select("t", "low", "high", "y", F.explode(candidates(F.col("t"))).alias("s")).where("s.start < high and low < s.end")
    got = cut.select(F.col("s.kind").alias("kind"), "y", F.expr(_featured("s")).alias("f")).collect()
    out = {}
    for kind in MORE:
        x = np.array([list(r["f"]) for r in got if r["kind"] == kind], float)
        y = np.array([r["y"] for r in got if r["kind"] == kind], float)
        half = len(x) // 2
        model = boosting.fit(x[:half], y[:half], trees=20, depth=3)
        out[kind] = (model, boosting.threshold(model.margin(x[half:]), y[half:], PRECISION))
    return out


def _apart(base: Column, more: Column) -> Column:
    """Those of more (array<SPAN>) that overlap neither a base span nor one before them that stays; longer ones first."""
    mark = lambda rank: lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), (-s["end"]).alias("back"), s["kind"].alias("kind"))
    marks = F.array_sort(F.concat(F.transform(base, mark(0)), F.transform(more, mark(1))))

    def behind(reached: Column, x: Column) -> tuple[Column, Column]:
        is_base = x["rank"] == 0
        return F.when(is_base, F.greatest(reached, -x["back"])).otherwise(reached), F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["back"]).alias("end"), is_base.alias("base"), (reached > x["start"]).alias("hit"))

    def ahead(next_base: Column, x: Column) -> tuple[Column, Column]:
        free = ~x["base"] & ~x["hit"] & (next_base >= x["end"])
        return F.when(x["base"], x["start"]).otherwise(next_base), F.when(free, F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def greedy(last: Column, x: Column) -> tuple[Column, Column]:
        free = x["start"] >= last
        kind = F.when(x["kind"] == "value", "secret").otherwise(x["kind"])
        return F.when(free, x["end"]).otherwise(last), F.when(free, F.struct(kind.alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    there = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    seen = _scan(marks, F.lit(0), behind, "struct<kind:string,start:int,end:int,base:boolean,hit:boolean>")
    free = there(_scan(F.reverse(seen), F.lit(2**31 - 1), ahead, SPAN))
    return F.array_sort(there(_scan(F.reverse(free), F.lit(0), greedy, SPAN)))


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with two columns more: base and spans, arrays of (kind, start, end), base spans first in spans.

    Columns of docs by these names are replaced, and _t, _base and _more are dropped.
    """
    spark = docs.sparkSession
    models = _models(spark.sparkContext.applicationId)
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.withColumn("_t", text).withColumn("_base", base_spans(F.col("_t"))).withColumn("_more", candidates(F.col("_t")))
    tests = []
    for kind, (model, least) in models.items():
        if np.isfinite(least):
            tests.append(f"s.kind = '{kind}' AND ({model.sql([f's.f.{n}' for n in FEATURES])}) >= {least!r}D")
    held = held.withColumn("_more", F.expr(f"transform(_more, s -> struct(s.kind AS kind, s.start AS start, s.end AS end, {_featured('s')} AS f))"))
    held = held.withColumn("_more", F.expr(f"filter(_more, s -> {' OR '.join(f'({t})' for t in tests) or 'false'})"))
    spans = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    held = held.withColumn("base", spans(F.col("_base"))).withColumn("_more", spans(F.col("_more")))
    more = _let(F.col("_more"), lambda m: F.when(F.size(m) > 0, _apart(F.col("base"), m)).otherwise(_none(SPAN)))
    return held.withColumn("spans", F.concat("base", more)).drop("_t", "_base", "_more")


def _replaced(text: Column, spans: Column) -> Column:
    """text with the union of spans replaced by their kinds; each run has the kind of its first span."""

    def joined(state: Column, x: Column) -> tuple[Column, Column]:
        end, new = -x["back"], x["start"] >= state["end"]
        run = F.struct(F.when(new, x["kind"]).otherwise(state["kind"]).alias("kind"), F.when(new, x["start"]).otherwise(state["start"]).alias("start"), F.greatest(state["end"], end).alias("end"))
        return run, F.struct(run.alias("run"), new.alias("new"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit("").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    grown = _scan(ordered, zero, joined, f"struct<run:{SPAN},new:boolean>")
    # a run is whole where the next one begins, or nothing follows
    last = lambda g: F.filter(F.zip_with(g, F.slice(g, F.lit(2), F.size(g)), lambda x, y: F.when(F.coalesce(y["new"], F.lit(True)), x["run"])), lambda x: x.isNotNull())

    def built(parts: Column, runs: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            some = F.slice(parts, first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1)
            return F.when(b > a, F.array_join(some, "").substr(a - first * PIECE + 1, b - a)).otherwise("")

        between = F.zip_with(runs, F.concat(F.array(F.lit(0)), F.transform(runs, lambda s: s["end"])), lambda s, at: F.when(s.isNull(), cut(at, F.length(text))).otherwise(F.concat(cut(at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.array_join(between, "")

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _let(parts, lambda p: _let(_let(grown, last), lambda runs: built(p, runs)))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span in the text replaced by its kind in brackets; spans that overlap become one."""
    # columns by place, so that no name of docs meets one used here
    at, schema = docs.columns.index(text_col), docs.columns
    docs = docs.toDF(*(f"c{i}" for i in range(len(schema))))
    text_col = f"c{at}"
    found = find(docs, text_col)
    clean = F.when(F.size("spans") > 0, _replaced(F.col(text_col), F.col("spans"))).otherwise(F.col(text_col))
    return found.withColumn(text_col, clean).select(*docs.columns).toDF(*schema)


def op10_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs)
    line = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(n(k) for k in KINDS), F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"))
