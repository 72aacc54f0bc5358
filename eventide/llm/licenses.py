"""License scans: phrases and tags by an Aho-Corasick automaton, expressions by a shunting-yard parser.

A text's words are matched as whole words, so an automaton over the words joined by single spaces finds
every place of every notice phrase in one pass; of notices that overlap the longest counts, and where a phrase
names a family, the version that follows it is read. A second automaton finds identifier tags in the text itself. The
licence expression after a tag is parsed with operator precedence (with, and, or; brackets) into postfix order, whose
size is that of the expression however many ways it leaves open; it is evaluated to whether permissive licences alone
satisfy it, and its identifiers become labels. An expression and a notice of one licence give one label (``label``).

An expression reaches as far as its tokens can follow each other, to the end of its line or the next tag; where what
follows an operator looks like no identifier, the operator is taken as prose. It is malformed if it is
empty, has an operand that is no identifier by form or an operator without operand, or its brackets don't match. Form is not
knowledge: a well-formed identifier outside ``LICENCE`` is a label too and is listed as unknown, and never counts as permissive.
Lists are read: a slash between licences as or, a comma between known ones as and. Fields like "License:" are read where a known licence
follows, as the words also occur in prose.

The score of a document says how sure its labels are: 0 without evidence, 1 for a well-formed expression of known licences
after a tag, 0.9 for a base phrase, 0.7 for an expression with unknown licences or written as a list, 0.6 for other notice phrases
and 0.3 for a malformed expression, the highest of those found. Ties don't occur: labels are a set, in alphabetical order. Null texts are empty: no words, no labels, score 0. Repeated rows and ids are all
kept; other columns are left aside; an empty table gives an empty result. Time is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

# The contract's phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notice phrases of common licences (as words) and the labels they add; {} stands for a version that is read after the phrase.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license": "apache{}",
    "gnu general public license": "gpl{}",
    "gnu lesser general public license": "lgpl{}",
    "gnu library general public license": "lgpl{}",
    "gnu affero general public license": "agpl{}",
    "gnu free documentation license": "gfdl{}",
    "mozilla public license": "mpl{}",
    "eclipse public license": "epl{}",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd-3-clause",
    "bsd 2 clause": "bsd-2-clause",
    "boost software license": "bsl-1.0",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons attribution noderivatives": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0 universal": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
VERSION = re.compile(r" (?:version |v)?([0-9]{1,2})(?: ([0-9]{1,2}))?(?= )| (?:(?!version )[^ ]+ ){1,14}version ([0-9]{1,2})(?: ([0-9]{1,2}))?(?= )")
TAGS = ("spdx-license-identifier:",)
FIELDS = ("license:", "licence:", "license-expression:")
# Identifiers of licences in lower case, by families; a licence may also be given by a reference.
LICENCE = re.compile(
    r"(?:(?:a|l)?gpl|gfdl)-\d\.\d(?:-only|-or-later|\+)?|apache-(?:1\.[01]|2\.0)\+?|(?:mpl|epl|cddl|sspl|busl|mulanpsl|elastic|ofl|ecl|osl|afl|apsl|cpl|ipl|lppl|php|python|psf|zpl|upl|artistic|eupl|odbl|odc-by|pddl|bsl|blueoak|libpng|unicode-dfs|w3c|ms|cecill)-[0-9][0-9.]*[a-z]?(?:-[a-z-]+)?\+?"
    r"|bsd-[0-4]-clause(?:-[a-z-]+)?|0bsd|cc-by(?:-nc)?(?:-sa|-nd)?-\d\.\d(?:-[a-z]{2,3})?|cc0-1\.0|cc-pddc|mit(?:-0|-cmu|-feh|-enna|-wu|-advertising|-festival|-khronos-old|-modern-variant|-open-group|-testregex)?|isc|intel|zlib|unlicense|wtfpl|x11|ncsa|curl|vim|ruby|postgresql|openssl|hpnd|icu|beerware|libpng|psfl?|w3c|ms-[pr]l|cecill-[bc]|unicode-3\.0|json|ftl|ijg|sleepycat|tcl|fsfap|naist-2003|bzip2-1\.0\.\d"
    r"|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+|none|noassertion"
)
EXCEPTION = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.+-]*|[a-z0-9.+-]+-note|[a-z0-9.+-]+-linking[a-z0-9.+-]*|additionref-[a-z0-9.-]+")
#: Whole identifiers of licences that ask for little more than a notice.
PERMISSIVE = re.compile(
    r"apache-(?:1\.[01]|2\.0)\+?|bsd-[0-4]-clause(?:-[a-z-]+)?|0bsd|mit(?:-[a-z0-9-]+)?|isc|zlib|unlicense|cc0-1\.0|cc-by-\d\.\d(?:-[a-z]{2,3})?|x11|ncsa|curl|postgresql|python-[0-9.]+|psfl?|psf-[0-9.]+|bsl-1\.0|upl-1\.0"
    r"|blueoak-1\.0\.0|libpng(?:-2\.0)?|wtfpl|w3c|icu|ftl|unicode-(?:3\.0|dfs-[0-9]+)|hpnd|beerware|php-3\.[0-9]+|zpl-[0-9.]+|ijg|tcl"
)
FORM = re.compile(r"(?:documentref-[a-z0-9.-]+:)?[a-z0-9][a-z0-9.-]*\+?")
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RANK = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*+([()]|[a-z0-9.:+-]++|$|.)", re.M)


def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in {**NOTICES, **BASE}:
        machine.add_word(f" {phrase} ", (phrase.count(" ") + 1, len(phrase), BASE.get(phrase), NOTICES.get(phrase)))
    machine.make_automaton()
    return machine


def tag_automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for tag in (*TAGS, *FIELDS):
        machine.add_word(tag, tag)
    machine.make_automaton()
    return machine


def label(identifier: str) -> str:
    """The label of a licence identifier: that of the contract or of a notice where one means the same licence."""
    if identifier.startswith("apache-2.0"):
        return "apache-2"
    if identifier == "cc0-1.0":
        return "cc0"
    m = re.fullmatch(r"(cc-by(?:-nc)?(?:-sa|-nd)?)-\d\.\d.*", identifier)
    return m[1] if m else identifier


def tokens(text: str, at: int, stop: int | None = None) -> tuple[list[str], bool]:
    """The tokens of the expression in a text in lower case from this place to the end of the line or to stop, and whether it is a list."""
    out: list[str] = []
    depth, listed, last = 0, "", ""
    end = text.find("\n", at, len(text) if stop is None else stop)
    end = (len(text) if stop is None else stop) if end < 0 else end
    for m in TOKEN.finditer(text, at, end):
        t = m[1].rstrip(".:-") if m[1] not in "()" else m[1]
        operand = bool(out) and out[-1] not in RANK and out[-1] != "("  # what came last
        if t == "(" and not operand:
            depth += 1
        elif t == ")" and operand and depth:
            depth -= 1
        elif t in RANK and operand:
            pass
        elif t in ("/", ",") and operand and not depth:
            listed, last = listed + t, t
            out.append("or" if t == "/" else "and")
            continue
        elif t and t not in "()" and t not in RANK and not operand and re.search(r"[0-9a-z]", t):
            exception = bool(out) and out[-1] == "with"
            known = (EXCEPTION if exception else LICENCE).fullmatch(t)
            joined = last in ("/", ",")
            if not known and out and out[-1] in RANK and (joined or not re.search(r"[0-9-]", t)):
                out.pop()  # prose
                break
        else:
            if t in RANK:  # two operators in a row, or none before it
                out.append(t)
            break  # of prose, or a bracket closed that the text opened before
        out.append(t)
        last = t
    if out and out[-1] in RANK and (last in ("/", ",") or stop is not None and end == stop):
        out.pop()  # between two tags, or at the end of a list
    return out, bool(listed) and any(x in RANK for x in out)


def parse(expression: str | list[str]) -> tuple[set[str], list[str], bool]:
    """Identifiers of a licence expression, its postfix form, and whether it is well formed.

    Shunting-yard: operands go to the output, operators wait on a stack until one that binds less tightly comes.
    """
    given = re.findall(r"[()]|[a-z0-9.:+-]+", expression.lower()) if isinstance(expression, str) else expression
    output: list[str] = []
    stack: list[str] = []
    names: set[str] = set()
    sound, operand, held = True, False, 0  # held: operands on the output that no operator has joined

    def apply(op: str) -> None:
        nonlocal sound, held
        if held < 2:
            sound = False
        else:
            output.append(op)
            held -= 1

    for t in given:
        if t in RANK:
            sound &= operand
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[t]:
                apply(stack.pop())
            stack.append(t)
            operand = False
        elif t == "(":
            sound &= not operand
            stack.append(t)
            operand = False
        elif t == ")":
            sound &= operand
            while stack and stack[-1] != "(":
                apply(stack.pop())
            if stack:
                stack.pop()
            else:
                sound = False
            operand = True
        else:
            sound &= not operand
            exception = bool(stack) and stack[-1] == "with"
            if (EXCEPTION if exception else FORM).fullmatch(t):
                if not exception:
                    names.add(t)
            else:
                sound = False
            output.append(t)
            held += 1
            operand = True
    sound &= operand
    while stack:
        op = stack.pop()
        if op == "(":
            sound = False
        else:
            apply(op)
    return names, output, bool(sound and held == 1)


def permissive(postfix: list[str]) -> bool:
    """Whether permissive licences alone satisfy a well-formed expression."""
    values: list[bool] = []
    for t in postfix:
        if t in RANK:
            b, a = values.pop(), values.pop()
            values.append(a or b if t == "or" else a and b if t == "and" else a)
        else:
            values.append(bool(PERMISSIVE.fullmatch(t) and LICENCE.fullmatch(t)))
    return values[0]


def alternatives(postfix: list[str]) -> Iterator[frozenset[str]]:
    """The sets of licences that a well-formed expression leaves to choose from, one after another; there may be very many."""

    def ways(end: int) -> int:
        """Where the operand that ends before end starts."""
        need, at = 1, end
        while need:
            at -= 1
            need += 1 if postfix[at] in RANK else -1
        return at

    def walk(end: int) -> Iterator[frozenset[str]]:
        t = postfix[end - 1]
        if t not in RANK:
            yield frozenset([t])
            return
        middle = ways(end - 1)
        if t == "or":
            yield from walk(middle)
            yield from walk(end - 1)
            return
        for a in walk(middle):
            for b in walk(end - 1):
                yield a | b if t == "and" else frozenset(f"{n} with {m}" for n in a for m in b)

    yield from walk(len(postfix))


def versioned(name: str, after: str) -> str:
    """A notice's label with the version in the words after it."""
    if "{}" not in name:
        return name
    m = VERSION.match(after)
    major, minor = (m[1] or m[3], m[2] or m[4]) if m else (None, None)
    if major is None:
        return name.format("")
    if name == "apache{}":
        return "apache-2" if major == "2" else f"apache-{major}.{minor or 0}"
    return name.format(f"-{major}.{minor or 0}")


class Scanner:
    def __init__(self):
        self.machine, self.tags = automaton(), tag_automaton()

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permissive, unknown)."""
        text = text or ""
        words = text.encode().translate(TABLE).split()
        line = f" {b' '.join(words).decode()} "
        starts, base, labels, score, shown, free = [], set(), set(), 0.0, [], None
        found = list(self.machine.iter(line))
        if found:
            # spaces before each place, counted once where there are many matches
            before = list(accumulate((c == " " for c in line), initial=0)) if len(found) > 200 else None
            notices = []
            for end, (_, size, own, other) in found:
                at = end - size  # of the phrase's first letter
                if own is not None:
                    base.add(own)
                    starts.append((before[at] if before is not None else line.count(" ", 0, at)) - 1)
                if other is not None:
                    notices.append((at, -end, other))
            reach = 0
            for at, end, name in sorted(notices):
                if -end > reach:  # not within a longer one
                    labels.add(versioned(name, line[-end : -end + 250]))
                    score, reach = 0.6, -end
            if base:
                labels |= base
                score = 0.9
        low = text.lower()
        places = [(end + 1 - len(tag), end + 1, tag) for end, tag in self.tags.iter(low)]
        unknown: set[str] = set()
        for n, (_, at, tag) in enumerate(places):
            given, listed = tokens(low, at, places[n + 1][0] if n + 1 < len(places) else None)
            if tag in FIELDS and not (given and LICENCE.fullmatch(next((t for t in given if t != "("), ""))):
                continue
            names, postfix, sound = parse(given)
            new = {x for x in names if not LICENCE.fullmatch(x)}
            labels |= {label(x) for x in names}
            unknown |= new
            shown.append(" ".join(postfix))
            score = max(score, 0.3 if not sound else 0.7 if new or listed else 1.0)
            if sound:
                free = bool(free) or permissive(postfix)
        return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(set(shown)), free, sorted(unknown))


_SCANNER: list[Scanner] = []
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive", "unknown"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: word and match counts, labels, score, the expressions after tags in postfix order, and
    whether permissive licences alone satisfy one of them (null where none is well formed), and identifiers that are not known."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        cols = list(zip(*(_SCANNER[0].scan(x.as_py()) for x in batch.column(1)))) or [()] * 10
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=NAMES)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permissive boolean, unknown array<string>"
    return map_arrow(docs.select(F.col(id_col).alias("doc_id").cast("long"), F.col(text_col).alias("text")), run, schema)


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
