"""Forms of personal data that the training rows call personal are proposed whole, and redacted."""

import pytest
from pyspark.sql import functions as F

from eventide.llm import pii
from test_operators import frame


def test_forms_are_proposed_whole(spark):
    forms = {"(415) 555-2671": "identifier", "(383) 55-1234": "identifier", "415 - 555 - 2671": "identifier", "123-45-6789": "identifier", "hunter2": "value", "correcthorsebatterystaple": "value"}
    rows = [("password=" if k == "value" else "phone: ") + v + " end" for v, k in forms.items()]
    got = frame(spark, rows).select("doc_id", pii.candidates(F.col("text")).alias("c")).orderBy("doc_id").collect()
    assert [(v, k) in {(s["v"], s["kind"]) for s in x["c"]} for (v, k), x in zip(forms.items(), got)] == [True] * len(forms)
    assert all(t[s["start"] : s["end"]] == s["v"] for t, x in zip(rows, got) for s in x["c"])


def test_every_personal_row_is_proposed(spark):
    rows = [(k, b, v) for k, b, v, y in pii.training_rows(1500) if y]
    texts = [b + v + (b[-1] if b[-1] in "\"'" else "") + " end" for _, b, v in rows]
    got = frame(spark, texts).select("doc_id", pii.candidates(F.col("text")).alias("c")).orderBy("doc_id").collect()
    missed = [(b, v) for (k, b, v), x in zip(rows, got) if v not in {s["v"] for s in x["c"]}]
    assert not missed, missed[:5]


@pytest.mark.parametrize(
    "text,want",
    [
        ("call (415) 555-2671 now", "call [IDENTIFIER] now"),
        ("phone: (383) 55-1234 now", "phone: [IDENTIFIER] now"),
        ("it was 123-45-6789 (2023) there", "it was [IDENTIFIER] (2023) there"),
        ("password=hunter2 x", "password=[SECRET] x"),
        ("password=correcthorsebatterystaple x", "password=[SECRET] x"),
        ("token=\"shortkey\" x", "token=\"[SECRET]\" x"),
        ("the password: required field", "the password: required field"),
        ("token = None", "token = None"),
    ],
)
def test_redacted(spark, text, want):
    assert pii.redact(frame(spark, [text])).first()["text"] == want
