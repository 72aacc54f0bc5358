"""Near duplicates among many texts on one template, against brute force."""

import random

import pytest

from eventide.llm import simhash
from test_operators import components_by_hand, frame, jaccard


@pytest.mark.parametrize("sample", [simhash.SAMPLE_TEXTS, 1])
def test_pairs_within_a_template_family(spark, monkeypatch, sample):
    monkeypatch.setattr(simhash, "SAMPLE_TEXTS", sample)
    r = random.Random(8)
    words = lambda n: ["w%d" % r.randrange(10**7) for _ in range(n)]
    template = words(304)
    rows = [" ".join(template + words(50)) for _ in range(60)]
    for _ in range(30):
        both = words(25)
        rows += [" ".join(template + both + words(25)) for _ in range(2)]
    r.shuffle(rows)
    want = {(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a], rows[b]) >= 0.8}
    got = {(x["u"], x["v"]) for x in simhash.similar(frame(spark, rows)).collect()}
    assert len(want) == 30 and got <= want
    assert components_by_hand(len(rows), got) == components_by_hand(len(rows), want)
