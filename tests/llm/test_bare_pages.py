"""Main text of pages with custom elements and empty images, and of pages whose article has no element of its own."""

import random
from collections import Counter

import pytest

from eventide.llm import html

PROSE = "The river rose in the night, and by morning the lower fields were under water. Nobody in the village had seen it so high. "


@pytest.mark.parametrize("odd", ['<svg-icon name="x"></svg-icon>', "<template-x></template-x>", "<select-menu></select-menu>", '<svg viewBox="0 0 1 1" />', "<svg/>", "<svg/><p>Then.</p><svg><text>drawn</text></svg>"])
def test_nothing_is_lost_after(odd):
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Flood</h1>{odd}<p>{PROSE}</p><p>{PROSE}</p></article></body></html>"
    got = html.extract([page], html.model())[0].split("\n")
    assert got == ["Flood", *(["Then."] if "Then" in odd else []), PROSE.strip(), PROSE.strip()]


@pytest.mark.parametrize("page", [PROSE * 3, f"{PROSE}<b>{PROSE}</b><br>{PROSE}", f"<html><body>{PROSE}<br>{PROSE}<i>{PROSE}</i></body></html>"])
def test_text_in_no_element_of_its_own(page):
    assert html.extract([page], html.model()) == [(PROSE * 3).strip()]


def test_bare_pages_held_out():
    r = random.Random(4321)
    want = have = both = 0
    pages = [html.made_up_page(r, True) for _ in range(150)]
    for (_, text), out in zip(pages, html.extract([p for p, _ in pages], html.model())):
        a, b = Counter(text.split("\n")), Counter(out.split("\n"))
        both, want, have = both + sum((a & b).values()), want + sum(a.values()), have + sum(b.values())
    assert both / want > 0.9 and both / have > 0.9
