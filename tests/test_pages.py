"""The index of a page finds what a search of the page finds."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.functions import pages

WORD = st.sampled_from(["fast", "Fast", "fas", "model", "x1", "brand#1", "ast", "2.50", "$2.50", "12.50", "2.5", "10", "a"])
TEXT = st.lists(st.tuples(WORD, st.sampled_from([" ", "  ", "\n", "", ": "])).map("".join), max_size=30).map("".join)


@settings(max_examples=500, deadline=None)
@given(TEXT, TEXT)
def test_words(page, text):
    assert pages.PageIndex(page).has_words(text) == (text.lower() in page.lower())


@settings(max_examples=500, deadline=None)
@given(TEXT, st.sampled_from(["2.50", "2.5", "0.5", ".5", "12", "1", "1e+06", "102.50", ".", "2.502"]))
def test_numbers(page, text):
    assert pages.PageIndex(page).has_number(text) == (text in page)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.lists(st.tuples(TEXT, st.none() | st.sampled_from([2.5, 12.5, 10.0, 0.0, -1.0, 1e6, float("nan")])), max_size=5))
def test_hits(page, tiers):
    prices = [p for _, p in tiers]
    got = pages.hits(page, [n for n, _ in tiers], prices, prices)
    for bits, (name, price) in zip(got, tiers):
        assert bool(bits & pages.NAME) == (bool(name) and bool(page) and name.lower() in page.lower())
        said = page and price is not None and price == price
        general = bool(said) and (f"{price:.2f}" in page or f"{price:g}" in page)
        short = bool(said) and (f"{price:.2f}" in page or re.sub(r"\.?0+$", "", f"{price:.2f}") in page)
        assert [bool(bits & b) for b in pages.GENERAL] == [general, general]
        assert [bool(bits & b) for b in pages.SHORT] == [short, short]


def test_pages_without_text():
    assert pages.hits(None, ["a"], [1.0], [None]) == [0]
    assert pages.hits("", [], [], []) == []
