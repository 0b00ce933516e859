"""Which facts of a record stand in its page: an index of the page, made once, and one look per fact."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a tier's hits: its name; its prices with two decimals or in general format; with two decimals or without trailing zeros.
NAME, GENERAL, SHORT = 1, (2, 4), (8, 16)

WORDS = re.compile(r"\S+")
NUMBERS = re.compile(r"[0-9.]+")
ZEROS = re.compile(r"\.?0+$")


class PageIndex:
    """Places of a page's words and its runs of digits and points.

    A text of digits and points is in the page if it is one of the runs or inside of one; the runs are much
    shorter than the page. A text of several words is in the page only where its inner words are; where the first
    one stands as a whole word is looked at first.
    """

    def __init__(self, page: str) -> None:
        self.page, self.low = page, page.lower()
        self.runs = set(NUMBERS.findall(page))
        self.joined = " ".join(self.runs)
        self.places: dict[str, list[int]] = {}
        for found in WORDS.finditer(self.low):
            self.places.setdefault(found.group(), []).append(found.start())

    def has_number(self, text: str) -> bool:
        if text in self.runs:
            return True
        return text in (self.joined if NUMBERS.fullmatch(text) else self.page)

    def has_words(self, text: str) -> bool:
        """Whether the page holds the text, both in lower case."""
        text, low, places = text.lower(), self.low, self.places
        if text in places:
            return True
        words = [(m.group(), m.start()) for m in WORDS.finditer(text)]
        if words:
            first, at = words[0]
            if any(low.startswith(text, p - at) for p in places.get(first, ()) if p >= at):
                return True
        if len(words) < 3:
            return text in low
        inner = min(words[1:-1], key=lambda w: len(places.get(w[0], ())))
        return any(low.startswith(text, p - inner[1]) for p in places.get(inner[0], ()) if p >= inner[1])


def hits(page: str | None, names, *prices) -> list[int]:
    """The bits of each tier, from its name and two prices."""
    if not page:
        return [0] * len(names)
    index = PageIndex(page)
    seen: dict[float, int] = {}

    def of_price(x: float) -> int:
        fixed = f"{x:.2f}"
        general = index.has_number(fixed)
        short = general or index.has_number(ZEROS.sub("", fixed))
        general = general or index.has_number(f"{x:g}")
        return general + 2 * short

    out = []
    for name, *pair in zip(names, *prices):
        bits = NAME if name and index.has_words(name) else 0
        for x, general, short in zip(pair, GENERAL, SHORT):
            if x is None or x != x:
                continue
            if x not in seen:
                seen[x] = of_price(x)
            bits |= general * (seen[x] & 1) | short * (seen[x] >> 1)
        out.append(bits)
    return out


def tier_hits(page: Column, tiers: Column, name: str, prices: tuple[str, str]) -> Column:
    """``array<int>``: for each tier of a record, the bits of what its page holds. A null page holds nothing."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for pages, names, first, second in batches:
            rows = zip(pages, names, first, second)
            yield pd.Series([None if row[1] is None else hits(*row) for row in rows], dtype=object)

    def doubles(field: str) -> Column:
        return F.transform(tiers, lambda t: t[field].cast("double"))

    return F.pandas_udf(run, "array<int>")(page, F.transform(tiers, lambda t: t[name]), *map(doubles, prices))
