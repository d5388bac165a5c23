"""Weighted similarity of two texts, 0 to 100, from the letters two texts share in order; in Arrow batches, as no built-in expression counts them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weight of comparisons without regard to order, of those with a part of the longer text, and with one much longer; the lengths' quotients from which parts are compared.
UNORDERED, PART, SMALL_PART, FROM, FAR = 0.95, 0.9, 0.6, 1.5, 8.0


def plain(text: str) -> str:
    """Lower case, blanks for all that is no letter, digit or underscore, none at the ends."""
    return re.sub(r"\W", " ", text).lower().strip()


def shared(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one big number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    return round(200 * shared(a, b) / (len(a) + len(b))) if a or b else 0


def _part(a: str, b: str) -> int:
    """The best ratio of the shorter text with a stretch of the longer one of its length."""
    short, long = sorted((a, b), key=len)
    return max(ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def _unordered(a: str, b: str, compare) -> int:
    """Words in order of the alphabet, and the words of both against those with the words of one."""
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one, other = (" ".join([both, *sorted(own)]).strip() if own else both for own in (x - y, y - x))
    sets = [(both, one), (both, other), (one, other)]
    return max(compare(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), *(compare(p, q) for p, q in sets if p and q), 0)


@lru_cache(1 << 16)
def weighted(a: str, b: str) -> int:
    """100 for equal texts, 0 where either holds no letter or digit. Symmetric."""
    a, b = plain(a), plain(b)
    if not a or not b:
        return 0
    base = ratio(a, b)
    apart = max(len(a), len(b)) / min(len(a), len(b))
    if apart < FROM:
        return round(max(base, UNORDERED * _unordered(a, b, ratio)))
    scale = PART if apart <= FAR else SMALL_PART
    return round(max(base, scale * _part(a, b), scale * UNORDERED * _unordered(a, b, _part)))


def weighted_ratio(a: Column, b: Column) -> Column:
    """weighted() of two columns; null as an empty text."""

    @F.pandas_udf("int")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([weighted(p, q) for p, q in zip(x, y)], dtype="int32")

    return run(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
