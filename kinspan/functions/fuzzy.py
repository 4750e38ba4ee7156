"""Similarity functions that need a sequence matcher, as pandas UDFs."""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

FIDELITY, SAME_NAME = 0.92, 0.85


def ratio(a: str, b: str, autojunk: bool = False) -> float:
    return SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


def matching(a: str, b: str) -> list[tuple[int, int, int]]:
    """(place in a, place in b, length) of the blocks that the sequence matcher finds without junk, in any order.

    The longest common stretch, of several the first in a and then in b, and so on before and after it. A stretch grows as
    long as b has it, so there is one substring search for each letter of a instead of a step for each pair of equal letters.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        part, at, size, i = b[blo:bhi], alo, 0, alo
        while i + size < ahi:
            if a[i : i + size + 1] in part:
                at, size = i, size + 1
            else:
                i += 1
        if size:
            there = blo + part.index(a[at : at + size])
            out.append((at, there, size))
            if alo < at and blo < there:
                todo.append((alo, at, blo, there))
            if at + size < ahi and there + size < bhi:
                todo.append((at + size, ahi, there + size, bhi))
    return out


def plain_ratio(a: str, b: str) -> float:
    """ratio() without its junk rule."""
    return 2.0 * sum(size for _, _, size in matching(a, b)) / (len(a) + len(b)) if a or b else 1.0


def partial(needle: str | None, hay: str | None) -> float:
    """Ratio of the needle with the best stretch of its own length; stretches are tried where matching blocks put it."""
    if not needle or not hay:
        return 0.0
    if needle in hay:
        return 1.0
    n = len(needle)
    if n >= len(hay):
        return plain_ratio(needle, hay)
    places = {len(hay) - n} | {min(max(there - at, 0), len(hay) - n) for at, there, _ in matching(needle, hay)}
    letters, best = Counter(needle), 0.0
    # no order of the letters matches more than they have in common, so most stretches need no matching
    for bound, at in sorted(((sum((letters & Counter(hay[at : at + n])).values()) / n, at) for at in places), reverse=True):
        if bound <= best:
            break
        best = max(best, plain_ratio(needle, hay[at : at + n]))
    return best


def partial_ratio(needle: str | Column, hay: str | Column) -> Column:
    @pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([partial(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return f(needle, hay)


def name_ratio(one: str | Column, two: str | Column) -> Column:
    """Ratio with the matcher's own junk rule, as names are compared."""

    @pandas_udf("double")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(x or "", y or "", autojunk=True) for x, y in zip(a, b, strict=True)], dtype="float64")

    return f(one, two)


def edit_rate(reference: list[str], heard: list[str]) -> float:
    """Edits to turn the reference into the best-fitting stretch of what was heard, over the reference's length."""
    if not reference:
        return 0.0
    row = np.zeros(len(heard) + 1, np.int64)  # the stretch may begin anywhere
    codes: dict[str, int] = {}
    h = np.array([codes.setdefault(t, len(codes)) for t in heard], np.int64)
    steps = np.arange(len(heard) + 1)
    for i, token in enumerate(reference, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (h != codes.get(token, -1)), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps  # insertions
    return float(row.min()) / len(reference)


def tokens(text: str | None, chinese: bool) -> list[str]:
    kept = re.sub(r"[^\w\s]", "", (text or "").lower())
    return [c for c in kept if not c.isspace()] if chinese else kept.split()


def error_rate(chinese: bool = False):
    @pandas_udf("double")
    def rate(reference: pd.Series, heard: pd.Series) -> pd.Series:
        return pd.Series([edit_rate(tokens(a, chinese), tokens(b, chinese)) for a, b in zip(reference, heard, strict=True)], dtype="float64")

    return rate
