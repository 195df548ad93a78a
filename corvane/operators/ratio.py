"""Ratcliff and Obershelp's similarity of two token lists, without comparing every pair of equal tokens.

The longest common run of two ranges comes from a suffix automaton of the shorter one, which the other is read
through; the ranges left and right of the run wait on a stack. As in Python's `difflib`, the run that starts first
in the first list wins, then in the second; and tokens that make up more than a hundredth of a second list of 200 or
more start no run but may lengthen one.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def automaton(tokens: list[int]) -> tuple[list[dict], list[int], list[int], list[int]]:
    """Steps, suffix links, longest lengths and first ends of the states of all runs of the tokens."""
    step, link, length, first = [{}], [-1], [0], [-1]
    last = 0
    for at, token in enumerate(tokens):
        state = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(at)
        p = last
        while p >= 0 and token not in step[p]:
            step[p][token] = state
            p = link[p]
        if p >= 0:
            q = step[p][token]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(token) == q:
                    step[p][token] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return step, link, length, first


def longest_run(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run; of several the first in a, then in b."""
    turned = len(b) > len(a)
    short, long = (a, b) if turned else (b, a)
    if not short or set(short).isdisjoint(long):
        return 0, 0, 0
    step, link, length, first = automaton(short)
    state = size = 0
    best = (0, 0, 0)
    for at, token in enumerate(long):
        while state and token not in step[state]:
            state = link[state]
            size = length[state]
        if token in step[state]:
            state = step[state][token]
            size += 1
        else:
            size = 0
        if size and size >= best[2]:
            i, j = at - size + 1, first[state] - size + 1
            found = (j, i, size) if turned else (i, j, size)
            if size > best[2] or found[:2] < best[:2]:
                best = found
    return best


def matched(a: list, b: list, popular: bool = True) -> int:
    """Tokens in the blocks that both lists share."""
    counts = Counter(b)
    common = {t for t, n in counts.items() if n > len(b) // 100 + 1} if popular and len(b) >= 200 else set()
    number = {t: k for k, t in enumerate(counts)}
    x, y = [number.get(t, -1) for t in a], [number[t] for t in b]
    # a token that starts no run is another one at each place
    free = len(number)
    lone = {number[t] for t in common}
    sx = [-1 if t in lone else t for t in x]
    sy = [free + k if t in lone else t for k, t in enumerate(y)]
    total, ranges = 0, [(0, len(x), 0, len(y))]
    while ranges:
        alo, ahi, blo, bhi = ranges.pop()
        if alo >= ahi or blo >= bhi:
            continue
        i, j, size = longest_run(sx[alo:ahi], sy[blo:bhi])
        i, j = i + alo, j + blo
        while i > alo and j > blo and x[i - 1] == y[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and x[i + size] == y[j + size]:
            size += 1
        if size:
            total += size
            ranges += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
    return total


def similarity_ratio(a: Column | str, b: Column | str, popular: bool = False) -> Column:
    """Twice the shared tokens over all tokens of two arrays; 1 for two empty ones, null if either is null.

    `popular`: leave very frequent tokens of long second lists out of the search, as `difflib` does by default.
    """

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y) -> float | None:
            if x is None or y is None:
                return None
            return 2.0 * matched(list(x), list(y), popular) / (len(x) + len(y)) if len(x) + len(y) else 1.0

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)

    return ratio(a, b)
