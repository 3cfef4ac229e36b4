"""Ratcliff/Obershelp likeness of two texts on suffix automata.

The likeness is twice the number of matched characters over both lengths.  A
match is the longest common block (the first in the left text, then the first in
the right one); what is left of it and right of it is matched in the same way.

If the right text has 200 characters or more, characters that are over a
hundredth of it are popular: a block is sought without them and then extended
over them.  So the automaton of a range of the right text holds runs of other
characters only, and one pass over the range of the left text finds the block,
in time that grows with both ranges and not with their product.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: From this length of the right text on, characters over this share of it are popular.
LONG, SHARE = 200, 100


def popular(text: str) -> frozenset[str]:
    """Characters that start no block."""
    if len(text) < LONG:
        return frozenset()
    most = len(text) // SHARE + 1
    return frozenset(c for c, n in Counter(text).items() if n > most)


class Automaton:
    """All blocks of a range of a text that hold none of the ``skipped`` characters."""

    def __init__(self, text: str, start: int, end: int, skipped: frozenset[str]):
        self.steps: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]  # first: where the blocks of a state first end
        last = 0
        for k in range(start, end):
            c = text[k]
            last = 0 if c in skipped else self._extend(last, c, k)

    def _state(self, steps: dict[str, int], link: int, length: int, first: int) -> int:
        self.steps.append(steps)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        """A copy of ``q`` for its blocks that end like those of ``p`` with ``c``."""
        copy = self._state(self.steps[q].copy(), self.link[q], self.length[p] + 1, self.first[q])
        self.link[q] = copy
        while p >= 0 and self.steps[p].get(c) == q:
            self.steps[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: str, k: int) -> int:
        q = self.steps[last].get(c)
        if q is not None:  # after a skipped character: the block is known already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state({}, 0, self.length[last] + 1, k)
        p = last
        while p >= 0 and c not in self.steps[p]:
            self.steps[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.steps[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def longest(self, text: str, start: int, end: int) -> tuple[int, int, int]:
        """Length and both ends (the first ones) of the longest block that a range of ``text`` has too."""
        best, at, there, state, n = 0, start, -1, 0, 0
        steps, link, length = self.steps, self.link, self.length
        for k in range(start, end):
            c = text[k]
            to = steps[state].get(c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = steps[state].get(c)
            if to is not None:
                state, n = to, n + 1
                if n > best:
                    best, at, there = n, k + 1, self.first[state] + 1
        return best, at, there


def matched(a: str, b: str) -> int:
    """Characters in matched blocks."""
    total, skipped = 0, popular(b)
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        i, i_end, j, j_end = ranges.pop()
        n, x, y = Automaton(b, j, j_end, skipped).longest(a, i, i_end)
        if not n:
            x, y = i, j  # nothing but popular characters: they count from the start of both ranges on
        x0, y0 = x - n, y - n
        while x0 > i and y0 > j and a[x0 - 1] == b[y0 - 1]:
            x0, y0 = x0 - 1, y0 - 1
        while x < i_end and y < j_end and a[x] == b[y]:
            x, y = x + 1, y + 1
        if x > x0:
            total += x - x0
            if i < x0 and j < y0:
                ranges.append((i, x0, j, y0))
            if x < i_end and y < j_end:
                ranges.append((x, i_end, y, j_end))
    return total


def ratio(a: str, b: str) -> float:
    """Likeness of two texts from 0 to 1; 1 if both are empty."""
    if a == b:
        return 1.0
    return 2.0 * matched(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def text_similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Likeness of two texts; null counts as empty."""
    for a, b in parts:
        yield pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)
