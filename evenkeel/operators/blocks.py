"""Similarity of texts by matching blocks.

The longest common run of two texts is a block; what lies left of it and what lies right of it are
compared again in the same way. The similarity is twice the characters in blocks over those of
both texts. A suffix automaton of one side finds the longest run while the other is read once, so
a step takes time in proportion to the two stretches, whatever repeats in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class Automaton:
    """All runs of a text; every state knows where its runs end first."""

    def __init__(self, text: str) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.link, self.long, self.ends = [-1], [0], [0]
        last = 0
        for at, c in enumerate(text, 1):
            new = self.state({}, 0, at, at)
            while last >= 0 and c not in self.step[last]:
                self.step[last][c] = new
                last = self.link[last]
            if last >= 0:
                self.link[new] = self.split(last, c)
            last = new

    def state(self, step: dict[str, int], link: int, long: int, ends: int) -> int:
        for held, value in ((self.step, step), (self.link, link), (self.long, long), (self.ends, ends)):
            held.append(value)
        return len(self.link) - 1

    def split(self, before: int, c: str) -> int:
        """The state of the runs of `before` with `c` behind, parted from longer ones that end alike."""
        target, long = self.step[before][c], self.long[before] + 1
        if self.long[target] == long:
            return target
        twin = self.state(dict(self.step[target]), self.link[target], long, self.ends[target])
        self.link[target] = twin
        while before >= 0 and self.step[before].get(c) == target:
            self.step[before][c] = twin
            before = self.link[before]
        return twin

    def longest(self, other: str) -> tuple[int, int, int]:
        """Start in `other`, start in the text, and length of the first of the longest common runs."""
        best, now, length = (0, 0, 0), 0, 0
        for at, c in enumerate(other, 1):
            while now and c not in self.step[now]:
                now = self.link[now]
                length = self.long[now]
            if c in self.step[now]:
                now, length = self.step[now][c], length + 1
            if length > best[2]:
                best = (at - length, self.ends[now] - length, length)
        return best


def matched(a: str, b: str) -> int:
    """Characters in matching blocks."""
    total, open_ = 0, [(a, b)]
    while open_:
        x, y = open_.pop()
        if x and y:
            i, j, n = Automaton(y).longest(x)
            if n:
                total += n
                open_ += [(x[:i], y[:j]), (x[i + n :], y[j + n :])]
    return total


@F.pandas_udf(DoubleType())
def block_similarity(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of both texts that lies in matching blocks: 1 for two empty ones, null if one is null."""
    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else 1.0 if not a and not b else 2.0 * matched(a, b) / (len(a) + len(b))
                         for a, b in zip(left, right, strict=True)], dtype="float64")
