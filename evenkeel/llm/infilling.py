"""Fill-in-the-middle: a text cut in three, its parts put in another order behind sentinels.

A text is UTF-8 cut into blocks of `BLOCK` bytes. A Fenwick tree over the blocks holds how many
units and how many code points start in each. To end a part after k units, a descent by powers of
two finds the block that holds unit k and the sums before it, and only that block is searched for
the byte where the unit starts. Spark then takes the parts by code points, so a text goes to
Python once and three numbers come back.

Units are code points, words (a word with the white space behind it; white space before the first
word belongs to it) or lines (a line with its end). k units of n end where unit k starts, all n at
the end of the text.

Draws are the first four 8-digit groups of sha256("<epoch>:<doc_id>"), so a retried task cuts as
before. Null and empty texts are plain, as are texts that contain a sentinel: they come back as
they are (null as empty). A null doc_id draws like an empty one; repeated rows are cut alike, an
empty table gives no rows, and all other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .shingles import text_bytes

BLOCK = 2_048  # bytes
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20  # of a hundred: plain from the one, suffix first below the other
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def unit_starts(raw: np.ndarray, before: int | None, unit: str) -> np.ndarray:
    """Which bytes of a block start a unit; `before` is the byte ahead of the block, None at the start of a text."""
    if unit == "code points":
        return (raw & 0xC0) != 0x80
    last = np.empty(len(raw), np.uint8)
    last[1:] = raw[:-1]
    last[:1] = 0 if before is None else before
    starts = last == 10 if unit == "lines" else WHITE[last] & ~WHITE[raw]
    if before is None:
        starts[:1] = True
    return starts


def unit_counts(raw: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Units and code points that start in each block of a text."""
    units, points = [], []
    for at in range(0, len(raw), BLOCK):
        block = raw[at : at + BLOCK]
        points.append(np.count_nonzero((block & 0xC0) != 0x80))
        units.append(points[-1] if unit == "code points" else np.count_nonzero(unit_starts(block, int(raw[at - 1]) if at else None, unit)))
    if unit == "words" and units and WHITE[raw[0]]:  # leading white space and the first word are one unit
        first = np.flatnonzero(~WHITE[raw])
        if len(first):
            units[int(first[0]) // BLOCK] -= 1
    return np.array(units, np.int64), np.array(points, np.int64)


class Fenwick:
    """Sums of units and of code points over the blocks of one text."""

    def __init__(self, units: np.ndarray, points: np.ndarray) -> None:
        self.size = len(units)
        ends = np.arange(1, self.size + 1)
        begins = ends - (ends & -ends)  # node i covers the blocks after begins[i - 1] up to i
        self.nodes = []
        for values in (units, points):
            sums = np.concatenate([[0], np.cumsum(values)])
            self.nodes.append([0, *(sums[ends] - sums[begins]).tolist()])

    def descend(self, k: int) -> tuple[int, int, int]:
        """The block in which unit k (from 0) starts, and the units and code points before that block."""
        units, points = self.nodes
        at, step, u, p = 0, 1 << self.size.bit_length(), 0, 0
        while step:
            if at + step <= self.size and u + units[at + step] <= k:
                at += step
                u += units[at]
                p += points[at]
            step >>= 1
        return at, u, p


def boundary(raw: np.ndarray, tree: Fenwick, k: int, unit: str) -> int:
    """Code points of a text before its unit k."""
    block, u, p = tree.descend(k)
    at = block * BLOCK
    own = raw[at : at + BLOCK]
    starts = np.flatnonzero(unit_starts(own, int(raw[at - 1]) if at else None, unit))
    if unit == "words" and WHITE[raw[0]]:
        first = np.flatnonzero(~WHITE[raw[: at + len(own)]])
        starts = starts[starts != (first[0] - at)] if len(first) else starts
    return p + int(np.count_nonzero((own[: starts[k - u]] & 0xC0) != 0x80))


def cut_points(raw: np.ndarray, draws: tuple[int, int], unit: str) -> tuple[int, int, int]:
    """Units of a text, and the code points before the end of its prefix and of its middle."""
    if not len(raw):
        return 0, 0, 0
    units, points = unit_counts(raw, unit)
    n = int(units.sum())
    tree = Fenwick(units, points)
    total = int(points.sum())
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    return n, *(total if k == n else boundary(raw, tree, k, unit) for k in (a, b))


def _cuts(unit: str):
    @F.arrow_udf("struct<n: bigint, a: bigint, b: bigint>")
    def cuts(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, first, second in batches:
            raw, at = text_bytes(texts)
            found = [cut_points(raw[s:e], draws, unit) for s, e, draws in
                     zip(at[:-1].tolist(), at[1:].tolist(), zip(first.to_pylist(), second.to_pylist(), strict=True), strict=True)]
            columns = np.array(found, np.int64).reshape(-1, 3)
            yield pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], ["n", "a", "b"])
    return cuts


def draw(doc_id: Column, epoch: int, k: int) -> Column:
    """The k-th number (from 0) drawn for a document."""
    digest = F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def infill(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "code points", epoch: int = 1) -> DataFrame:
    """`docs` with n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    if unit not in ("code points", "words", "lines"):
        raise ValueError(f"unknown unit: {unit}")
    body, key = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.col(f"`{doc_id}`")
    h, body_, form = (fresh(docs, x) for x in ("_cuts", "_body", "form"))
    n, prefix_chars, middle_chars, output = (fresh(docs, x) for x in ("n", "prefix_chars", "middle_chars", "output"))
    plain = (F.col(body_) == "") | (draw(key, epoch, 2) % 100 >= PLAIN_FROM)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(F.col(body_), F.lit(mark))
    cut = docs.withColumn(body_, body).withColumn(h, _cuts(unit)(F.col(body_), draw(key, epoch, 0), draw(key, epoch, 1)))
    cut = cut.withColumn(form, F.when(plain, "plain").when(draw(key, epoch, 3) % 100 < SPM_BELOW, "spm").otherwise("psm"))
    a, b = F.col(f"{h}.a").cast("int"), F.col(f"{h}.b").cast("int")
    prefix, middle = F.substring(F.col(body_), F.lit(1), a), F.substring(F.col(body_), a + 1, b - a)
    suffix = F.substring(F.col(body_), b + 1, F.lit(2**31 - 1))
    whole = (F.when(F.col(form) == "plain", F.col(body_))
             .when(F.col(form) == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
             .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)))
    shown = F.col(form) != "plain"
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{h}.n").alias(n), F.col(form),
                      F.when(shown, F.col(f"{h}.a")).alias(prefix_chars), F.when(shown, F.col(f"{h}.b") - F.col(f"{h}.a")).alias(middle_chars),
                      whole.alias(output))


def restore(output: Column, form: Column) -> Column:
    """The text that was cut, from an output and its form alone."""
    def between(start: str, end: str | None) -> Column:
        rest = F.substring_index(output, start, -1)
        return F.substring_index(rest, end, 1) if end else rest
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX)))
            .otherwise(output))


def report(docs: DataFrame) -> DataFrame:
    """Row by row what was cut, with digests of the output and of the text restored from it."""
    done = infill(docs.select("doc_id", "text"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
