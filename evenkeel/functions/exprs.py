"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(value) -> Column:
    """Column, column name or Python number as a string column."""
    if isinstance(value, str):
        value = F.col(value)
    elif not isinstance(value, Column):
        value = F.lit(value)
    return value.cast("string")


def draw_key(seed: int, *parts, tag: str | None = None) -> Column:
    """Keyed hash that orders random draws; it does not depend on partitioning."""
    head = [F.lit(str(seed))] + ([F.lit(tag)] if tag else [])
    return F.md5(F.concat_ws("|", *head, *[text(p) for p in parts]))


def pick(seed: int, n: Column, *parts) -> Column:
    """Keyed draw with replacement: an integer in [0, n)."""
    head = F.conv(F.substring(draw_key(seed, *parts), 1, 8), 16, 10).cast("bigint")
    return head % n


def coin(seed: int, *parts) -> Column:
    """Keyed 0/1 draw."""
    return pick(seed, F.lit(2), *parts)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def clipped_logit(p: Column, margin: float = 1e-3) -> Column:
    return logit(clip(p, margin, 1.0 - margin))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def bernoulli_loss(z: Column, y: Column) -> Column:
    """log(1 + e^z) - y z, stable for large |z|."""
    return F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - y * z


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null when b is zero."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def take_count(fraction: float | Column, n: Column) -> Column:
    """max(1, min(n, round-half-even(fraction * n)))."""
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return F.greatest(F.lit(1), F.least(n, F.bround(F.round(share * n, 9), 0).cast("bigint")))


def tile(rn: Column, n: Column, k: Column) -> Column:
    """Zero-based near-equal tile of 1-based position `rn`; the first tiles take the extra rows."""
    k = F.least(k.cast("bigint"), n)
    q, r = F.floor(n / k), n % k
    head = r * (q + 1)
    return F.when(rn <= head, F.floor((rn - 1) / (q + 1))).otherwise(
        r + F.floor((rn - 1 - head) / q)).cast("bigint")


def r8(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 8)
