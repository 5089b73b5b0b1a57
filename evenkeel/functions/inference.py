"""Tests and intervals as column expressions and grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import ratio
from .ranks import average_rank


def quantile_interval(value: str, prefix: str = "ci") -> list[Column]:
    """95 % percentile interval, linearly interpolated."""
    return [F.percentile(value, 0.025).alias(f"{prefix}_low"), F.percentile(value, 0.975).alias(f"{prefix}_high")]


def _binomial_mass(n: Column, keep) -> Column:
    """Sum of fair-coin binomial probabilities over the counts `keep` selects.

    log C(n, i) is a running sum of log ratios, so one pass over 0..n suffices.
    """
    start = F.struct((n.cast("double") * F.log(F.lit(0.5))).alias("lp"), F.lit(0.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        i = i.cast("double")
        lp = F.when(i == 0, acc["lp"]).otherwise(acc["lp"] + F.log((n - i + 1) / i))
        return F.struct(lp.alias("lp"), (acc["total"] + F.when(keep(i), F.exp(lp)).otherwise(0.0)).alias("total"))

    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint")), start, step, lambda a: a["total"])
    return F.least(F.lit(1.0), total)


def binomial_greater(x: Column, n: Column) -> Column:
    """P(X >= x) for a fair coin."""
    return _binomial_mass(n, lambda i: i >= x)


def binomial_two_sided(x: Column, n: Column) -> Column:
    """Exact two-sided p for a fair coin; one when there is no trial."""
    return F.when(n == 0, 1.0).otherwise(
        _binomial_mass(n, lambda i: F.abs(i - n / 2.0) >= F.abs(x - n / 2.0)))


def normal_two_sided(z: Column) -> Column:
    """2 (1 - Phi(|z|)) by the Abramowitz-Stegun 7.1.26 rational form (error below 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


EXACT_PAIRS = 50  # differences up to which the signed-rank distribution is counted out


def signed_rank_tail(n: Column, statistic: Column) -> Column:
    """P(W <= statistic), W the sum of a random half of the ranks 1 to n.

    The polynomial of rank sums is folded rank by rank: each rank is in or out with one half.
    """
    def add(chances: Column, rank: Column) -> Column:
        size = F.size(chances)
        return F.transform(F.sequence(F.lit(0), size + rank - 1), lambda s: 0.5 * (
            F.coalesce(F.get(chances, s), F.lit(0.0)) + F.when(s >= rank, F.get(chances, s - rank)).otherwise(F.lit(0.0))))
    spread = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.array(F.lit(1.0)), add)
    return F.aggregate(F.slice(spread, 1, F.floor(statistic).cast("int") + 1), F.lit(0.0), lambda a, x: a + x)


def wilcoxon(df: DataFrame, keys: Sequence[str], diff: str) -> DataFrame:
    """Signed-rank test per `keys`: zeros dropped, average ranks.

    Up to `EXACT_PAIRS` differences without ties or zeros p is exact, otherwise it is the
    tie-corrected normal approximation. Groups with only zeros get p = 1.
    """
    keys = list(keys)
    base = df.withColumn("_abs", F.abs(F.col(diff)))
    ranked = average_rank(base.filter(F.col("_abs") > 0), keys, "_abs", "_r")
    sums = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col(diff) > 0, F.col("_r"))), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(F.when(F.col(diff) < 0, F.col("_r"))), F.lit(0.0)).alias("down"))
    c = F.col("_c").cast("double")
    ties = base.filter(F.col("_abs") > 0).groupBy(*keys, "_abs").agg(F.count(F.lit(1)).alias("_c")).groupBy(
        *keys).agg(F.sum(c * c * c - c).alias("_ties"))
    n = F.col("n").cast("double")
    z = (F.col("up") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    tested = sums.join(ties, keys).select(*keys, "n", F.least("up", "down").alias("statistic"), z.alias("z"), "_ties")
    groups = df.groupBy(*keys).agg(F.count_if(F.col(diff) == 0).alias("_zeros"))
    exact = (F.col("n") <= EXACT_PAIRS) & (F.col("_ties") == 0) & (F.col("_zeros") == 0)
    p = F.when(exact, F.least(F.lit(1.0), 2 * signed_rank_tail(F.col("n"), F.col("statistic")))).otherwise(normal_two_sided(F.col("z")))
    return groups.join(tested, keys, "left").select(
        *keys, F.coalesce("n", F.lit(0)).alias("n"), "statistic", "z", F.coalesce(p, F.lit(1.0)).alias("p"))


def bh_adjust(df: DataFrame, keys: Sequence[str], p: str, id_col: str) -> DataFrame:
    """Benjamini-Hochberg q values per `keys`.

    Position and running minimum are computed per bucket of p and joined with
    bucket totals, so a large family of tests is spread over tasks.
    """
    keys = list(keys)
    grid = df.withColumn("_b", F.floor(F.col(p) * 1024))
    w = Window.partitionBy(*keys).orderBy("_b")
    sizes = grid.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c")).select(
        *keys, "_b", F.coalesce(F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))
    inner = Window.partitionBy(*keys, "_b").orderBy(p, id_col)
    scaled = grid.join(sizes, [*keys, "_b"]).withColumn(
        "_v", F.col(p) * F.col("_n") / (F.col("_before") + F.row_number().over(inner)))
    floors = scaled.groupBy(*keys, "_b").agg(F.min("_v").alias("_m")).select(
        *keys, "_b", F.min("_m").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    here = F.min("_v").over(inner.rowsBetween(0, Window.unboundedFollowing))
    return scaled.withColumn("_here", here).join(floors, [*keys, "_b"]).withColumn(
        "q", F.least(F.lit(1.0), F.col("_here"), F.coalesce("_later", F.lit(1.0)))).drop(
        "_b", "_before", "_n", "_v", "_here", "_later")


def cohen_kappa(a: Column, b: Column) -> Column:
    """Aggregate: chance-corrected agreement of two 0/1 columns; null when agreement is certain by chance."""
    po = F.avg((a == b).cast("double"))
    pa, pb = F.avg(a.cast("double")), F.avg(b.cast("double"))
    pe = pa * pb + (1 - pa) * (1 - pb)
    return F.when(F.abs(pe - 1.0) > 1e-8, (po - pe) / (1 - pe))


def weighted_mean(value: Column, weight: Column) -> Column:
    return ratio(F.sum(value * weight), F.sum(weight))
