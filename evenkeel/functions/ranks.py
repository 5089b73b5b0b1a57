"""Ranking helpers that stay whole under a hot group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# A table proven to hold at most this many rows is ranked by a plain window.
ONE_TASK_ROWS = 1_000_000


def bucketed_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str = "rn",
    rows: int | None = None,
) -> DataFrame:
    """row_number over `keys`, spread over buckets of the sort value.

    `bucket` must not decrease along `order`. Bucket counts are pre-aggregated on
    the map side; their running sum gives each bucket its offset. A group with a
    third of all rows is thus sorted by as many tasks as it has buckets. With a
    counted `rows` below the one-task bound the buckets are left out.
    """
    keys = list(keys)
    if rows is not None and rows <= ONE_TASK_ROWS:
        w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return df.withColumn(name, F.row_number().over(w.orderBy(*order)).cast("bigint")).withColumn(
            f"{name}_of", F.count(F.lit(1)).over(w))
    df = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sizes = (
        df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
                F.sum("_c").over(whole).alias("_group_n"))
    )
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return (
        df.join(sizes, [*keys, "_bucket"])
        .withColumn(name, (F.col("_before") + inside).cast("bigint"))
        .withColumn(f"{name}_of", F.col("_group_n").cast("bigint"))
        .drop("_bucket", "_before", "_group_n")
    )


def hash_row_number(df: DataFrame, keys: Sequence[str], key: Column, id_col: str,
                    name: str = "rn") -> DataFrame:
    """1-based random position inside `keys` by a keyed hash, with the group size `<name>_of`."""
    df = df.withColumn("_draw", key)
    return bucketed_row_number(df, keys, [F.col("_draw"), F.col(id_col)],
                               F.substring("_draw", 1, 2), name).drop("_draw")


def value_row_number(df: DataFrame, keys: Sequence[str], value: str, id_col: str,
                     descending: bool = False, name: str = "rn", grid: float = 256.0,
                     rows: int | None = None) -> DataFrame:
    """1-based position inside `keys` by (value, id), with the group size `<name>_of`."""
    v = -F.col(value) if descending else F.col(value)
    return bucketed_row_number(df, keys, [v, F.col(id_col)], F.floor(v * F.lit(float(grid))), name, rows)


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Average rank of ties inside `keys` (1-based) with the group size `<name>_of`.

    Ranks are computed on value counts, so equal values travel as one row.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys)
    below = w.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
        .select(*keys, value,
                (F.coalesce(F.sum("_c").over(below), F.lit(0)) + (F.col("_c") + 1) / 2.0).alias(name),
                F.sum("_c").over(w).cast("bigint").alias(f"{name}_of"))
    )
    return df.join(counts, [*keys, value])


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Average rank scaled to [0, 1]; a single row gets one half."""
    ranked = average_rank(df, keys, value, "_ar")
    return ranked.withColumn(
        name, F.when(F.col("_ar_of") == 1, F.lit(0.5)).otherwise(
            (F.col("_ar") - 1.0) / (F.col("_ar_of") - 1.0))).drop("_ar", "_ar_of")


def spearman(df: DataFrame, keys: Sequence[str], left: str, right: str, name: str = "rho") -> DataFrame:
    """Rank correlation per `keys`; zero when a side is constant (as for null-size rank vectors)."""
    ranked = average_rank(average_rank(df, keys, left, "_rl"), keys, right, "_rr")
    a, b = F.col("_rl"), F.col("_rr")
    cov = F.covar_pop(a, b)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return ranked.groupBy(*keys).agg(
        F.when(spread > 0, cov / spread).otherwise(F.lit(0.0)).alias(name),
        F.count(F.lit(1)).alias("n"))
