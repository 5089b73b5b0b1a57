"""Blueprint cells, low-difference selection and mass-restoring weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import coin, draw_key, take_count, tile
from ..functions.ranks import hash_row_number, value_row_number


def _cells(items: DataFrame, keys: Sequence[str], group: str, value: str, strata: int, label: str,
           rows: int | None = None) -> DataFrame:
    ranked = value_row_number(items, [*keys, group], value, "item_id", rows=rows)
    stratum = tile(F.col("rn"), F.col("rn_of"), F.lit(strata))
    return ranked.withColumn(
        label, F.concat_ws("|", F.col(group).cast("string"), stratum.cast("string"))).drop("rn", "rn_of")


def difficulty_cells(items: DataFrame, value: str = "intercept", strata: int = 4,
                     keys: Sequence[str] = ("half",), group: str = "item_group", rows: int | None = None) -> DataFrame:
    """Near-equal easiness strata inside each item group; ties by item id. `rows`: counted table size, if known."""
    return _cells(items, keys, group, value, strata, "cell", rows)


def discrimination_cells(items: DataFrame, value: str = "discrimination", strata: int = 4,
                         keys: Sequence[str] = ("half",)) -> DataFrame:
    """Near-equal discrimination strata inside each blueprint cell."""
    return _cells(items, keys, "cell", value, strata, "disc_cell")


def anchor_select(items: DataFrame, fraction: float | Column, value: str = "magnitude",
                  keys: Sequence[str] = ("half",), rows: int | None = None) -> DataFrame:
    """Lowest-value share of each cell; the chosen items carry the mass of their cell."""
    ranked = value_row_number(items, [*keys, "cell"], value, "item_id", rows=rows)
    n = F.col("rn_of")
    k = take_count(fraction, n)
    chosen = F.col("rn") <= k
    return (
        ranked.withColumn("selected", chosen)
        .withColumn("weight", F.when(chosen, n / k).otherwise(F.lit(0.0)).cast("double"))
        .drop("rn", "rn_of"))


def high_mask(items: DataFrame, fraction: float, value: str, keys: Sequence[str] = ("cell",),
              name: str = "high") -> DataFrame:
    """Mark the highest-value share of each cell; ties by item id."""
    ranked = value_row_number(items, keys, value, "item_id", descending=True)
    return ranked.withColumn(name, F.col("rn") <= take_count(fraction, F.col("rn_of"))).drop("rn", "rn_of")


def replicated(df: DataFrame, replicates: int) -> DataFrame:
    """One copy of each row per replicate number 1..R."""
    return df.withColumn("replicate", F.explode(
        F.sequence(F.lit(1).cast("bigint"), F.lit(replicates).cast("bigint"))))


def matched_random_weights(anchors: DataFrame, replicates: int, seed: int,
                           keys: Sequence[str] = ("half",)) -> DataFrame:
    """Random members with the template's count and weight in every cell, R draws.

    Returns only the drawn items (weight zero is absence).
    """
    keys = list(keys)
    template = anchors.groupBy(*keys, "cell").agg(
        F.count_if("selected").alias("_k"), F.count(F.lit(1)).alias("_n"))
    drawn = hash_row_number(
        replicated(anchors.select(*keys, "cell", "item_id"), replicates),
        [*keys, "replicate", "cell"], draw_key(seed, *keys, "replicate", "item_id"), "item_id")
    return (
        drawn.join(template, [*keys, "cell"]).filter(F.col("rn") <= F.col("_k"))
        .select(*keys, "replicate", "item_id", "cell", (F.col("_n") / F.col("_k")).alias("weight")))


def discrimination_matched_weights(anchors: DataFrame, replicates: int, seed: int,
                                   keys: Sequence[str] = ("half",)) -> DataFrame:
    """As above with counts matched per discrimination cell and weights kept per blueprint cell."""
    keys = list(keys)
    fine = anchors.groupBy(*keys, "cell", "disc_cell").agg(F.count_if("selected").alias("_k"))
    coarse = anchors.groupBy(*keys, "cell").agg(
        (F.count(F.lit(1)) / F.count_if("selected")).alias("weight"))
    drawn = hash_row_number(
        replicated(anchors.select(*keys, "cell", "disc_cell", "item_id"), replicates),
        [*keys, "replicate", "disc_cell"], draw_key(seed, *keys, "replicate", "item_id"), "item_id")
    return (
        drawn.join(fine, [*keys, "cell", "disc_cell"]).filter(F.col("rn") <= F.col("_k"))
        .join(coarse, [*keys, "cell"])
        .select(*keys, "replicate", "item_id", "cell", "weight"))


def composition_units(items: DataFrame, clusters: int, group: str = "item_group",
                      min_groups: int = 5) -> DataFrame:
    """Native groups when there are at least five, else contiguous item clusters."""
    if clusters < 20:
        raise ValueError("item bootstrap needs at least 20 clusters")
    groups = items.select(group).distinct().count()
    placed = value_row_number(items.withColumn("_all", F.lit(1)), ["_all"], "item_id", "item_id", grid=1 / 4096)
    n = F.col("rn_of")
    cluster = F.floor((F.col("rn") - 1) * F.least(F.lit(clusters).cast("bigint"), n) / n)
    native = groups >= min_groups
    unit = F.col(group).cast("string") if native else F.concat(
        F.lit("item_cluster_"), F.lpad(cluster.cast("string"), 3, "0"))
    return (placed.withColumn("unit", unit)
            .withColumn("strategy", F.lit("native_source_block" if native else "contiguous_item_cluster"))
            .drop("_all", "rn", "rn_of"))


def center_within(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Subtract the mean of each `keys` group; means are map-side aggregates joined back."""
    means = df.groupBy(*keys).agg(*[F.avg(v).alias(f"_m_{v}") for v in values])
    out = df.join(means, list(keys))
    for v in values:
        out = out.withColumn(v, F.col(v) - F.col(f"_m_{v}"))
    return out.drop(*[f"_m_{v}" for v in values])


def swap_weights(weights: DataFrame, pairs: DataFrame, replicates: int, seed: int,
                 complement: bool = False, keys: Sequence[str] = ("half",)) -> DataFrame:
    """Move an anchor's weight to its paired control by a keyed coin, R draws.

    `weights`: selected items (keys, item_id, cell, weight). `pairs`: (keys, item_id, control_id).
    """
    keys = list(keys)
    flip = coin(seed, *keys, "replicate", "item_id")
    take = (flip == 0) if complement else (flip == 1)
    moved = replicated(weights.join(pairs, [*keys, "item_id"], "left"), replicates)
    target = F.when(F.col("control_id").isNotNull() & take, F.col("control_id")).otherwise(F.col("item_id"))
    return moved.select(*keys, "replicate", target.alias("item_id"), "cell", "weight")


def weight_invariants(weights: DataFrame, anchors: DataFrame, keys: Sequence[str] = ("half",)) -> DataFrame:
    """Violations per (keys, replicate): negative weight, cell count, cell mass, total mass."""
    keys = list(keys)
    want = anchors.groupBy(*keys, "cell").agg(
        F.count_if("selected").alias("_k"), F.count(F.lit(1)).alias("_n"))
    got = weights.groupBy(*keys, "replicate", "cell").agg(
        F.count(F.lit(1)).alias("_c"), F.sum("weight").alias("_w"), F.min("weight").alias("_low"))
    joined = got.join(want, [*keys, "cell"])
    return joined.groupBy(*keys, "replicate").agg(
        F.count_if(F.col("_low") < 0).alias("negative"),
        F.count_if(F.col("_c") != F.col("_k")).alias("cell_count"),
        F.count_if(F.abs(F.col("_w") - F.col("_n")) > 1e-9).alias("cell_mass"),
        F.round(F.sum("_w"), 6).alias("total_mass"),
        F.sum("_n").alias("items"))


def anchor_jaccard(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("half",)) -> DataFrame:
    """Overlap of two selected item sets."""
    keys = list(keys)
    a = left.filter("selected").select(*keys, "item_id", F.lit(1).alias("_a"))
    b = right.filter("selected").select(*keys, "item_id", F.lit(1).alias("_b"))
    both = F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return a.join(b, [*keys, "item_id"], "full").groupBy(*keys).agg(
        both.alias("shared"), F.count(F.lit(1)).alias("either"),
        (both / F.count(F.lit(1))).alias("jaccard"))


