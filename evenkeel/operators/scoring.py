"""Model scores, shifts and group aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import percentile_rank

MODEL_BLOCK = 2048


def full_scores(responses: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean correctness per model."""
    return responses.groupBy(*keys, "model_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("s"), F.avg("y").alias("acc"))


def weighted_accuracy(responses: DataFrame, weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean correctness; scores are rounded to 12 digits so that ties are exact."""
    keys = list(keys)
    w = weights.select(*keys, "item_id", "weight")
    return responses.join(w, [*keys, "item_id"]).groupBy(*keys, "model_id").agg(
        F.round(F.sum(F.col("weight") * F.col("y")) / F.sum("weight"), 12).alias("score"))


def replicate_scores(responses: DataFrame, weights: DataFrame, keys: Sequence[str] = ("half",),
                     n_models: int | None = None) -> DataFrame:
    """Scores of every (replicate, model) as a block matrix product.

    A join would move replicates x items x models rows. Here Spark joins packed
    weights and packed successes by item; each Arrow batch of packed rows is one
    bounded tile, multiplied where it lies into partial sums that a second,
    map-side combined aggregation adds up.
    """
    keys = list(keys)
    if n_models is None:
        n_models = responses.select("model_id").distinct().count()
    blocks = max(1, -(-n_models // MODEL_BLOCK))
    total = weights.groupBy(*keys, "replicate").agg(F.sum("weight").alias("_total"))
    packed_w = weights.groupBy(*keys, "item_id").agg(
        F.collect_list("replicate").alias("reps"), F.collect_list("weight").alias("ws"))
    packed_y = (
        responses.filter("y = 1")
        .withColumn("_mb", F.pmod(F.xxhash64("model_id"), F.lit(blocks)))
        .groupBy(*keys, "item_id", "_mb").agg(F.collect_list("model_id").alias("models")))
    tiles = packed_y.join(packed_w, [*keys, "item_id"])
    key_types = "".join(f"{k} {responses.schema[k].dataType.simpleString()}, " for k in keys)
    model_type = responses.schema["model_id"].dataType.simpleString()

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby([*keys, "_mb"], sort=False):
                reps, r_at = np.unique(np.concatenate(rows["reps"].to_numpy()), return_inverse=True)
                models, m_at = np.unique(np.concatenate(rows["models"].to_numpy()), return_inverse=True)
                at = np.arange(len(rows))
                w = np.zeros((len(rows), len(reps)))
                y = np.zeros((len(rows), len(models)))
                w[np.repeat(at, rows["reps"].map(len)), r_at] = np.concatenate(rows["ws"].to_numpy())
                y[np.repeat(at, rows["models"].map(len)), m_at] = 1.0
                part = w.T @ y
                out = {k: np.repeat(np.asarray([v]), part.size) for k, v in zip(keys, key)}
                out["replicate"] = np.repeat(reps, len(models))
                out["model_id"] = np.tile(models, len(reps))
                out["part"] = part.ravel()
                yield pd.DataFrame(out)

    parts = tiles.mapInPandas(multiply, f"{key_types}replicate bigint, model_id {model_type}, part double")
    sums = parts.groupBy(*keys, "replicate", "model_id").agg(F.sum("part").alias("_s"))
    grid = responses.select(*keys, "model_id").distinct().join(total, keys)
    return grid.join(sums, [*keys, "replicate", "model_id"], "left").select(
        *keys, "replicate", "model_id",
        F.round(F.coalesce("_s", F.lit(0.0)) / F.col("_total"), 12).alias("score"))


def score_shift_table(scored: DataFrame, keys: Sequence[str] = ("half",)) -> DataFrame:
    """Low-minus-full score and percentile shift per model."""
    out = percentile_rank(percentile_rank(scored, keys, "full_score", "full_pct"), keys, "low_score", "low_pct")
    return (out.withColumn("score_shift", F.col("low_score") - F.col("full_score"))
            .withColumn("percentile_shift", F.col("low_pct") - F.col("full_pct")))


def family_shifts(shifts: DataFrame, keys: Sequence[str] = ("half",)) -> DataFrame:
    """Mean and median percentile shift and mean score shift (points) per family."""
    return shifts.groupBy(*keys, "family").agg(
        F.count(F.lit(1)).alias("representatives"),
        F.avg("percentile_shift").alias("mean_percentile_shift"),
        F.percentile("percentile_shift", 0.5).alias("median_percentile_shift"),
        (100.0 * F.avg("score_shift")).alias("mean_score_shift_points"))


def family_shift_range(shifts: DataFrame, keys: Sequence[str] = ("half",)) -> DataFrame:
    """Spread of the family mean shifts."""
    per = shifts.groupBy(*keys, "family").agg(
        F.avg("score_shift").alias("_s"), F.avg("percentile_shift").alias("_p"))
    return per.groupBy(*keys).agg(
        (100.0 * (F.max("_s") - F.min("_s"))).alias("score_shift_range_points"),
        (F.max("_p") - F.min("_p")).alias("percentile_shift_range"))


def source_aggregates(responses: DataFrame, units: DataFrame, weights: DataFrame,
                      keys: Sequence[str] = ("half",)) -> DataFrame:
    """Per unit and model: successes and mass, plain and weighted.

    `units` maps item_id to unit; `weights` holds one row per (keys, item).
    """
    keys = list(keys)
    return (
        responses.join(units.select("item_id", "unit"), "item_id")
        .join(weights.select(*keys, "item_id", "weight"), [*keys, "item_id"])
        .groupBy(*keys, "unit", "model_id").agg(
            F.sum("y").cast("bigint").alias("full_success"), F.count(F.lit(1)).alias("full_mass"),
            F.sum(F.col("weight") * F.col("y")).alias("low_success"), F.sum("weight").alias("low_mass")))


