"""Item discrimination, score reliability and their balance under re-weighting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .pairs import pairwise_reversals
from .scoring import replicate_scores


def item_total_correlation(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation of each item with the total of all other items, in closed form.

    Only model totals are joined back; no item meets another item.
    """
    keys = list(keys)
    total = cells.groupBy(*keys, "model_id").agg(F.sum("y").cast("double").alias("t"))
    whole = total.groupBy(*keys).agg(F.sum("t").alias("st"), F.sum(F.col("t") * F.col("t")).alias("stt"), F.count(F.lit(1)).alias("m"))
    item = cells.join(total, [*keys, "model_id"]).groupBy(*keys, "item_id").agg(
        F.sum("y").cast("double").alias("sy"), F.sum(F.col("y") * F.col("t")).alias("syt")).join(whole, keys)
    n, sy, syt = F.col("m"), F.col("sy"), F.col("syt")
    sx, sxx, sxy = F.col("st") - sy, F.col("stt") - 2 * syt + sy, syt - sy
    under = F.sqrt(F.greatest((sxx - sx * sx / n) * (sy - sy * sy / n), F.lit(0.0)))
    r = F.when(under > 0, (sxy - sx * sy / n) / under).otherwise(0.0)
    return item.select(*keys, "item_id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)).alias("citc"))


def spectral_discrimination(offsets: DataFrame, keys: Sequence[str], value: str = "offset") -> DataFrame:
    """Spread of the predicted offsets of each item."""
    return offsets.groupBy(*keys, "item_id").agg(F.stddev_pop(value).alias("discrimination"))


def item_statistics(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample variance of each item over the scored models."""
    return cells.groupBy(*keys, "item_id").agg(F.var_samp("y").alias("variance"))


def weighted_mean(items: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str = "weight") -> DataFrame:
    w = F.col(weight)
    return items.groupBy(*keys).agg(*[(F.sum(w * F.col(v)) / F.sum(w)).alias(f"mean_{v}") for v in values])


def sem_and_size() -> list[Column]:
    """Aggregates over (weight, variance): independent-item score SEM, effective items, selected items."""
    w, v = F.col("weight"), F.col("variance")
    return [(F.sqrt(F.greatest(F.sum(w * w * v), F.lit(0.0))) / F.sum(w)).alias("score_sem"),
            (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_items"),
            F.count_if(w > 0).alias("n_selected")]


def weighted_alpha(items: DataFrame, scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cronbach alpha of weighted items; null below 2 items, 3 models or without score variance.

    `items`: (keys, item_id, weight, variance). `scores`: (keys, model_id, score) on the normalized scale.
    """
    keys = list(keys)
    w = F.col("weight")
    a = items.filter(w > 0).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum(w * w * F.col("variance")).alias("iv"), F.sum(w).alias("sw"))
    b = scores.groupBy(*keys).agg(F.var_samp("score").alias("sv"), F.count(F.lit(1)).alias("m"))
    total = F.col("sv") * F.col("sw") * F.col("sw")
    k = F.col("k")
    return a.join(b, keys).select(*keys, F.when(
        (k >= 2) & (F.col("m") >= 3) & (total > 0), k / (k - 1.0) * (1.0 - F.col("iv") / total)).alias("weighted_alpha"))


def evaluate_weights(cells: DataFrame, weights: DataFrame, items: DataFrame, scored: DataFrame, keys: Sequence[str],
                     gap: float = 0.01, balance: Sequence[str] = ("discrimination", "citc")) -> DataFrame:
    """Reversals, balance and reliability of every replicate weighting.

    `weights`: drawn items only. `items`: (keys, item_id, variance, balance columns).
    """
    keys = list(keys)
    by = [*keys, "replicate"]
    scores = cut(replicate_scores(cells, weights, keys))
    meta = scored.select(*keys, "model_id", "family", "owner", "full_score")
    reversals = pairwise_reversals(scores.withColumnRenamed("score", "low_score").join(meta, [*keys, "model_id"]), by, gap)
    table = weights.join(items, [*keys, "item_id"])
    quality = table.groupBy(*by).agg(
        *[(F.sum(F.col("weight") * F.col(b)) / F.sum("weight")).alias(f"mean_{b}") for b in balance], *sem_and_size())
    alpha = weighted_alpha(table, scores, by)
    return reversals.join(quality, by).join(alpha, by)


def null_comparison(observed: DataFrame, original: DataFrame, matched: DataFrame, keys: Sequence[str],
                    metrics: Sequence[str]) -> DataFrame:
    """Observed near-pair rate and balance metrics against two nulls: medians, excess points, p, ratios."""
    keys = list(keys)

    def pooled(frame: DataFrame, by: list[str]) -> DataFrame:
        return frame.groupBy(*by).agg(
            (F.sum("close_cross_family_flips") / F.sum("close_cross_family_pairs")).alias("rate"),
            *[F.avg(m).alias(m) for m in metrics])

    def medians(frame: DataFrame, tag: str) -> DataFrame:
        return pooled(frame, [*keys, "replicate"]).groupBy(*keys).agg(
            *[F.percentile(m, 0.5).alias(f"{tag}_{m}") for m in ("rate", *metrics)])

    obs = pooled(observed, keys)
    null = pooled(matched, [*keys, "replicate"]).select(*keys, F.col("rate").alias("_n")).join(obs.select(*keys, "rate"), keys)
    p = null.groupBy(*keys).agg(
        ((1 + F.count_if(F.col("_n") >= F.col("rate"))) / (1 + F.count(F.lit(1)))).alias("matched_p"),
        F.count(F.lit(1)).alias("replicates"))
    t = obs.join(medians(original, "original"), keys).join(medians(matched, "matched"), keys).join(p, keys)
    return t.select(
        *keys, F.col("rate").alias("low_dif_rate"), F.col("original_rate").alias("original_random_median"),
        F.col("matched_rate").alias("matched_random_median"),
        (100 * (F.col("rate") - F.col("original_rate"))).alias("original_excess_points"),
        (100 * (F.col("rate") - F.col("matched_rate"))).alias("matched_excess_points"), "matched_p", "replicates",
        *[F.when(F.col(f"matched_{m}") != 0, F.col(m) / F.col(f"matched_{m}")).alias(f"ratio_{m}") for m in metrics])
