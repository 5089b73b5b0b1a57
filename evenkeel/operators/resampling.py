"""Matched-random controls, bootstraps and permutation tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import draw_key, pick
from ..functions.ranks import hash_row_number, value_row_number
from ..session import cut
from .blueprint import matched_random_weights, replicated
from .pairs import gap_curve, near_pairs, pair_reversals, pairwise_reversals
from .scoring import family_shift_range, replicate_scores, score_shift_table


def resample_counts(units: DataFrame, unit: str, replicates: int, seed: int,
                    keys: Sequence[str] = ()) -> DataFrame:
    """Multinomial resample: how often each unit is drawn in each replicate.

    Every unit row is one draw slot, so the draws need no cross join.
    """
    keys = list(keys)
    distinct = units.select(*keys, unit).distinct()
    placed = hash_row_number(distinct, keys, draw_key(seed, *keys, unit, tag="slot"), unit) if keys else hash_row_number(
        distinct.withColumn("_h", F.lit(0)), ["_h"], draw_key(seed, unit, tag="slot"), unit)
    slots = placed.select(*keys, (F.col("rn") - 1).alias("_slot"), F.col("rn_of").alias("_n"), unit)
    drawn = replicated(slots, replicates).select(
        *keys, "replicate", pick(seed, F.col("_n"), *keys, "replicate", "_slot").alias("_slot"))
    return (
        drawn.groupBy(*keys, "replicate", "_slot").agg(F.count(F.lit(1)).alias("times"))
        .join(slots.select(*keys, "_slot", unit), [*keys, "_slot"]).drop("_slot"))


def _attach(scores: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replicate scores with the family, owner and full score of each model."""
    meta = scored.select(*keys, "model_id", "family", "owner", "full_score")
    return scores.withColumnRenamed("score", "low_score").join(meta, [*keys, "model_id"])


def control_scores(responses: DataFrame, anchors: DataFrame, scored: DataFrame, replicates: int,
                   seed: int, keys: Sequence[str] = ("half",)) -> DataFrame:
    """Scores of all models under every matched-random weighting."""
    weights = matched_random_weights(anchors, replicates, seed, keys)
    return _attach(replicate_scores(responses, weights, keys), scored, keys)


def control_metrics(control: DataFrame, keys: Sequence[str] = ("half",), gap: float = 0.01) -> DataFrame:
    """Reversals, tau-b and family shift ranges of every replicate."""
    by = [*keys, "replicate"]
    ranges = family_shift_range(score_shift_table(control, by), by)
    return pairwise_reversals(control, by, gap).join(ranges, by)


def matched_random_controls(responses: DataFrame, anchors: DataFrame, scored: DataFrame, replicates: int,
                            seed: int, keys: Sequence[str] = ("half",), gap: float = 0.01) -> DataFrame:
    return control_metrics(cut(control_scores(responses, anchors, scored, replicates, seed, keys)), keys, gap)


def gap_controls(control: DataFrame, gaps: Sequence[float], keys: Sequence[str] = ("half",)) -> DataFrame:
    """Gap curve of every random control."""
    return gap_curve(control, gaps, [*keys, "replicate"])


def composition_scores(aggregates: DataFrame, replicates: int, seed: int,
                       keys: Sequence[str] = ("half",)) -> DataFrame:
    """Full and weighted scores per bootstrap replicate, from per-unit aggregates.

    Items are reduced to units before the resample, so the facts are read once.
    """
    keys = list(keys)
    times = resample_counts(aggregates, "unit", replicates, seed, keys)
    t = F.col("times")
    return (
        aggregates.join(times, [*keys, "unit"]).groupBy(*keys, "replicate", "model_id").agg(
            F.round(F.sum(t * F.col("full_success")) / F.sum(t * F.col("full_mass")), 12).alias("full_score"),
            F.round(F.sum(t * F.col("low_success")) / F.sum(t * F.col("low_mass")), 12).alias("low_score")))


def composition_bootstrap(aggregates: DataFrame, scored: DataFrame, replicates: int, seed: int,
                          keys: Sequence[str] = ("half",), gap: float = 0.01) -> DataFrame:
    """Reversals and tau-b per replicate; the near-pair mask is frozen from the observed scores."""
    keys = list(keys)
    boot = cut(composition_scores(aggregates, replicates, seed, keys))
    meta = scored.select(*keys, "model_id", "family", "owner")
    free = pairwise_reversals(boot.join(meta, [*keys, "model_id"]), [*keys, "replicate"], gap).drop(
        "close_cross_family_pairs", "close_cross_family_flips",
        "close_same_family_pairs", "close_same_family_flips")
    mask = near_pairs(scored, gap, keys)
    near = pair_reversals(mask, boot, keys, ["replicate"], "full_score", "low_score").groupBy(
        *keys, "replicate").agg(
            F.count_if("counted").alias("close_cross_family_pairs"),
            F.count_if("flipped").alias("close_cross_family_flips"))
    return free.join(near, [*keys, "replicate"])


def gap_bootstrap(aggregates: DataFrame, scored: DataFrame, gaps: Sequence[float], replicates: int,
                  seed: int, keys: Sequence[str] = ("half",)) -> DataFrame:
    """Gap curve per bootstrap replicate over the frozen pairs of the widest gap."""
    keys = list(keys)
    boot = composition_scores(aggregates, replicates, seed, keys)
    mask = near_pairs(scored, max(gaps), keys)
    rev = pair_reversals(mask, boot, keys, ["replicate"], "full_score", "low_score")
    # Count per exact pair gap first; the few gap limits then sum those counts.
    per_gap = rev.groupBy(*keys, "replicate", F.col("gap").alias("_g")).agg(
        F.count_if("counted").alias("_p"), F.count_if("flipped").alias("_f"))
    limits = F.filter(F.array(*[F.lit(float(g)) for g in gaps]), lambda g: F.col("_g") <= g + 1e-12)
    return per_gap.withColumn("gap", F.explode(limits)).groupBy(*keys, "replicate", "gap").agg(
        F.sum("_p").alias("pairs"), F.sum("_f").alias("flips"))


def owner_bootstrap(shifts: DataFrame, replicates: int, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """Family mean shifts with owners drawn with replacement."""
    keys = list(keys)
    times = resample_counts(shifts, "owner", replicates, seed, keys)
    t = F.col("times")
    return (
        shifts.join(times, [*keys, "owner"]).groupBy(*keys, "replicate", "family").agg(
            (F.sum(t * F.col("percentile_shift")) / F.sum(t)).alias("mean_percentile_shift"),
            (100.0 * F.sum(t * F.col("score_shift")) / F.sum(t)).alias("mean_score_shift_points")))


def permute_within(df: DataFrame, keys: Sequence[str], id_col: str, payload: Sequence[str], replicates: int,
                   seed: int) -> DataFrame:
    """Shuffle `payload` inside `keys`, R draws: row k by id gets the payload of row k by hash."""
    keys = list(keys)
    by_id = value_row_number(df.withColumn("_v", F.col(id_col).cast("double")), keys, "_v", id_col,
                             name="_k", grid=1 / 1024).drop("_v", "_k_of")
    drawn = hash_row_number(
        replicated(df.select(*keys, id_col, *payload), replicates),
        [*keys, "replicate"], draw_key(seed, *keys, "replicate", id_col), id_col, name="_k")
    return drawn.select(*keys, "replicate", "_k", *payload).join(by_id.drop(*payload), [*keys, "_k"]).drop("_k")


def interval(values: Column, name: str) -> list[Column]:
    """Linear-interpolated 95 % percentile interval as two columns."""
    return [F.percentile(values, 0.025).alias(f"{name}_ci_low"), F.percentile(values, 0.975).alias(f"{name}_ci_high")]

