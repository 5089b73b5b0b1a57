"""Pooling over folds and comparison of observed values with their nulls.

Counts are summed over folds before a rate is formed; tau-b is averaged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from .resampling import interval


def pooled_rates(frame: DataFrame, keys: Sequence[str], pairs: str, flips: str, name: str = "rate") -> DataFrame:
    """Pooled rate per `keys` (folds summed)."""
    return frame.groupBy(*keys).agg(
        F.sum(pairs).alias("pairs"), F.sum(flips).alias("flips"),
        ratio(F.sum(flips), F.sum(pairs)).alias(name))


def empirical_p(null: DataFrame, observed: DataFrame, keys: Sequence[str], value: str,
                two_sided: bool = False) -> DataFrame:
    """(1 + #{null >= observed}) / (1 + R); columns `observed` in `observed`, `value` in `null`."""
    v, o = F.col(value), F.col("observed")
    if two_sided:
        v, o = F.abs(v), F.abs(o)
    return null.join(observed, list(keys)).groupBy(*keys).agg(
        ((1 + F.count_if(v >= o)) / (1 + F.count(F.lit(1)))).alias("p"))


def reversal_summary(observed: DataFrame, controls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled rate against its matched-random null, with a status.

    No eligible pairs, or any undefined control, withholds the inference.
    """
    keys = list(keys)
    p, f = "close_cross_family_pairs", "close_cross_family_flips"
    obs = pooled_rates(observed, keys, p, f, "rate")
    null = pooled_rates(controls, [*keys, "replicate"], p, f, "null_rate").select(*keys, "replicate", "null_rate")
    t = obs.join(null, keys).groupBy(*keys).agg(
        F.first("pairs").alias("eligible_pairs"), F.first("flips").alias("reversals"),
        F.first("rate").alias("low_dif_reversal_rate"),
        F.count(F.lit(1)).alias("replicates"), F.count_if(F.col("null_rate").isNull()).alias("undefined_replicates"),
        F.percentile("null_rate", 0.5).alias("_median"),
        ((1 + F.count_if(F.col("null_rate") >= F.col("rate"))) / (1 + F.count(F.lit(1)))).alias("_p"))
    ok = (F.col("eligible_pairs") > 0) & (F.col("undefined_replicates") == 0)
    excess = 100.0 * (F.col("low_dif_reversal_rate") - F.col("_median"))
    return t.select(
        *keys, "eligible_pairs", "reversals", "low_dif_reversal_rate", "replicates", "undefined_replicates",
        F.when(ok, F.col("_median")).alias("random_median_rate"), F.when(ok, excess).alias("excess_pp"),
        F.when(ok, F.col("_p")).alias("p"),
        F.when(F.col("eligible_pairs") == 0, "insufficient_eligible_pairs")
        .when(~ok, "undefined_random_controls")
        .when((excess > 0) & (F.col("_p") <= 0.05), "excess_sensitivity_detected")
        .otherwise("no_significant_excess_detected").alias("status"))


def five_metrics(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """tau-b, two flip rates and two family shift ranges, pooled over folds, one row per metric."""
    wide = frame.groupBy(*keys).agg(
        F.avg("kendall_tau_b").alias("kendall_tau_b"),
        ratio(F.sum("cross_family_flips"), F.sum("cross_family_pairs")).alias("cross_family_flip_rate"),
        ratio(F.sum("close_cross_family_flips"), F.sum("close_cross_family_pairs")).alias("close_cross_family_flip_rate"),
        F.avg("score_shift_range_points").alias("score_shift_range_points"),
        F.avg("percentile_shift_range").alias("percentile_shift_range"))
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), names, "metric", "value").withColumn("value", F.round("value", 12))


def control_summary(observed: DataFrame, controls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed value, null median, interval and one-sided p for five metrics; low tau is extreme."""
    keys = list(keys)
    obs = five_metrics(observed, keys).withColumnRenamed("value", "observed")
    null = five_metrics(controls, [*keys, "replicate"])
    low = F.col("metric") == "kendall_tau_b"
    hit = F.when(low, F.col("value") <= F.col("observed")).otherwise(F.col("value") >= F.col("observed"))
    return null.join(obs, [*keys, "metric"]).groupBy(*keys, "metric").agg(
        F.first("observed").alias("observed"), F.percentile("value", 0.5).alias("random_median"),
        *interval(F.col("value"), "random"),
        ((1 + F.count_if(hit)) / (1 + F.count(F.lit(1)))).alias("p"),
        F.first(F.when(low, "control <= observed").otherwise("control >= observed")).alias("extreme_direction"),
        F.count(F.lit(1)).alias("replicates"))


def bootstrap_summary(bootstrap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """95 % ranges of mean tau-b and pooled near flip rate."""
    pooled = bootstrap.groupBy(*keys, "replicate").agg(
        F.avg("kendall_tau_b").alias("tau"),
        ratio(F.sum("close_cross_family_flips"), F.sum("close_cross_family_pairs")).alias("rate"))
    return pooled.groupBy(*keys).agg(
        *interval(F.col("tau"), "tau"), *interval(F.col("rate"), "close_flip"), F.count(F.lit(1)).alias("replicates"))


def owner_bootstrap_summary(shifts: DataFrame, bootstrap: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Family mean shifts with bootstrap intervals."""
    keys = [*keys, "family"]
    est = shifts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("representatives"), F.avg("percentile_shift").alias("mean_percentile_shift"),
        (100.0 * F.avg("score_shift")).alias("mean_score_shift_points"))
    ci = bootstrap.groupBy(*keys).agg(
        *interval(F.col("mean_percentile_shift"), "percentile_shift"),
        *interval(F.col("mean_score_shift_points"), "score_shift"))
    return est.join(ci, keys)


def gap_summary(observed: DataFrame, bootstrap: DataFrame, controls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed curve with bootstrap and control intervals, p and excess per gap."""
    by = [*keys, "gap"]
    obs = pooled_rates(observed, by, "pairs", "flips", "flip_rate")
    boot = pooled_rates(bootstrap, [*by, "replicate"], "pairs", "flips").groupBy(*by).agg(
        *interval(F.col("rate"), "bootstrap"), F.percentile("rate", 0.5).alias("bootstrap_median"))
    null = pooled_rates(controls, [*by, "replicate"], "pairs", "flips", "null").select(*by, "replicate", "null")
    ctl = null.join(obs, by).groupBy(*by).agg(
        *interval(F.col("null"), "random"), F.percentile("null", 0.5).alias("random_median"),
        ((1 + F.count_if(F.col("null") >= F.col("flip_rate"))) / (1 + F.count(F.lit(1)))).alias("p"))
    return obs.join(boot, by).join(ctl, by).withColumn("excess", F.col("flip_rate") - F.col("random_median"))


def within_family_summary(observed: DataFrame, controls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cross- and same-family excess and the paired specificity excess, all in points."""
    keys = list(keys)

    def rates(frame: DataFrame, by: list[str], tag: str) -> DataFrame:
        return frame.groupBy(*by).agg(
            F.sum("close_cross_family_pairs").alias(f"{tag}_cross_pairs"),
            F.sum("close_same_family_pairs").alias(f"{tag}_same_pairs"),
            ratio(F.sum("close_cross_family_flips"), F.sum("close_cross_family_pairs")).alias(f"{tag}_cross"),
            ratio(F.sum("close_same_family_flips"), F.sum("close_same_family_pairs")).alias(f"{tag}_same")
        ).withColumn(f"{tag}_gap", F.round(F.col(f"{tag}_cross") - F.col(f"{tag}_same"), 12))

    both = rates(controls, [*keys, "replicate"], "n").join(rates(observed, keys, "o"), keys)

    def p(kind: str) -> Column:
        return (1 + F.count_if(F.col(f"n_{kind}") >= F.col(f"o_{kind}"))) / (1 + F.count(F.lit(1)))

    t = both.groupBy(*keys).agg(
        *[F.first(f"o_{k}").alias(k) for k in ("cross_pairs", "same_pairs", "cross", "same", "gap")],
        *[F.percentile(f"n_{k}", 0.5).alias(f"_{k}") for k in ("cross", "same", "gap")],
        *[p(k).alias(f"_p_{k}") for k in ("cross", "same", "gap")], F.count(F.lit(1)).alias("replicates"))
    return t.select(
        *keys, F.col("cross_pairs").alias("cross_family_pairs"), F.col("same_pairs").alias("same_family_pairs"),
        F.col("cross").alias("cross_family_rate"), F.col("same").alias("same_family_rate"),
        (100 * (F.col("cross") - F.col("_cross"))).alias("cross_family_excess_points"),
        (100 * (F.col("same") - F.col("_same"))).alias("same_family_excess_points"),
        (100 * (F.col("gap") - F.col("_gap"))).alias("specificity_excess_points"),
        F.col("_p_cross").alias("cross_family_p"), F.col("_p_same").alias("same_family_p"),
        F.col("_p_gap").alias("specificity_p"), "replicates")


def variant_summary(observed: DataFrame, controls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Excess, p and significance per benchmark and population variant."""
    base = reversal_summary(observed, controls, keys)
    extra = observed.groupBy(*keys).agg(F.avg("kendall_tau_b").alias("mean_kendall_tau_b"))
    positive = F.col("low_dif_reversal_rate") > F.col("random_median_rate")
    return base.join(extra, list(keys)).select(
        *keys, "eligible_pairs", "reversals", "low_dif_reversal_rate", "random_median_rate", "p",
        "mean_kendall_tau_b", "replicates", positive.alias("positive_excess"),
        (positive & (F.col("p") <= 0.05)).alias("significant_positive_excess"))


def variant_criteria(summary: DataFrame, needed: int) -> DataFrame:
    """Direction and significance gates per variant."""
    t = summary.groupBy("variant").agg(
        F.count_if("positive_excess").alias("positive_benchmarks"),
        F.count_if("significant_positive_excess").alias("significant_benchmarks"))
    return t.withColumn("passes_direction_gate", F.col("positive_benchmarks") >= needed).withColumn(
        "passes_significance_gate", F.col("significant_benchmarks") >= needed)


def frozen_fold_inputs(frozen: DataFrame, again: DataFrame, keys: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Do recomputed scores reproduce the frozen ones? Counts of missing ids and differing values."""
    a = frozen.select(*keys, "model_id", F.col("score").alias("_a"))
    b = again.select(*keys, "model_id", F.col("score").alias("_b"))
    return a.join(b, [*keys, "model_id"], "full").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("models"), F.count_if(F.abs(F.col("_a") - F.col("_b")) > tolerance).alias("score_differs"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("missing"))
