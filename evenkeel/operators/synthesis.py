"""Cross-benchmark tables and decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resampling import interval, resample_counts


def benchmark_synthesis(reversals: DataFrame, bootstrap: DataFrame, controls: DataFrame, observed: DataFrame,
                        key: str = "benchmark") -> DataFrame:
    """One row per benchmark: tau-b, pooled rates, bootstrap ranges, control median, excess and p."""
    tau = observed.groupBy(key).agg(F.avg("kendall_tau_b").alias("mean_kendall_tau_b"))
    metric = lambda m, c, n: F.max(F.when(F.col("metric") == m, F.col(c))).alias(n)
    ctl = controls.groupBy(key).agg(
        metric("cross_family_flip_rate", "observed", "cross_family_flip_rate"),
        metric("score_shift_range_points", "observed", "score_shift_range_points"),
        metric("score_shift_range_points", "p", "score_shift_range_p"))
    base = reversals.select(key, "eligible_pairs", "reversals", "low_dif_reversal_rate", "random_median_rate", "excess_pp", "p", "status")
    return base.join(bootstrap.drop("replicates"), key).join(ctl, key).join(tau, key)


def common_models(shifts: DataFrame, left: str, right: str) -> DataFrame:
    """Score shifts of two benchmarks on exactly shared (model, owner, family) rows of one fold."""
    on = ["half", "model_id", "owner", "family"]
    one = lambda b, n: shifts.filter(F.col("benchmark") == b).select(*on, F.col("score_shift").alias(n))
    return one(left, "left_shift").join(one(right, "right_shift"), on).withColumn("pair", F.lit(f"{left} vs {right}"))


def _family_means(common: DataFrame, by: Sequence[str], weight=None) -> DataFrame:
    t = F.lit(1) if weight is None else F.col(weight)
    mean = lambda c: 100.0 * F.sum(t * F.col(c)) / F.sum(t)
    return common.groupBy(*by, "family").agg(mean("left_shift").alias("l"), mean("right_shift").alias("r"))


def common_family_shifts(common: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Family mean shifts on shared models with owner bootstrap intervals, per pair and family."""
    est = common.groupBy("pair", "family").agg(
        (100.0 * F.avg("left_shift")).alias("left_shift_points"), (100.0 * F.avg("right_shift")).alias("right_shift_points"),
        F.count(F.lit(1)).alias("n_common_models"), F.countDistinct("owner").alias("n_common_owners"))
    times = resample_counts(common, "owner", replicates, seed, ["pair"])
    boot = _family_means(common.join(times, ["pair", "owner"]), ["pair", "replicate"], "times").withColumn("d", F.col("r") - F.col("l"))
    ci = boot.groupBy("pair", "family").agg(*interval(F.col("l"), "left"), *interval(F.col("r"), "right"), *interval(F.col("d"), "difference"),
                                            F.count(F.lit(1)).alias("replicates"))
    return est.join(ci, ["pair", "family"]).withColumn("right_minus_left_points", F.col("right_shift_points") - F.col("left_shift_points"))


def common_contrast(common: DataFrame, plus: str, minus: str, replicates: int, seed: int) -> DataFrame:
    """Contrast of two families per pair and side, with owner bootstrap intervals.

    Replicates without one of the two families are left out, as is their count.
    """
    def contrast(means: DataFrame, by: Sequence[str]) -> DataFrame:
        pick = lambda f, c: F.max(F.when(F.col("family") == f, F.col(c)))
        t = means.groupBy(*by).agg((pick(plus, "l") - pick(minus, "l")).alias("left"), (pick(plus, "r") - pick(minus, "r")).alias("right"))
        return t.filter(F.col("left").isNotNull()).withColumn("difference", F.col("right") - F.col("left"))

    def tall(t: DataFrame, by: Sequence[str], value: str) -> DataFrame:
        return t.unpivot(list(by), ["left", "right", "difference"], "side", value)

    est = tall(contrast(_family_means(common, ["pair"]), ["pair"]), ["pair"], "estimate_points")
    times = resample_counts(common, "owner", replicates, seed, ["pair"])
    boot = contrast(_family_means(common.join(times, ["pair", "owner"]), ["pair", "replicate"], "times"), ["pair", "replicate"])
    ci = tall(boot, ["pair", "replicate"], "v").groupBy("pair", "side").agg(*interval(F.col("v"), "owner_bootstrap"), F.count(F.lit(1)).alias("replicates"))
    n = common.groupBy("pair").agg(F.count(F.lit(1)).alias("n_common_models"), F.countDistinct("owner").alias("n_common_owners"))
    return est.join(ci, ["pair", "side"]).join(n, "pair")


def ranking_gate(observed: DataFrame, bootstrap: DataFrame, controls: DataFrame, primary: float, key: str = "benchmark") -> DataFrame:
    """Six frozen components and the decision, per benchmark.

    `observed` holds all fractions; `bootstrap` and `controls` the primary one.
    """
    per = observed.groupBy(key, "fraction").agg(
        F.avg("kendall_tau_b").alias("tau"), F.sum("close_cross_family_pairs").alias("pairs"),
        (F.sum("close_cross_family_flips") / F.sum("close_cross_family_pairs")).alias("rate"))
    main = F.col("fraction") == primary
    t = per.groupBy(key).agg(
        F.max(F.when(main, F.col("tau"))).alias("tau"), F.max(F.when(main, F.col("rate"))).alias("rate"),
        F.max(F.when(main, F.col("pairs"))).alias("pairs"),
        F.coalesce(F.min(F.when(~main, ((F.col("tau") <= 0.97) & (F.col("rate") >= 0.075)).cast("int"))) == 1, F.lit(True)).alias("sensitivity_consistent"))
    strong = controls.filter(F.col("metric").isin("close_cross_family_flip_rate", "score_shift_range_points")).groupBy(key).agg(
        (F.max("p") <= 0.01).alias("controls_support"))
    t = t.join(bootstrap.select(key, "tau_ci_high", "close_flip_ci_low"), key).join(strong, key).select(
        key, (F.col("tau") <= 0.95).alias("tau_le_095"), (F.col("rate") >= 0.10).alias("flip_rate_ge_010"),
        (F.col("tau_ci_high") < 0.98).alias("bootstrap_tau_lt_098"), (F.col("close_flip_ci_low") > 0.05).alias("bootstrap_flip_gt_005"),
        "sensitivity_consistent", (F.col("pairs") >= 50).alias("at_least_50_pairs"), "controls_support")
    go = (F.col("tau_le_095") & F.col("flip_rate_ge_010") & F.col("bootstrap_tau_lt_098") & F.col("bootstrap_flip_gt_005")
          & F.col("sensitivity_consistent") & F.col("at_least_50_pairs"))
    return t.withColumn("decision", F.when(go, "go").when(F.col("controls_support"), "narrow_go").otherwise("no_go"))
