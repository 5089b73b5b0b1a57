"""Replication of item effects between owner halves and attribution of score shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.inference import binomial_greater
from ..functions.ranks import average_rank, spearman
from .blueprint import center_within, difficulty_cells, high_mask
from .newton import dif_magnitude
from ..session import cut
from .resampling import permute_within

HALVES = ("discovery", "validation")
TOP_FRACTION = 0.20
MIN_GROUP_ITEMS = 20
PER_TAIL = 2
# Thresholds of the stability gates.
GATES = {"median_family_spearman": 0.20, "overlap": 0.30, "agreement": 0.40, "p": 0.05}


def both_halves(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, discovery, validation): one value per half side by side."""
    one = lambda h: df.filter(F.col("half") == h).select(*keys, F.col(value).alias(h))
    return one("discovery").join(one("validation"), list(keys))


def common_cells(items: DataFrame, strata: int = 4, keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Blueprint cells from the mean intercept of the two halves."""
    mean = items.groupBy(*keys, "item_id", "item_group").agg(F.round(F.avg("intercept"), 12).alias("intercept"))
    return difficulty_cells(mean, "intercept", strata, keys).select(*keys, "item_id", "item_group", "cell")


def item_signatures(items: DataFrame, effects: DataFrame, families: Sequence[str], keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    """One wide row per item: cell, both magnitudes and every family effect of both halves."""
    keys = list(keys)
    wide = effects.groupBy(*keys, "item_id").pivot("half", list(HALVES)).agg(
        *[F.max(F.when(F.col("family") == f, F.col("effect"))).alias(f"{f}_effect") for f in families])
    return common_cells(items, keys=keys).join(
        both_halves(items, [*keys, "item_id"], "magnitude").withColumnRenamed("discovery", "discovery_magnitude")
        .withColumnRenamed("validation", "validation_magnitude"), [*keys, "item_id"]).join(wide, [*keys, "item_id"])


def rank_correlation(items: DataFrame, value: str, keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    return spearman(both_halves(items, [*keys, "item_id"], value), keys, *HALVES, "spearman")


def _tables(items: DataFrame, effects: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per item: high marks and advantaged families; per item and family: within-cell centred effects."""
    cells = common_cells(items, keys=keys)
    celled = items.select(*keys, "half", "item_id", "magnitude").join(cells, [*keys, "item_id"])
    high = high_mask(celled, TOP_FRACTION, "magnitude", [*keys, "half", "cell"])
    top = dif_magnitude(effects, [*keys, "half"]).select(*keys, "half", "item_id", "advantaged_family")
    marks = high.join(top, [*keys, "half", "item_id"])
    centred = center_within(celled, [*keys, "half", "cell"], ["magnitude"]).withColumn("magnitude", F.round("magnitude", 9))
    wide = both_halves(marks.withColumn("v", F.struct("high", "advantaged_family")), [*keys, "item_id", "cell"], "v").join(
        both_halves(centred, [*keys, "item_id"], "magnitude").withColumnRenamed("discovery", "_md").withColumnRenamed("validation", "_mv"),
        [*keys, "item_id"])
    table = wide.select(*keys, "item_id", "cell", F.col("discovery.high").alias("hd"), F.col("validation.high").alias("hv"),
                        F.col("discovery.advantaged_family").alias("ad"), F.col("validation.advantaged_family").alias("av"), "_md", "_mv")
    eff = center_within(effects.select(*keys, "half", "item_id", "family", "effect").join(cells, [*keys, "item_id"]),
                        [*keys, "half", "cell", "family"], ["effect"]).withColumn("effect", F.round("effect", 9))
    return table, both_halves(eff, [*keys, "item_id", "family"], "effect")


def _measures(marks: DataFrame, by: list[str], hv: Column, av: Column) -> DataFrame:
    stable = F.col("hd") & hv
    return marks.groupBy(*by).agg(
        F.count_if("hd").alias("high_items"), F.count_if(stable).alias("stable_items"),
        (F.count_if(stable) / F.count_if("hd")).alias("overlap"),
        (F.count_if(stable & (F.col("ad") == av)) / F.nullif(F.count_if(stable), F.lit(0))).alias("agreement"))


def signature_stability(items: DataFrame, effects: DataFrame, replicates: int, seed: int,
                        keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Within-cell rank correlations, top-share overlap and advantage agreement with permutation p values.

    Ranks are formed once; each replicate only re-pairs them inside cells.
    """


    keys = list(keys)
    marks, eff = _tables(items, effects, keys)
    marks = cut(average_rank(average_rank(marks, keys, "_md", "_rx"), keys, "_mv", "_ry"))
    by_family = [*keys, "family"]
    eff = cut(average_rank(average_rank(eff, by_family, "discovery", "_fx"), by_family, "validation", "_fy"))
    raw_m = rank_correlation(items, "magnitude", keys).select(*keys, F.col("spearman").alias("raw_magnitude_spearman"))
    raw_f = spearman(both_halves(effects, [*keys, "item_id", "family"], "effect"), by_family, *HALVES, "r").groupBy(*keys).agg(
        F.percentile("r", 0.5).alias("raw_median_family_spearman"))
    fam = eff.groupBy(*by_family).agg(F.corr("_fx", "_fy").alias("r")).groupBy(*keys).agg(
        F.round(F.percentile("r", 0.5), 12).alias("median_family_spearman"), F.min("r").alias("min_family_spearman"),
        F.max("r").alias("max_family_spearman"))
    mag = marks.groupBy(*keys).agg(F.round(F.corr("_rx", "_ry"), 12).alias("magnitude_spearman"), F.count(F.lit(1)).alias("items"))
    obs = cut(fam.join(mag, keys).join(_measures(marks, keys, F.col("hv"), F.col("av")), keys))

    shuffled = cut(permute_within(marks.select(*keys, "cell", "item_id", F.col("item_id").alias("other")), [*keys, "cell"],
                                  "item_id", ["other"], replicates, seed))
    other = marks.select(*keys, F.col("item_id").alias("other"), F.col("_ry").alias("_py"), F.col("hv").alias("ph"), F.col("av").alias("pa"))
    paired = shuffled.drop("cell").join(marks, [*keys, "item_id"]).join(other, [*keys, "other"])
    rep = [*keys, "replicate"]
    null_m = paired.groupBy(*rep).agg(F.round(F.corr("_rx", "_py"), 12).alias("n_mag"))
    null_h = _measures(paired, rep, F.col("ph"), F.col("pa")).select(*rep, F.col("overlap").alias("n_over"), F.col("agreement").alias("n_agree"))
    y = eff.select(*keys, "family", F.col("item_id").alias("other"), F.col("_fy").alias("_py"))
    null_f = shuffled.drop("cell").join(eff.select(*keys, "item_id", "family", "_fx"), [*keys, "item_id"]).join(
        y, [*keys, "family", "other"]).groupBy(*rep, "family").agg(F.corr("_fx", "_py").alias("r")).groupBy(*rep).agg(
        F.round(F.percentile("r", 0.5), 12).alias("n_fam"))
    null = null_m.join(null_h, rep).join(null_f, rep).join(obs, keys)
    p = lambda n, o: (1 + F.count_if(F.col(n) >= F.col(o))) / (1 + F.count(F.lit(1)))
    ps = null.groupBy(*keys).agg(p("n_fam", "median_family_spearman").alias("family_p"), p("n_mag", "magnitude_spearman").alias("magnitude_p"),
                                 p("n_over", "overlap").alias("overlap_p"), p("n_agree", "agreement").alias("agreement_p"))
    t = obs.join(ps, keys).join(raw_m, keys).join(raw_f, keys)
    gate = lambda v, g, q: (F.col(v) > GATES[g]) & (F.col(q) <= GATES["p"])
    t = (t.withColumn("passes_family", gate("median_family_spearman", "median_family_spearman", "family_p"))
         .withColumn("passes_overlap", gate("overlap", "overlap", "overlap_p"))
         .withColumn("passes_agreement", F.coalesce(gate("agreement", "agreement", "agreement_p"), F.lit(False))))
    return t.withColumn("passes_all", F.col("passes_family") & F.col("passes_overlap") & F.col("passes_agreement"))


def source_effects(effects: DataFrame, keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Mean effect per item group and family in both halves, after centring each family."""
    keys = list(keys)
    centred = center_within(effects, [*keys, "half", "family"], ["effect"])
    mean = centred.groupBy(*keys, "half", "family", "item_group").agg(
        F.round(F.avg("effect"), 12).alias("m"), F.count(F.lit(1)).alias("items"))
    return both_halves(mean, [*keys, "family", "item_group", "items"], "m")


def _tails(table: DataFrame, by: Sequence[str], names: tuple[str, str]) -> DataFrame:
    """The two lowest and two highest groups by discovery value; groups below twice that many are left out."""
    low = Window.partitionBy(*by).orderBy("discovery", "item_group")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    t = table.withColumn("_r", F.row_number().over(low)).withColumn("_n", n)
    side = F.when(F.col("_r") <= PER_TAIL, names[0]).when(F.col("_r") > F.col("_n") - PER_TAIL, names[1])
    return t.withColumn("direction", side).filter(F.col("direction").isNotNull() & (F.col("_n") >= 2 * PER_TAIL)).drop("_r", "_n").withColumn(
        "sign_replicated", F.col("discovery") * F.col("validation") > 0)


def source_extremes(table: DataFrame, keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    eligible = table.filter(F.col("items") >= MIN_GROUP_ITEMS)
    out = _tails(eligible, [*keys, "family"], ("disadvantage", "advantage"))
    return out.withColumn("attenuation", F.when(F.col("discovery") != 0, F.col("validation") / F.col("discovery")))


def source_effect_correlation(table: DataFrame, keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    return spearman(table, [*keys, "family"], *HALVES, "spearman").filter(F.col("n") >= 2).withColumnRenamed("n", "sources")


def shift_contributions(target: DataFrame, anchors: DataFrame, keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Exact additive contribution (points) of each item group to each family's low-minus-full shift.

    `half` is the audit half whose weights are applied to the opposite half's models.
    """
    fold = [*keys, "half"]
    n = anchors.groupBy(*fold).agg(F.count(F.lit(1)).alias("_n"))
    per_model = target.join(anchors.select(*fold, "item_id", "weight"), [*fold, "item_id"]).groupBy(
        *fold, "family", "model_id", "item_group").agg(
        F.sum((F.col("weight") - 1.0) * F.col("y")).alias("_c"), F.count(F.lit(1)).alias("source_items"))
    return per_model.join(n, fold).groupBy(*fold, "family", "item_group", "source_items").agg(
        (100.0 * F.avg(F.col("_c") / F.col("_n"))).alias("contribution_points"))


def contribution_check(contributions: DataFrame, shifts: DataFrame, keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    """Do the contributions sum to the direct family shift?"""
    by = [*keys, "half", "family"]
    total = contributions.groupBy(*by).agg(F.sum("contribution_points").alias("summed_points"))
    direct = shifts.groupBy(*by).agg((100.0 * F.avg("score_shift")).alias("direct_points"))
    return total.join(direct, by).withColumn("absolute_error", F.abs(F.col("summed_points") - F.col("direct_points")))


def contribution_extremes(contributions: DataFrame, keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    wide = both_halves(contributions.withColumn("contribution_points", F.round("contribution_points", 12)),
                       [*keys, "family", "item_group"], "contribution_points")
    return _tails(wide, [*keys, "family"], ("negative_contribution", "positive_contribution"))


def replication_summary(selected: DataFrame, pooled_name: str = "pooled") -> DataFrame:
    """Sign replications per benchmark and pooled, with an exact one-sided test."""
    per = selected.groupBy("benchmark").agg(F.count(F.lit(1)).alias("selected"), F.count_if("sign_replicated").alias("replicated"))
    pooled = per.agg(F.sum("selected").alias("selected"), F.sum("replicated").alias("replicated")).withColumn("benchmark", F.lit(pooled_name))
    both = per.unionByName(pooled.select(*per.columns))
    return both.withColumn("rate", F.col("replicated") / F.col("selected")).withColumn(
        "p", binomial_greater(F.col("replicated"), F.col("selected")))


def extreme_examples(selected: DataFrame, effects: DataFrame, k: int = 2, keys: Sequence[str] = ("benchmark",)) -> DataFrame:
    """The k items of each selected group whose effect replicates most strongly in its direction."""
    keys = list(keys)
    centred = center_within(effects, [*keys, "half", "family"], ["effect"]).withColumn("effect", F.round("effect", 9))
    wide = both_halves(centred, [*keys, "family", "item_group", "item_id"], "effect")
    sign = F.when(F.col("direction") == "advantage", 1.0).otherwise(-1.0)
    picked = selected.select(*keys, "family", "item_group", "direction")
    t = wide.join(picked, [*keys, "family", "item_group"]).withColumn(
        "strength", F.least(sign * F.col("discovery"), sign * F.col("validation")))
    w = Window.partitionBy(*keys, "family", "item_group", "direction").orderBy(F.col("strength").desc(), "item_id")
    return t.withColumn("example_rank", F.row_number().over(w)).filter(F.col("example_rank") <= k)


def stability_gates(stability: DataFrame, effects_summary: DataFrame, shifts_summary: DataFrame, needed: int = 3) -> DataFrame:
    """Study-level decisions: enough stable benchmarks; group effects and group shifts replicate."""
    def replicates(t: DataFrame, name: str) -> DataFrame:
        pooled = F.col("benchmark") == "pooled"
        return t.agg(
            (F.coalesce(F.max(F.when(pooled, F.col("rate"))) >= 0.70, F.lit(False))
             & F.coalesce(F.max(F.when(pooled, F.col("p"))) <= 0.05, F.lit(False))
             & (F.count_if(~pooled & (F.col("rate") >= 0.65)) >= 2)).alias("passes")).select(F.lit(name).alias("gate"), "passes")

    primary = stability.agg((F.count_if("passes_all") >= needed).alias("passes")).select(F.lit("stability").alias("gate"), "passes")
    return primary.unionByName(replicates(effects_summary, "group_effects")).unionByName(replicates(shifts_summary, "group_shifts"))
