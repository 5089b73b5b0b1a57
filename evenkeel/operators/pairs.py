"""Order reversals between two scores of the same models.

Pairs are counted, not listed. A discordant pair is a point that lies left of
and above another one, so the counts are two-dimensional dominance counts:
every point is sent to the O(log n) blocks of its rank where it can be the
left or the right partner, and one running count per block does the rest.
Pairs that share an owner or a family are counted the same way inside that
owner or family and taken off (inclusion-exclusion).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import ratio

SCALE = 10 ** 12


def _grid(x: str) -> Column:
    return F.round(F.col(x) * SCALE, 0).cast("bigint")


def dominance_counts(scored: DataFrame, keys: Sequence[str], x: str, y: str,
                     gaps: Sequence[float] = ()) -> DataFrame:
    """Concordant and discordant pairs per (keys, scope, gap).

    scope: all, owner, family, both (pairs that share it). gap -1 means no
    limit; otherwise only pairs with |dx| <= gap. Ties in x or y are not counted.
    """
    keys = list(keys)
    scopes = {"all": F.lit(""), "owner": F.col("owner").cast("string"),
              "family": F.col("family").cast("string"),
              "both": F.concat_ws("|", F.col("family").cast("string"), F.col("owner").cast("string"))}
    points = scored.select(
        *keys, _grid(x).alias("_x"), _grid(y).alias("_y"),
        F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), v.alias("_value"))
                            for s, v in scopes.items()])).alias("_s"))
    # Thresholds: a query at x counts smaller data values; at x - gap it counts those out of reach.
    steps = [-1, *[round(g * SCALE) for g in gaps]]
    roles = F.array(F.struct(F.lit(True).alias("data"), F.lit(0).cast("bigint").alias("step"), F.col("_x").alias("_v")),
                    *[F.struct(F.lit(False).alias("data"), F.lit(s).cast("bigint").alias("step"),
                               (F.col("_x") - max(s, 0)).alias("_v")) for s in steps])
    rows = points.select(*keys, "_s.scope", "_s._value", "_y", F.explode(roles).alias("_r")).select(
        *keys, "scope", "_value", "_y", "_r.data", "_r.step", "_r._v")
    rank = F.dense_rank().over(Window.partitionBy(*keys, "scope", "_value").orderBy("_v")) - 1
    rows = rows.withColumn("_rank", rank.cast("bigint"))
    top = F.max("_rank").over(Window.partitionBy(*keys, "scope", "_value"))
    rows = rows.withColumn("_bits", F.length(F.bin(top))).withColumn(
        "_level", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)))
    bit = F.expr("shiftright(_rank, _level)") % 2  # data sit in left half-blocks, queries in right ones
    rows = rows.filter((bit == 0) == F.col("data")).withColumn(
        "_block", F.expr("shiftright(_rank, _level + 1)"))
    block = Window.partitionBy(*keys, "scope", "_value", "_level", "_block")
    running = block.orderBy("_y")
    seen = F.count_if("data")
    counted = rows.select(
        *keys, "scope", "step", "data",
        seen.over(running.rangeBetween(Window.unboundedPreceding, -1)).alias("_below"),
        seen.over(running.rangeBetween(1, Window.unboundedFollowing)).alias("_above"))
    # One pass: counts per step side by side, then one row per limit (reach minus what lies beyond it).
    def at(step: int, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("step") == step, F.col(c))), F.lit(0))

    wide = counted.filter(~F.col("data")).groupBy(*keys, "scope").agg(
        *[at(s, c).alias(f"{c}{i}") for i, s in enumerate(steps) for c in ("_below", "_above")])
    limits = [F.struct(F.lit(-1.0).alias("gap"), F.col("_below0").alias("concordant"), F.col("_above0").alias("discordant"))] + [
        F.struct(F.lit(float(g)).alias("gap"), (F.col("_below0") - F.col(f"_below{i}")).alias("concordant"),
                 (F.col("_above0") - F.col(f"_above{i}")).alias("discordant")) for i, g in enumerate(gaps, start=1)]
    return wide.select(*keys, "scope", F.explode(F.array(*limits)).alias("_l")).select(*keys, "scope", "_l.*")


def _pair_sums(where: Column | None = None) -> dict[str, Column]:
    """Pair and flip aggregates of the three populations over rows (scope, concordant, discordant)."""
    def total(kind: str, scope: str) -> Column:
        hit = F.col("scope") == scope
        return F.coalesce(F.sum(F.when(hit if where is None else hit & where, F.col(kind))), F.lit(0))

    def of(kind: str, name: str) -> Column:
        a, o, f, b = (total(kind, s) for s in ("all", "owner", "family", "both"))
        return {"all": a - o, "cross_family": a - o - f + b, "same_family": f - b}[name]

    out = {}
    for name in ("all", "cross_family", "same_family"):
        out[f"{name}_pairs"] = (of("concordant", name) + of("discordant", name)).cast("bigint")
        out[f"{name}_flips"] = of("discordant", name).cast("bigint")
    return out


def _ties(scored: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """All pairs, pairs tied in x and pairs tied in y, from value counts of both scores."""
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(x).alias("v")), F.struct(F.lit(1).alias("side"), F.col(y).alias("v"))))
    c = scored.select(*keys, sides.alias("_s")).groupBy(*keys, "_s").agg(F.count(F.lit(1)).alias("_c"))
    n, twice = F.col("_c"), F.col("_c") * (F.col("_c") - 1) / 2
    t = c.groupBy(*keys).agg(
        F.sum(F.when(F.col("_s.side") == 0, n)).alias("_n"), F.sum(F.when(F.col("_s.side") == 0, twice)).alias("_tx"),
        F.sum(F.when(F.col("_s.side") == 1, twice)).alias("_ty"))
    return t.withColumn("_n0", F.col("_n") * (F.col("_n") - 1) / 2).drop("_n")


def _tau() -> Column:
    under = (F.col("_n0") - F.col("_tx")) * (F.col("_n0") - F.col("_ty"))
    return F.when(under > 0, (F.col("_conc") - F.col("_disc")) / F.sqrt(under)).alias("kendall_tau_b")


def _free(kind: str) -> Column:
    return F.sum(F.when((F.col("scope") == "all") & (F.col("gap") == -1.0), F.col(kind)))


def kendall_tau_b(scored: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Tie-corrected rank correlation from pair counts; null when a score is constant."""
    keys = list(keys)
    cd = dominance_counts(scored, keys, x, y).groupBy(*keys).agg(
        _free("concordant").alias("_conc"), _free("discordant").alias("_disc"))
    return cd.join(_ties(scored, keys, x, y), keys).select(*keys, _tau())


def pairwise_reversals(scored: DataFrame, keys: Sequence[str] = ("half",), gap: float = 0.01,
                       x: str = "full_score", y: str = "low_score") -> DataFrame:
    """Eligible pairs and flips for all, cross-family and near cross- or same-family pairs, with tau-b.

    Owners differ in every pair; exact ties in either score leave the denominator.
    """
    keys = list(keys)
    free, near = _pair_sums(F.col("gap") == -1.0), _pair_sums(F.col("gap") >= 0)
    names = ("pairs", "flips")
    aggs = [free[f"{p}_{n}"].alias(f"{p}_{n}") for p in ("all", "cross_family") for n in names]
    aggs += [near[f"{p}_{n}"].alias(f"close_{p}_{n}") for p in ("cross_family", "same_family") for n in names]
    t = dominance_counts(scored, keys, x, y, [gap]).groupBy(*keys).agg(
        *aggs, _free("concordant").alias("_conc"), _free("discordant").alias("_disc"))
    cols = [f"{p}_{n}" for p in ("all", "cross_family", "close_cross_family", "close_same_family") for n in names]
    return t.join(_ties(scored, keys, x, y), keys).select(*keys, *cols, _tau())


def with_rates(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    for n in names:
        metrics = metrics.withColumn(f"{n}_flip_rate", ratio(F.col(f"{n}_flips"), F.col(f"{n}_pairs")))
    return metrics


def gap_curve(scored: DataFrame, gaps: Sequence[float], keys: Sequence[str] = ("half",),
              x: str = "full_score", y: str = "low_score") -> DataFrame:
    """Cross-family reversals cumulative over score gaps."""
    sums = _pair_sums()
    return dominance_counts(scored, list(keys), x, y, gaps).filter("gap >= 0").groupBy(*keys, "gap").agg(
        sums["cross_family_pairs"].alias("pairs"), sums["cross_family_flips"].alias("flips"))


def near_pairs(scored: DataFrame, gap: float, keys: Sequence[str] = ("half",), x: str = "full_score",
               cross_family: bool = True) -> DataFrame:
    """List the near pairs (a band join on binned scores): only where the pair rows are the result.

    Each model meets its own bin and the next one, so rows grow with the number
    of near pairs, never with all pairs. Equal bins of a hot score are split by AQE.
    """
    keys = list(keys)
    width = F.lit(float(gap))
    base = scored.select(*keys, "model_id", "family", "owner", F.col(x).alias("x"))
    bin_of = F.floor(F.col("x") / width)
    right = base.select(*keys, bin_of.alias("_bin"), *[F.col(c).alias(f"{c}_r") for c in ("model_id", "family", "owner", "x")])
    left = base.withColumn("_home", bin_of).withColumn(
        "_bin", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    keep = ((F.col("_bin") > F.col("_home")) | (F.col("model_id") < F.col("model_id_r"))) & (
        F.round(F.abs(F.col("x") - F.col("x_r")), 12) <= gap) & (F.col("owner") != F.col("owner_r"))
    if cross_family:
        keep = keep & (F.col("family") != F.col("family_r"))
    return left.join(right, [*keys, "_bin"]).filter(keep).select(
        *keys, F.least("model_id", "model_id_r").alias("left_id"),
        F.greatest("model_id", "model_id_r").alias("right_id"),
        F.round(F.abs(F.col("x") - F.col("x_r")), 12).alias("gap"),
        (F.col("family") == F.col("family_r")).alias("same_family"))


def pair_reversals(pairs: DataFrame, scores: DataFrame, keys: Sequence[str], by: Sequence[str],
                   x: str, y: str) -> DataFrame:
    """Reversals over a frozen pair list, scored afresh in every `by` group.

    `scores` holds (keys, by, model_id, x, y); used by the bootstraps, whose pair
    mask is frozen from the observed scores.
    """
    keys, by = list(keys), list(by)
    s = scores.select(*keys, *by, "model_id", x, y)
    a = s.select(*keys, *by, F.col("model_id").alias("left_id"), F.col(x).alias("_xl"), F.col(y).alias("_yl"))
    b = s.select(*keys, *by, F.col("model_id").alias("right_id"), F.col(x).alias("_xr"), F.col(y).alias("_yr"))
    joined = pairs.join(a, [*keys, "left_id"]).join(b, [*keys, *by, "right_id"])
    dx, dy = F.signum(F.col("_xl") - F.col("_xr")), F.signum(F.col("_yl") - F.col("_yr"))
    return joined.select(*pairs.columns, *by, (dx * dy != 0).alias("counted"), (dx * dy < 0).alias("flipped"))
