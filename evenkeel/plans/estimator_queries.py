"""Registered queries: item and ability fits, family effects, spectral and joint estimators."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..functions.exprs import clipped_logit
from ..operators import dif, joint, newton, spectral
from . import fit_sql
from .fixture import FOLD, Fixture
from .registry import query, rounded

BENCHMARK = "N"
DIMENSIONS = (1, 2, 4, 8)
SEED = 20260826

# Offsets of the checkable fits: the clipped logit of a model's success count.
ABILITY_SQL = """(SELECT benchmark, half, model_id, round(ln(least(greatest(avg(y), 0.001), 0.999) / (1 - least(greatest(avg(y), 0.001), 0.999))), 12) AS ability
  FROM fx_resp GROUP BY ALL)"""
LOGIT_SQL = """(SELECT benchmark, half, item_id, round(ln(least(greatest(avg(y), 0.001), 0.999) / (1 - least(greatest(avg(y), 0.001), 0.999))), 12) AS item_logit
  FROM fx_resp GROUP BY ALL)"""


def abilities(fx: Fixture):
    return fx.resp.groupBy(*FOLD, "model_id").agg(F.round(clipped_logit(F.avg("y")), 12).alias("ability"))


def item_logits(fx: Fixture):
    return fx.resp.groupBy(*FOLD, "item_id").agg(F.round(clipped_logit(F.avg("y")), 12).alias("item_logit"))


def with_ability(fx: Fixture):
    return fx.resp.join(abilities(fx), [*FOLD, "model_id"]).withColumn("offset", F.col("ability"))


def newton_sql(points: str, key: str, margin: float) -> str:
    """Clipped Newton steps as a recursive query over (key, offset, count, successes) points."""
    return f"""WITH RECURSIVE pt AS ({points}),
 st AS (SELECT {key}, sum(s) AS s, sum(n) AS n, sum(o * n) / sum(n) AS mo FROM pt GROUP BY ALL),
 it AS (SELECT 0 AS step, {key}, ln(least(greatest(s / n, {margin}), {1 - margin}) / (1 - least(greatest(s / n, {margin}), {1 - margin}))) - mo AS b FROM st
   UNION ALL SELECT any_value(it.step) + 1, {', '.join('it.' + k for k in key.split(', '))}, any_value(it.b) + least(greatest((sum(pt.s) - sum(pt.n / (1 + exp(-(it.b + pt.o)))))
     / (sum(pt.n / (1 + exp(-(it.b + pt.o))) * (1 - 1 / (1 + exp(-(it.b + pt.o))))) + 1e-9), -2.0), 2.0)
   FROM it JOIN pt USING ({key}) WHERE it.step < 30 GROUP BY {', '.join('it.' + k for k in key.split(', '))})
 SELECT {key}, b FROM it WHERE step = 30"""


ITEM_POINTS = f"""SELECT r.benchmark, r.half, r.item_id, a.ability AS o, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM fx_resp r JOIN {ABILITY_SQL} a
  ON a.benchmark = r.benchmark AND a.half = r.half AND a.model_id = r.model_id GROUP BY ALL"""
MODEL_POINTS = f"""SELECT r.benchmark, r.half, r.model_id, a.item_logit AS o, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM fx_resp r JOIN {LOGIT_SQL} a
  ON a.benchmark = r.benchmark AND a.half = r.half AND a.item_id = r.item_id GROUP BY ALL"""


@query("item_parameters", """SELECT benchmark, half, item_id, round(p, 8) AS p, round(sqrt(p * (1 - p)), 8) AS scale FROM (
  SELECT benchmark, half, item_id, least(greatest((sum(y) + 0.5) / (count(*) + 1.0), 0.0001), 0.9999) AS p FROM fx_resp GROUP BY ALL)""")
def item_parameters(fx):
    return rounded(newton.item_parameters(fx.resp, [*FOLD, "item_id"]))


@query("working_responses", """SELECT r.benchmark, r.half, r.item_id, r.model_id, round((y - p) / sqrt(p * (1 - p)), 8) AS working FROM fx_resp r JOIN (
  SELECT benchmark, half, item_id, least(greatest((sum(y) + 0.5) / (count(*) + 1.0), 0.0001), 0.9999) AS p FROM fx_resp GROUP BY ALL) q
  ON q.benchmark = r.benchmark AND q.half = r.half AND q.item_id = r.item_id""")
def working_responses(fx):
    keys = [*FOLD, "item_id"]
    return rounded(newton.working_responses(fx.resp, newton.item_parameters(fx.resp, keys), keys).select(*keys, "model_id", "working"))


@query("fit_item_intercepts", f"SELECT benchmark, half, item_id, round(b, 6) AS intercept FROM ({newton_sql(ITEM_POINTS, 'benchmark, half, item_id', 1e-4)})")
def fit_item_intercepts(fx):
    return rounded(newton.fit_item_intercepts(with_ability(fx), [*FOLD, "item_id"]), 6)


@query("fit_general_ability", f"SELECT benchmark, half, model_id, round(b, 6) AS ability FROM ({newton_sql(MODEL_POINTS, 'benchmark, half, model_id', 1e-3)})")
def fit_general_ability(fx):
    cells = fx.resp.join(item_logits(fx), [*FOLD, "item_id"])
    return rounded(newton.fit_general_ability(cells, [*FOLD, "model_id"]), 6)


@lru_cache(maxsize=4)
def rasch(fx: Fixture):
    return newton.fit_rasch(fx.resp, FOLD)


@query("fit_rasch", f"SELECT * FROM ({fit_sql.RASCH})")
def fit_rasch(fx):
    return rounded(rasch(fx)[0], 6)


@lru_cache(maxsize=4)
def family_effects(fx: Fixture):
    from ..session import cut

    return cut(dif.fit_family_dif(fx.resp, rasch(fx)[0], FOLD))


@query("fit_family_dif", f"SELECT * FROM ({fit_sql.FAMILY_DIF})")
def fit_family_dif(fx):
    return rounded(family_effects(fx), 6)


Z_SQL = f"""(SELECT r.benchmark, r.half, r.model_id, r.y, f.b + a.ability + e.effect AS z FROM fx_resp r JOIN {ABILITY_SQL} a USING (benchmark, half, model_id)
  JOIN (SELECT benchmark, half, item_id, ln(least(greatest(intercept, 0.001), 0.999) / (1 - least(greatest(intercept, 0.001), 0.999))) AS b FROM fx_itemfit) f USING (benchmark, half, item_id)
  JOIN fx_effects e ON e.benchmark = r.benchmark AND e.half = r.half AND e.item_id = r.item_id AND e.family = r.family)"""


def logit_items(fx: Fixture):
    return fx.itemfit.withColumn("intercept", clipped_logit(F.col("intercept")))


@query("dif_logits_nll", f"SELECT benchmark, half, round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - y * z), 8) AS log_loss, count(*) AS cells FROM {Z_SQL} GROUP BY ALL")
def dif_logits_nll(fx):
    return rounded(newton.dif_loss(with_ability(fx), logit_items(fx), fx.effects, FOLD, FOLD))


@query("model_log_loss", f"SELECT benchmark, half, model_id, round(avg(ln(1 + exp(-abs(z))) + greatest(z, 0) - y * z), 8) AS log_loss, count(*) AS cells FROM {Z_SQL} GROUP BY ALL")
def model_log_loss(fx):
    return rounded(newton.dif_loss(with_ability(fx), logit_items(fx), fx.effects, FOLD, [*FOLD, "model_id"]))


@query("dif_magnitude", """SELECT benchmark, half, item_id, round(max(effect) - min(effect), 8) AS magnitude, (list(family ORDER BY effect DESC, family))[1] AS advantaged_family
  FROM fx_effects GROUP BY ALL""")
def dif_magnitude(fx):
    return rounded(newton.dif_magnitude(fx.effects, FOLD))


@query("dtf_curves", """SELECT benchmark, half, family, theta, round(avg(d), 8) AS full_dtf, round(sum(d * weight) / sum(weight), 8) AS anchor_dtf FROM (
  SELECT a.benchmark, a.half, e.family, theta, weight, 1 / (1 + exp(-(b + theta + effect))) - 1 / (1 + exp(-(b + theta))) AS d FROM (
    SELECT *, ln(least(greatest(intercept, 0.001), 0.999) / (1 - least(greatest(intercept, 0.001), 0.999))) AS b, unnest([-2.0::DOUBLE, -1.0, 0.0, 1.0, 2.0]) AS theta FROM fx_anchors) a
  JOIN fx_effects e ON e.benchmark = a.benchmark AND e.half = a.half AND e.item_id = a.item_id) GROUP BY ALL""")
def dtf_curves(fx):
    items = fx.anchors.withColumn("intercept", clipped_logit(F.col("intercept")))
    return rounded(newton.dtf_curves(items, fx.effects, FOLD))


# Losses of a shrunken-rate predictor, with the shrinkage as the "dimension": checkable input of the rule.
LOSS_SQL = """(SELECT benchmark, half, dimension, avg(loss) AS mean_log_loss, stddev_samp(loss) / sqrt(count(*)) AS se FROM (
  SELECT r.benchmark, r.half, d AS dimension, r.model_id, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS loss FROM (
    SELECT *, unnest([1, 2, 4, 8, 16, 32]) AS d FROM fx_resp) r JOIN (
    SELECT benchmark, half, item_id, d, (sum(y) + 0.1 * d) / (count(*) + d) AS q FROM (SELECT *, unnest([1, 2, 4, 8, 16, 32]) AS d FROM fx_resp) GROUP BY benchmark, half, item_id, d) p
    USING (benchmark, half, item_id, d) GROUP BY r.benchmark, r.half, d, r.model_id) GROUP BY ALL)"""


@query("one_se_rule", f"""WITH l AS {LOSS_SQL}, b AS (SELECT benchmark, half, arg_min(dimension, mean_log_loss) AS best_dimension, min(mean_log_loss) + arg_min(se, mean_log_loss) AS t FROM l GROUP BY ALL)
 SELECT l.benchmark, l.half, any_value(best_dimension) AS best_dimension, round(any_value(t), 8) AS one_se_threshold, min(dimension) FILTER (mean_log_loss <= t) AS selected_dimension
 FROM l JOIN b ON b.benchmark = l.benchmark AND b.half = l.half GROUP BY l.benchmark, l.half""")
def one_se_rule(fx):
    grid = fx.resp.withColumn("dimension", F.explode(F.array(*[F.lit(d) for d in (1, 2, 4, 8, 16, 32)])))
    d = F.col("dimension")
    rate = grid.groupBy(*FOLD, "item_id", "dimension").agg(
        F.sum("y").alias("s"), F.count(F.lit(1)).alias("n")).withColumn("q", (F.col("s") + 0.1 * d) / (F.col("n") + d))
    y, q = F.col("y"), F.col("q")
    loss = grid.join(rate, [*FOLD, "item_id", "dimension"]).groupBy(*FOLD, "dimension", "model_id").agg(
        F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("loss"))
    return rounded(newton.one_se_rule(newton.loss_by_dimension(loss, FOLD), FOLD))


# --- spectral ----------------------------------------------------------------

def half_cells(fx: Fixture, half: str):
    return fx.resp.filter((F.col("benchmark") == BENCHMARK) & (F.col("half") == half)).drop("benchmark", "half")


@lru_cache(maxsize=8)
def packed(fx: Fixture, half: str):
    return spectral.pack(half_cells(fx, half))


@lru_cache(maxsize=8)
def spectral_fit(fx: Fixture, half: str):
    return spectral.purify_anchors(packed(fx, half), 2)


@lru_cache(maxsize=8)
def dimension_choice(fx: Fixture, half: str):
    return spectral.choose_dimension(half_cells(fx, half), DIMENSIONS, SEED)


def both(fx: Fixture, fn):
    one, two = (fn(fx, h).withColumn("half", F.lit(h)) for h in ("discovery", "validation"))
    return one.unionByName(two)


@query("spectral_offsets")
def spectral_offsets(fx):
    """Size of each item's offsets on two axes learnt from all items."""
    def one(fx, half):
        p = packed(fx, half)
        axes = spectral.model_axes(p.items, p.n_models, 2)
        return spectral.fit_dif(p, spectral.project(p.items, axes), axes, 1.0, 5).select("item_id", "offset_sd", "intercept")
    return rounded(both(fx, one), 6)


@query("choose_dimension")
def choose_dimension(fx):
    return rounded(both(fx, lambda f, h: dimension_choice(f, h)[0]), 6)


@query("purify_anchors_spectral")
def purify_anchors_spectral(fx):
    return rounded(both(fx, lambda f, h: spectral_fit(f, h).anchors), 6)


@query("purify_anchors_rasch")
def purify_anchors_rasch(fx):
    return rounded(rasch_fit(fx)[0], 6)


@lru_cache(maxsize=4)
def rasch_fit(fx: Fixture):
    from ..plans.audit import purify_rasch

    return purify_rasch(fx.resp, FOLD)


@query("dif_penalty_cv")
def dif_penalty_cv(fx):
    from ..plans.audit import dif_penalty_grid

    return rounded(dif_penalty_grid(fx.resp, rasch(fx)[0], (0.25, 1.0, 4.0), ["benchmark"]), 6)


# --- factor offsets ----------------------------------------------------------

def factor_cells(fx: Fixture):
    """Representatives' outcomes with item logits; item groups are the categories."""
    logits = fx.rates.groupBy(*FOLD, "item_id").agg(
        F.round(clipped_logit(F.sum("s") / F.sum("n")), 6).alias("item_logit"))
    return fx.target.join(logits, [*FOLD, "item_id"]).withColumn("category", F.col("item_group")).withColumn(
        "fold", F.pmod(F.floor(F.col("item_id") / 8), F.lit(3)))


@query("bifactor_offsets", f"SELECT * FROM ({fit_sql.BIFACTOR})")
def bifactor_offsets(fx):
    cells = factor_cells(fx)
    keys = [*FOLD, "model_id"]
    _, theta = newton.bifactor_offsets(cells, newton.fit_general_ability(cells, keys), keys, 2.0)
    return rounded(theta, 6)


@query("multilevel_offsets")
def multilevel_offsets(fx):
    cells = factor_cells(fx).filter(F.col("benchmark") == BENCHMARK)
    alpha, effects = newton.multilevel_offsets(cells, [("category", 2.0), ("fold", 4.0)], cycles=2)
    rows = None
    for name, e in effects.items():
        part = e.select("model_id", F.lit(name).alias("factor"), F.col(name).cast("bigint").alias("level"), "theta")
        rows = part if rows is None else rows.unionByName(part)
    return rounded(rows.join(alpha, "model_id"), 6)


@query("bifactor_penalty_cv", f"SELECT * FROM ({fit_sql.BIFACTOR_CV})")
def bifactor_penalty_cv(fx):
    return rounded(newton.bifactor_penalty_cv(factor_cells(fx), (1.0, 4.0), list(FOLD)), 6)


# --- joint model -------------------------------------------------------------

@lru_cache(maxsize=8)
def joint_choice(fx: Fixture, half: str):
    return joint.joint_dimension(half_cells(fx, half), (1, 2), SEED, 4)


@query("joint_logistic_mirt")
def joint_logistic_mirt(fx):
    p = packed(fx, "discovery")
    _, _, history = joint.fit_joint(p, p.items, 2, SEED, 8)
    return rounded(fx.spark.createDataFrame(history), 6)


@query("joint_mirt_dimension")
def joint_mirt_dimension(fx):
    return rounded(joint_choice(fx, "discovery")[0], 6)


@query("joint_mirt_offsets")
def joint_mirt_offsets(fx):
    rows, _ = joint.joint_offsets(packed(fx, "discovery"), spectral_fit(fx, "discovery").anchors, 2, SEED, 4)
    return rounded(rows.drop("beta"), 6)


@query("estimator_comparison")
def estimator_comparison(fx):
    """Paired loss table of the two estimators on the same splits."""
    from ..plans.audit import paired_losses

    return rounded(paired_losses(dimension_choice(fx, "discovery")[0], joint_choice(fx, "discovery")[0]), 6)


