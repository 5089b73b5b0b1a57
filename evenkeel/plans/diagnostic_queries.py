"""Registered queries: reliability, discrimination-matched nulls and item pairing."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from ..operators import blueprint, matching, pairs, reliability, scoring, spectral
from ..session import cut
from .estimator_queries import BENCHMARK, abilities, spectral_fit
from .fixture import CONTROL_SEED, CTES, FOLD, GAP, REPLICATES, Fixture, md5_sql, pair_counts_sql
from .population_queries import DISC2_SQL, PAIRS_SQL, SWAPPED_SQL, swapped
from .ranking_queries import observed
from .registry import query, rnd, rounded

METRICS = ("mean_discrimination", "mean_citc", "score_sem", "weighted_alpha", "effective_items")

# Checkable offsets: ability times item magnitude.
CTES["fx_offsets"] = """SELECT r.benchmark, r.half, r.item_id, r.model_id, round(a.ability * i.magnitude, 12) AS "offset" FROM fx_resp r
  JOIN (SELECT benchmark, half, model_id, round(ln(least(greatest(avg(y), 0.001), 0.999) / (1 - least(greatest(avg(y), 0.001), 0.999))), 12) AS ability FROM fx_resp GROUP BY ALL) a USING (benchmark, half, model_id)
  JOIN fx_itemfit i ON i.benchmark = r.benchmark AND i.half = r.half AND i.item_id = r.item_id"""
CTES["fx_disc"] = 'SELECT benchmark, half, item_id, stddev_pop("offset") AS discrimination FROM fx_offsets GROUP BY ALL'
CTES["fx_citc"] = """SELECT benchmark, half, item_id, CASE WHEN u > 0 THEN greatest(-1.0, least(1.0, (sxy - sx * sy / m) / u)) ELSE 0.0 END AS citc FROM (
  SELECT *, sqrt(greatest((sxx - sx * sx / m) * (sy - sy * sy / m), 0)) AS u FROM (
    SELECT benchmark, half, item_id, sy, m, st - sy AS sx, stt - 2 * syt + sy AS sxx, syt - sy AS sxy FROM (
      SELECT c.benchmark, c.half, c.item_id, sum(y)::DOUBLE AS sy, sum(y * t)::DOUBLE AS syt FROM fx_target c JOIN
        (SELECT benchmark, half, model_id, sum(y)::DOUBLE AS t FROM fx_target GROUP BY ALL) t USING (benchmark, half, model_id) GROUP BY ALL) i
    JOIN (SELECT benchmark, half, sum(t) AS st, sum(t * t) AS stt, count(*)::DOUBLE AS m FROM
      (SELECT benchmark, half, model_id, sum(y)::DOUBLE AS t FROM fx_target GROUP BY ALL) GROUP BY ALL) w USING (benchmark, half)))"""
CTES["fx_stats"] = """SELECT v.*, d.discrimination, c.citc FROM (SELECT benchmark, half, item_id, var_samp(y) AS variance FROM fx_target GROUP BY ALL) v
  JOIN fx_disc d USING (benchmark, half, item_id) JOIN fx_citc c USING (benchmark, half, item_id)"""
CTES["fx_disc_weights"] = f"""SELECT w.benchmark, w.half, w.replicate, w.item_id, w.cell, c.wt AS weight FROM (
  SELECT d.*, replicate, row_number() OVER (PARTITION BY benchmark, half, replicate, disc_cell ORDER BY
    {md5_sql(CONTROL_SEED, 'benchmark', 'half', 'replicate', 'item_id')}, item_id) AS r
  FROM {DISC2_SQL} d CROSS JOIN (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate)) w
 JOIN (SELECT benchmark, half, cell, disc_cell, count(*) FILTER (selected) AS kk FROM {DISC2_SQL} GROUP BY ALL) f
   ON f.benchmark = w.benchmark AND f.half = w.half AND f.disc_cell = w.disc_cell
 JOIN (SELECT benchmark, half, cell, count(*)::DOUBLE / count(*) FILTER (selected) AS wt FROM fx_anchors GROUP BY ALL) c
   ON c.benchmark = w.benchmark AND c.half = w.half AND c.cell = w.cell WHERE r <= kk"""


def score_cte(weights: str) -> str:
    return f"""SELECT c.*, s.family, s.owner, s.full_score FROM (SELECT t.benchmark, t.half, w.replicate, t.model_id,
      round(sum(w.weight * t.y) / sum(w.weight), 12) AS low_score FROM fx_target t JOIN {weights} w ON w.benchmark = t.benchmark AND w.half = t.half AND w.item_id = t.item_id
      GROUP BY ALL) c JOIN fx_scored s ON s.benchmark = c.benchmark AND s.half = c.half AND s.model_id = c.model_id"""


def quality_cte(weights: str, scores: str) -> str:
    return f"""SELECT q.*, CASE WHEN k >= 2 AND m >= 3 AND sv * sw * sw > 0 THEN k / (k - 1.0) * (1 - iv / (sv * sw * sw)) END AS weighted_alpha FROM (
      SELECT benchmark, half, replicate, sum(weight * discrimination) / sum(weight) AS mean_discrimination, sum(weight * citc) / sum(weight) AS mean_citc,
        sqrt(sum(weight * weight * variance)) / sum(weight) AS score_sem, sum(weight) * sum(weight) / sum(weight * weight) AS effective_items, count(*) AS n_selected,
        count(*) AS k, sum(weight * weight * variance) AS iv, sum(weight) AS sw FROM {weights} JOIN fx_stats USING (benchmark, half, item_id) GROUP BY ALL) q
      JOIN (SELECT benchmark, half, replicate, var_samp(low_score) AS sv, count(*) AS m FROM {scores} GROUP BY ALL) s USING (benchmark, half, replicate)"""


def eval_cte(weights: str, scores: str) -> str:
    by = "p.benchmark = q.benchmark AND p.half = q.half AND p.replicate = q.replicate"
    return f"""SELECT p.*, q.mean_discrimination, q.mean_citc, q.score_sem, q.effective_items, q.n_selected, q.weighted_alpha
      FROM ({pair_counts_sql(scores, (*FOLD, 'replicate'))}) p JOIN ({quality_cte(weights, scores)}) q ON {by}"""


CTES["fx_low_weights"] = "SELECT benchmark, half, 1::BIGINT AS replicate, item_id, cell, weight FROM fx_anchors WHERE selected"
CTES["fx_low_scores"] = score_cte("fx_low_weights")
CTES["fx_disc_scores"] = score_cte("fx_disc_weights")
CTES["fx_eval_low"] = eval_cte("fx_low_weights", "fx_low_scores")
CTES["fx_eval_random"] = eval_cte("fx_weights", "fx_control_scores")
CTES["fx_eval_disc"] = eval_cte("fx_disc_weights", "fx_disc_scores")


def offsets(fx: Fixture):
    return fx.resp.join(abilities(fx), [*FOLD, "model_id"]).join(fx.itemfit.select(*FOLD, "item_id", "magnitude"), [*FOLD, "item_id"]).select(
        *FOLD, "item_id", "model_id", F.round(F.col("ability") * F.col("magnitude"), 12).alias("offset"))


@lru_cache(maxsize=4)
def statistics(fx: Fixture):
    keys = [*FOLD, "item_id"]
    return cut(reliability.item_statistics(fx.target, FOLD).join(reliability.spectral_discrimination(offsets(fx), FOLD), keys).join(
        reliability.item_total_correlation(fx.target, FOLD), keys))


def low_weights(fx: Fixture):
    return fx.anchors.filter("selected").select(*FOLD, F.lit(1).cast("bigint").alias("replicate"), "item_id", "cell", "weight")


def random_weights(fx: Fixture):
    return blueprint.matched_random_weights(fx.anchors, REPLICATES, CONTROL_SEED, FOLD)


def disc_weights(fx: Fixture):
    refined = blueprint.discrimination_cells(fx.anchors, "intercept", 2, FOLD)
    return blueprint.discrimination_matched_weights(refined, REPLICATES, CONTROL_SEED, FOLD)


def evaluated(fx: Fixture, weights):
    return reliability.evaluate_weights(fx.target, cut(weights), statistics(fx), fx.scored, FOLD, GAP)


@query("item_total_correlation", f"SELECT benchmark, half, item_id, {rnd('citc')} FROM fx_citc")
def item_total_correlation(fx):
    return rounded(reliability.item_total_correlation(fx.target, FOLD))


@query("spectral_discrimination", f"SELECT benchmark, half, item_id, {rnd('discrimination')} FROM fx_disc")
def spectral_discrimination(fx):
    return rounded(reliability.spectral_discrimination(offsets(fx), FOLD))


@query("weighted_mean", """SELECT benchmark, half, round(sum(weight * magnitude) / sum(weight), 8) AS mean_magnitude, round(sum(weight * intercept) / sum(weight), 8) AS mean_intercept
  FROM fx_anchors GROUP BY ALL""")
def weighted_mean(fx):
    return rounded(reliability.weighted_mean(fx.anchors, FOLD, ["magnitude", "intercept"]))


@query("score_sem", "SELECT benchmark, half, round(score_sem, 8) AS score_sem FROM fx_eval_low")
def score_sem(fx):
    t = low_weights(fx).join(statistics(fx), [*FOLD, "item_id"])
    return rounded(t.groupBy(*FOLD).agg(*reliability.sem_and_size()).select(*FOLD, "score_sem"))


@query("weighted_alpha", "SELECT benchmark, half, round(weighted_alpha, 8) AS weighted_alpha FROM fx_eval_low")
def weighted_alpha(fx):
    items = low_weights(fx).join(statistics(fx), [*FOLD, "item_id"])
    return rounded(reliability.weighted_alpha(items, fx.scored.withColumn("score", F.col("low_score")), FOLD))


@query("effective_items", "SELECT benchmark, half, round(effective_items, 8) AS effective_items FROM fx_eval_low")
def effective_items(fx):
    t = low_weights(fx).join(statistics(fx), [*FOLD, "item_id"])
    return rounded(t.groupBy(*FOLD).agg(*reliability.sem_and_size()).select(*FOLD, "effective_items"))


@query("evaluate_weights", f"""SELECT benchmark, half, replicate, all_pairs, all_flips, cross_family_pairs, cross_family_flips, close_cross_family_pairs, close_cross_family_flips,
  close_same_family_pairs, close_same_family_flips, {rnd('kendall_tau_b', *METRICS)}, n_selected FROM fx_eval_random""")
def evaluate_weights(fx):
    return rounded(evaluated(fx, random_weights(fx)))


def _median_sql(src: str, tag: str) -> str:
    inner = ", ".join(f"avg({m}) AS {m}" for m in METRICS)
    outer = ", ".join(f"median({m}) AS {tag}_{m}" for m in ("rate", *METRICS))
    return f"""(SELECT benchmark, {outer} FROM (SELECT benchmark, replicate, sum(close_cross_family_flips)::DOUBLE / sum(close_cross_family_pairs) AS rate, {inner}
      FROM {src} GROUP BY ALL) GROUP BY 1)"""


DISC_SUMMARY_SQL = f"""WITH o AS (SELECT benchmark, sum(close_cross_family_flips)::DOUBLE / sum(close_cross_family_pairs) AS rate, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM fx_eval_low GROUP BY 1),
 n AS (SELECT benchmark, replicate, sum(close_cross_family_flips)::DOUBLE / sum(close_cross_family_pairs) AS r FROM fx_eval_disc GROUP BY ALL),
 p AS (SELECT n.benchmark, (1 + count(*) FILTER (r >= rate))::DOUBLE / (1 + count(*)) AS matched_p, count(*) AS replicates FROM n JOIN o USING (benchmark) GROUP BY n.benchmark)
 SELECT o.benchmark, round(rate, 8) AS low_dif_rate, round(original_rate, 8) AS original_random_median, round(matched_rate, 8) AS matched_random_median,
  round(100 * (rate - original_rate), 8) AS original_excess_points, round(100 * (rate - matched_rate), 8) AS matched_excess_points, round(matched_p, 8) AS matched_p, replicates,
  {', '.join(f'round({m} / nullif(matched_{m}, 0), 8) AS ratio_{m}' for m in METRICS)}
 FROM o JOIN {_median_sql('fx_eval_random', 'original')} a USING (benchmark) JOIN {_median_sql('fx_eval_disc', 'matched')} b USING (benchmark) JOIN p USING (benchmark)"""


@query("discrimination_summary", DISC_SUMMARY_SQL)
def discrimination_summary(fx):
    return rounded(reliability.null_comparison(
        evaluated(fx, low_weights(fx)), cut(evaluated(fx, random_weights(fx))), cut(evaluated(fx, disc_weights(fx))), ["benchmark"], METRICS))


@query("reconstruct_fold")
def reconstruct_fold(fx):
    """Axes refitted on the frozen anchors span the saved space; offsets agree (basis-free check)."""
    rows = []
    for half in ("discovery", "validation"):
        fit = spectral_fit(fx, half)
        chosen = fit.packed.items.join(fit.anchors.filter("selected").select("item_id"), "item_id", "left_semi")
        axes = spectral.model_axes(chosen, fit.packed.n_models, fit.axes.shape[1])
        cosines = np.linalg.svd(axes.T @ fit.axes, compute_uv=False)
        rows.append((half, int(fit.packed.n_models), float(round(1 - cosines.min(), 6)),
                     float(round(np.abs(axes.T @ axes - np.eye(axes.shape[1])).max(), 6))))
    return fx.spark.createDataFrame(rows, "half string, models bigint, largest_angle_loss double, orthonormal_error double")


def spectral_table(fx: Fixture, half: str):
    """Frozen anchors of one fold with profile columns, keyed like the fixture tables."""
    fit = spectral_fit(fx, half)
    t = fit.anchors.join(fit.profile, "item_id").withColumn("benchmark", F.lit(BENCHMARK)).withColumn("half", F.lit(half))
    return matching.profile_embedding(t, fit.packed.n_models).withColumnRenamed("offset_sd", "discrimination")


@lru_cache(maxsize=4)
def spectral_items(fx: Fixture):
    return cut(spectral_table(fx, "discovery").unionByName(spectral_table(fx, "validation")))


@lru_cache(maxsize=4)
def spectral_scored(fx: Fixture):
    items = spectral_items(fx)
    target = fx.target.filter(F.col("benchmark") == BENCHMARK)
    low = scoring.weighted_accuracy(target, items, FOLD).withColumnRenamed("score", "low_score")
    full = fx.scored.select(*FOLD, "model_id", "family", "owner", "full_score")
    return cut(full.join(low, [*FOLD, "model_id"]))


@query("discrimination_audit")
def discrimination_audit(fx):
    """Both nulls on the spectral folds, with the spread of the fitted offsets as discrimination."""
    items = spectral_items(fx)
    target = cut(fx.target.filter(F.col("benchmark") == BENCHMARK))
    stats = cut(reliability.item_statistics(target, FOLD).join(items.select(*FOLD, "item_id", "discrimination"), [*FOLD, "item_id"]).join(
        reliability.item_total_correlation(target, FOLD), [*FOLD, "item_id"]))
    scored = spectral_scored(fx)
    refined = cut(blueprint.discrimination_cells(items.drop("loadings", "profile"), "discrimination", 4, FOLD))
    ev = lambda w: cut(reliability.evaluate_weights(target, cut(w), stats, scored, FOLD, GAP))
    low = items.filter("selected").select(*FOLD, F.lit(1).cast("bigint").alias("replicate"), "item_id", "cell", "weight")
    return rounded(reliability.null_comparison(
        ev(low), ev(blueprint.matched_random_weights(items, REPLICATES, CONTROL_SEED, FOLD)),
        ev(blueprint.discrimination_matched_weights(refined, REPLICATES, CONTROL_SEED, FOLD)), ["benchmark"], METRICS), 6)


# --- pairing -----------------------------------------------------------------

EMB_SQL = """(SELECT vec_id AS item_id, label::VARCHAR AS cell, vec_id % 2 = 0 AS selected, (0.5 + label / 20.0)::DOUBLE AS scale, embedding[1]::DOUBLE AS intercept,
  abs(embedding[2]::DOUBLE) AS magnitude, CASE WHEN vec_id % 2 = 0 THEN 2.0 ELSE 0.0 END AS weight,
  list_transform(embedding, lambda v: v::DOUBLE / ((0.5 + label / 20.0)::DOUBLE * 8.0)) AS profile FROM embeddings)"""


def embedded_items(fx: Fixture):
    e = lambda k: F.element_at("embedding", k).cast("double")
    t = fx.table("embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").cast("string").alias("cell"), (F.col("vec_id") % 2 == 0).alias("selected"),
        (0.5 + F.col("label") / 20.0).alias("scale"), e(1).alias("intercept"), F.abs(e(2)).alias("magnitude"),
        F.when(F.col("vec_id") % 2 == 0, 2.0).otherwise(0.0).alias("weight"), F.col("embedding").alias("loadings"))
    return matching.profile_embedding(t, 64)


@query("profile_embedding", f"SELECT item_id, cell, round(list_sum(list_transform(profile, lambda v: v * v)), 8) AS length2, round(profile[64], 8) AS last_axis FROM {EMB_SQL}")
def profile_embedding(fx):
    return rounded(embedded_items(fx).select(
        "item_id", "cell", F.aggregate("profile", F.lit(0.0), lambda s, v: s + v * v).alias("length2"), F.element_at("profile", 64).alias("last_axis")))


CALIPER = 0.2


@query("pair_candidates", f"""SELECT a.cell, a.item_id, b.item_id AS control_id, round(list_sum(list_transform(list_zip(a.profile, b.profile), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 8) AS profile_cost,
  round((a.intercept - b.intercept) * (a.intercept - b.intercept), 8) AS b_cost FROM {EMB_SQL} a JOIN {EMB_SQL} b ON a.cell = b.cell AND a.selected AND NOT b.selected
  WHERE (a.intercept - b.intercept) * (a.intercept - b.intercept) <= {CALIPER * CALIPER + 1e-12}
    AND list_sum(list_transform(list_zip(a.profile, b.profile), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) <= {CALIPER * CALIPER + 1e-12}""")
def pair_candidates(fx):
    return rounded(matching.pair_candidates(embedded_items(fx), [], CALIPER))


@query("pair_random", f"SELECT benchmark, half, cell, item_id, control_id FROM {PAIRS_SQL}")
def pair_random(fx):
    return matching.pair_random(fx.anchors, CONTROL_SEED, FOLD)


@query("pair_optimal")
def pair_optimal(fx):
    free = matching.pair_optimal(embedded_items(fx), [], None).withColumn("caliper", F.lit(-1.0))
    return free.unionByName(matching.pair_optimal(embedded_items(fx), [], CALIPER).withColumn("caliper", F.lit(CALIPER)))


EMB_PAIRS_SQL = f"""(SELECT a.cell, a.item_id, b.item_id AS control_id FROM
  (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {md5_sql(CONTROL_SEED, "'pair'", 'item_id')}, item_id) AS r FROM {EMB_SQL} WHERE selected) a JOIN
  (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {md5_sql(CONTROL_SEED, "'pair'", 'item_id')}, item_id) AS r FROM {EMB_SQL} WHERE NOT selected) b ON a.cell = b.cell AND a.r = b.r)"""
DIAG_SQL = f"""(SELECT p.cell, p.item_id, p.control_id, sqrt(list_sum(list_transform(list_zip(a.profile, b.profile), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS profile_rms,
  list_sum(list_transform(list_zip(a.profile, b.profile), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.profile, lambda v: v * v))) * sqrt(list_sum(list_transform(b.profile, lambda v: v * v)))) AS profile_cosine,
  abs(a.intercept - b.intercept) AS abs_b_difference, b.intercept - a.intercept AS b_difference, b.magnitude - a.magnitude AS dif_difference, a.weight AS anchor_weight
  FROM {EMB_PAIRS_SQL} p JOIN {EMB_SQL} a ON a.item_id = p.item_id JOIN {EMB_SQL} b ON b.item_id = p.control_id)"""
DIAGS = ("profile_rms", "profile_cosine", "abs_b_difference", "dif_difference")


def embedded_diagnostics(fx: Fixture):
    items = embedded_items(fx)
    return matching.pair_diagnostics(matching.pair_random(items, CONTROL_SEED, []), items, [])


@query("pair_diagnostics", f"SELECT cell, item_id, control_id, {rnd(*DIAGS, 'b_difference', 'anchor_weight')} FROM {DIAG_SQL}")
def pair_diagnostics(fx):
    return rounded(embedded_diagnostics(fx))


@query("matching_summary", f"""SELECT a.cell, n_anchors, n_pairs, round(n_pairs::DOUBLE / n_anchors, 8) AS matched_anchor_fraction, round(m / w, 8) AS swappable_weight_fraction,
  {rnd(*[f'{v}_median' for v in DIAGS], *[f'{v}_p90' for v in DIAGS], 'higher_dif_fraction')} FROM
  (SELECT cell, count(*) FILTER (weight > 0) AS n_anchors, sum(weight) AS w FROM {EMB_SQL} GROUP BY 1) a JOIN
  (SELECT cell, count(*) AS n_pairs, sum(anchor_weight) AS m, {', '.join(f'quantile_cont({v}, 0.5) AS {v}_median, quantile_cont({v}, 0.9) AS {v}_p90' for v in DIAGS)},
    avg((dif_difference > 0)::INT) AS higher_dif_fraction FROM {DIAG_SQL} GROUP BY 1) d ON d.cell = a.cell""")
def matching_summary(fx):
    return rounded(matching.matching_summary(embedded_diagnostics(fx), embedded_items(fx), ["cell"]))


PROB_SQL = f"""(SELECT p.benchmark, p.half, p.item_id, p.control_id, sqrt(avg((pa - pb) * (pa - pb))) AS probability_rms, sqrt(avg((oa - ob) * (oa - ob))) AS clipped_offset_rms FROM {PAIRS_SQL} p
  JOIN (SELECT o.benchmark, o.half, o.item_id, model_id, "offset" AS oa, 1 / (1 + exp(-(intercept + "offset"))) AS pa FROM fx_offsets o JOIN fx_itemfit USING (benchmark, half, item_id)) a USING (benchmark, half, item_id)
  JOIN (SELECT o.benchmark, o.half, o.item_id AS control_id, model_id, "offset" AS ob, 1 / (1 + exp(-(intercept + "offset"))) AS pb FROM fx_offsets o JOIN fx_itemfit USING (benchmark, half, item_id)) b USING (benchmark, half, control_id, model_id)
  GROUP BY ALL)"""


@query("pair_probability_distance", f"SELECT benchmark, half, item_id, control_id, {rnd('probability_rms', 'clipped_offset_rms')} FROM {PROB_SQL}")
def pair_probability_distance(fx):
    found = matching.pair_random(fx.anchors, CONTROL_SEED, FOLD).drop("cell")
    return rounded(matching.probability_distance(found, offsets(fx), fx.itemfit, FOLD))


CTES["fx_swapped"] = f"SELECT * FROM {SWAPPED_SQL}"
CTES["fx_counter"] = f"SELECT * FROM {SWAPPED_SQL.replace('coin = 1', 'coin = 0')}"
CTES["fx_allswap"] = f"""SELECT a.benchmark, a.half, 1::BIGINT AS replicate, coalesce(p.control_id, a.item_id) AS item_id, a.cell, a.weight FROM fx_anchors a
  LEFT JOIN {PAIRS_SQL} p ON p.benchmark = a.benchmark AND p.half = a.half AND p.item_id = a.item_id WHERE a.selected"""
for _n in ("swapped", "counter", "allswap"):
    CTES[f"fx_{_n}_scores"] = score_cte(f"fx_{_n}")
CTES["fx_eval_swap"] = eval_cte("fx_swapped", "fx_swapped_scores")
CTES["fx_counter_pairs"] = pair_counts_sql("fx_counter_scores", (*FOLD, "replicate"))
CTES["fx_allswap_pairs"] = pair_counts_sql("fx_allswap_scores", (*FOLD, "replicate"))


@query("profile_scores", f"""SELECT e.benchmark, e.half, e.replicate, close_cross_family_pairs, close_cross_family_flips, close_same_family_pairs, close_same_family_flips,
  {rnd(*METRICS, 'mean_magnitude', 'mean_intercept', 'anchor_overlap_fraction')} FROM fx_eval_swap e JOIN (
  SELECT s.benchmark, s.half, s.replicate, sum(s.weight * a.magnitude) / sum(s.weight) AS mean_magnitude, sum(s.weight * a.intercept) / sum(s.weight) AS mean_intercept,
    count(*) FILTER (a.selected)::DOUBLE / count(*) AS anchor_overlap_fraction FROM fx_swapped s JOIN fx_anchors a ON a.benchmark = s.benchmark AND a.half = s.half AND a.item_id = s.item_id GROUP BY ALL) b
  ON b.benchmark = e.benchmark AND b.half = e.half AND b.replicate = e.replicate""")
def profile_scores(fx):
    weights = cut(swapped(fx))
    by = [*FOLD, "replicate"]
    base = reliability.evaluate_weights(fx.target, weights, statistics(fx), fx.scored, FOLD, GAP)
    joined = weights.join(fx.anchors.select(*FOLD, "item_id", "magnitude", "intercept", "selected"), [*FOLD, "item_id"])
    balance = reliability.weighted_mean(joined, by, ["magnitude", "intercept"]).join(joined.groupBy(*by).agg(
        F.avg(F.col("selected").cast("double")).alias("anchor_overlap_fraction")), by)
    close = [c for c in base.columns if c.startswith("close_")]
    return rounded(base.select(*by, *close, *METRICS).join(balance, by))


def scenario_tables(fx: Fixture, items, target, scored, found, scenario: str, replicates: int):
    """Controls with complement counts, the all-swapped form and the matching quality of one pairing."""
    chosen = items.filter("selected").select(*FOLD, "item_id", "cell", "weight")
    link = cut(found.select(*FOLD, "item_id", "control_id"))

    def counts(weights):
        scores = scoring.replicate_scores(target, cut(weights), FOLD).withColumnRenamed("score", "low_score")
        meta = scored.select(*FOLD, "model_id", "family", "owner", "full_score")
        return pairs.pairwise_reversals(scores.join(meta, [*FOLD, "model_id"]), [*FOLD, "replicate"], GAP)

    by = [*FOLD, "replicate"]
    one = counts(blueprint.swap_weights(chosen, link, replicates, CONTROL_SEED, False, FOLD))
    two = counts(blueprint.swap_weights(chosen, link, replicates, CONTROL_SEED, True, FOLD)).select(
        *by, F.col("close_cross_family_pairs").alias("complement_pairs"), F.col("close_cross_family_flips").alias("complement_flips"))
    every = chosen.join(link, [*FOLD, "item_id"], "left").select(
        *FOLD, F.lit(1).cast("bigint").alias("replicate"), F.coalesce("control_id", "item_id").alias("item_id"), "cell", "weight")
    tag = F.lit(scenario)
    return cut(one.join(two, by).withColumn("scenario", tag)), cut(counts(every).withColumn("scenario", tag)), link


@query("profile_controls")
def profile_controls(fx):
    """Five pairing scenarios on the spectral folds: endpoint switches, complements and coverage."""
    controls, _, quality = profile_tables(fx)
    t = controls.groupBy("scenario", *FOLD).agg(
        F.count(F.lit(1)).alias("replicates"), F.avg("close_cross_family_flips").alias("mean_flips"),
        F.avg("close_cross_family_pairs").alias("mean_pairs"), F.avg("complement_flips").alias("mean_complement_flips"))
    return rounded(t.join(quality.select("scenario", *FOLD, "n_pairs", "matched_anchor_fraction", "swappable_weight_fraction"), ["scenario", *FOLD]), 6)


@lru_cache(maxsize=4)
def profile_tables(fx: Fixture, replicates: int = 10):
    items = spectral_items(fx)
    target, scored = cut(fx.target.filter(F.col("benchmark") == BENCHMARK)), spectral_scored(fx)
    out = None
    for scenario, caliper in matching.SCENARIOS.items():
        found = (matching.pair_random(items, CONTROL_SEED, FOLD) if scenario == "random_pairing"
                 else matching.pair_optimal(items, FOLD, caliper))
        found = cut(found)
        controls, every, _ = scenario_tables(fx, items, target, scored, found, scenario, replicates)
        quality = cut(matching.matching_summary(matching.pair_diagnostics(found, items, FOLD), items, FOLD).withColumn("scenario", F.lit(scenario)))
        part = (controls, every, quality)
        out = part if out is None else tuple(a.unionByName(b) for a, b in zip(out, part))
    return out


@query("profile_balance")
def profile_balance(fx):
    items = spectral_items(fx)
    chosen = items.filter("selected").select(*FOLD, "item_id", "cell", "weight")
    link = matching.pair_random(items, CONTROL_SEED, FOLD).select(*FOLD, "item_id", "control_id")
    weights = blueprint.swap_weights(chosen, link, REPLICATES, CONTROL_SEED, False, FOLD)
    return rounded(matching.profile_balance(weights, items, FOLD), 6)


PROFILE_SUMMARY_SQL = """WITH o AS (SELECT benchmark, sum(close_cross_family_flips)::DOUBLE / sum(close_cross_family_pairs) AS lo, sum(close_same_family_flips)::DOUBLE / sum(close_same_family_pairs) AS wlo FROM fx_observed GROUP BY 1),
 h AS (SELECT benchmark, sum(close_cross_family_flips)::DOUBLE / sum(close_cross_family_pairs) AS hi FROM fx_allswap_pairs GROUP BY 1),
 n AS (SELECT e.benchmark, e.replicate, sum(e.close_cross_family_flips)::DOUBLE / sum(e.close_cross_family_pairs) AS n, sum(e.close_same_family_flips)::DOUBLE / sum(e.close_same_family_pairs) AS w,
   sum(c.close_cross_family_flips)::DOUBLE / sum(c.close_cross_family_pairs) AS k FROM fx_eval_swap e JOIN fx_counter_pairs c USING (benchmark, half, replicate) GROUP BY ALL),
 q AS (SELECT a.benchmark, sum(np)::BIGINT AS n_pairs, sum(np)::DOUBLE / sum(na) AS mf, avg(m / tw) AS sf FROM (SELECT benchmark, half, count(*) FILTER (selected) AS na, sum(weight) AS tw FROM fx_anchors GROUP BY ALL) a
   JOIN (SELECT p.benchmark, p.half, count(*) AS np, sum(x.weight) AS m FROM """ + PAIRS_SQL + """ p JOIN fx_anchors x ON x.benchmark = p.benchmark AND x.half = p.half AND x.item_id = p.item_id GROUP BY ALL) b USING (benchmark, half) GROUP BY a.benchmark)
 SELECT n.benchmark, 'random_pairing' AS scenario, round(any_value(lo), 8) AS low_dif_rate, round(median(n), 8) AS paired_random_median, round((1 + count(*) FILTER (round(n, 12) >= round(lo, 12)))::DOUBLE / (1 + count(*)), 8) AS empirical_upper_p,
  round(quantile_cont(n, 0.025), 8) AS paired_random_q025, round(quantile_cont(n, 0.975), 8) AS paired_random_q975, round(any_value(hi), 8) AS all_swapped_rate, round(100 * (any_value(lo) - any_value(hi)), 8) AS low_minus_all_swapped_pp,
  round((1 + count(*) FILTER (round(abs(n - k), 12) >= round(abs(lo - hi), 12)))::DOUBLE / (1 + count(*)), 8) AS paired_contrast_two_sided_p,
  round(100 * (any_value(lo - wlo) - median(n - w)), 8) AS specificity_excess_pp, round((1 + count(*) FILTER (round(n - w, 12) >= round(lo - wlo, 12)))::DOUBLE / (1 + count(*)), 8) AS specificity_upper_p,
  round(100 * (any_value(lo) - median(n)), 8) AS excess_pp, any_value(n_pairs) AS n_pairs, round(any_value(mf), 8) AS matched_anchor_fraction, round(any_value(sf), 8) AS swappable_weight_fraction
 FROM n JOIN o USING (benchmark) JOIN h USING (benchmark) JOIN q USING (benchmark) GROUP BY n.benchmark"""


@query("profile_summary", PROFILE_SUMMARY_SQL)
def profile_summary(fx):
    """Random pairing on the checkable anchors: every column has a SQL twin."""
    found = cut(matching.pair_random(fx.anchors, CONTROL_SEED, FOLD))
    controls, every, link = scenario_tables(fx, fx.anchors, fx.target, fx.scored, found, "random_pairing", REPLICATES)
    mass = link.join(fx.anchors.select(*FOLD, "item_id", "weight"), [*FOLD, "item_id"]).groupBy(*FOLD).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("weight").alias("_m"))
    quality = fx.anchors.groupBy(*FOLD).agg(F.count_if("selected").alias("n_anchors"), F.sum("weight").alias("_w")).join(mass, list(FOLD)).select(
        *FOLD, F.lit("random_pairing").alias("scenario"), "n_pairs", "n_anchors", (F.col("_m") / F.col("_w")).alias("swappable_weight_fraction"))
    return rounded(matching.profile_summary(observed(fx), controls, every, quality, ["benchmark"]))


