"""Registered queries: end-to-end audits and cross-benchmark synthesis."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..functions.exprs import draw_key
from ..functions.ranks import hash_row_number
from ..operators import blueprint, dif, joint, matching, pairs, population, predict, resampling, scoring, summaries, synthesis
from ..session import cut
from . import audit
from .diagnostic_queries import disc_weights, evaluated, scenario_tables
from .estimator_queries import BENCHMARK, rasch
from .fixture import (BOOT_SEED, CAP_SEED, CONTROL_SEED, CTES, FOLD, GAP, OWNER_SEED, REPLICATES, Fixture, pair_counts_sql)
from .prediction_queries import item_features
from .ranking_queries import (CONTROL_SUMMARY_SQL, GAP_SUMMARY_SQL, REVERSAL_SQL, control_summary, gap_tables, observed, observed_full,
                              times_sql)
from .ranking_queries import bootstrap_summary as bootstrap_table
from .registry import query, rnd, rounded

FRACTIONS = (0.3, 0.5, 0.7)
QUICK = audit.AuditConfig(dimensions=(1, 2, 4), resamples=50, seed=CAP_SEED, min_family_models=20)


def benchmark_cells(fx: Fixture):
    return fx.all_responses.filter(F.col("benchmark") == BENCHMARK).drop("benchmark")


@lru_cache(maxsize=4)
def full_audit(fx: Fixture):
    return audit.run_audit(benchmark_cells(fx), QUICK)


@query("audit")
def audit_query(fx):
    """The whole audit from outcomes to status: cap, balanced split, dimension choice, purification, controls."""
    return rounded(full_audit(fx)["summary"], 6)


@query("audit_rasch")
def audit_rasch(fx):
    full = fx.scored.drop("low_score")
    out = audit.audit_rasch(fx.resp, fx.target, full, FOLD, REPLICATES, CONTROL_SEED, rounds=2)
    return rounded(summaries.reversal_summary(out["observed"], out["controls"], ["benchmark"]), 6)


SHORT = audit.AuditConfig(purification_rounds=1, resamples=20, seed=CAP_SEED)


def unit_table(fx: Fixture):
    return fx.items.select("item_id", F.col("item_group").cast("string").alias("unit"))


@query("primary_benchmark_run")
def primary_benchmark_run(fx):
    cells = fx.resp.filter(F.col("benchmark") == BENCHMARK).drop("benchmark", "half")
    out = audit.primary_run(cells, fx.pop, fx.reps, SHORT, FRACTIONS, 2, unit_table(fx))
    return rounded(out["control_summary"].join(out["bootstrap_summary"].drop("replicates"), "fraction"), 6)


@query("joint_mirt_run")
def joint_mirt_run(fx):
    """The primary run with the joint estimator passed as a function."""
    cells = fx.resp.filter(F.col("benchmark") == BENCHMARK).drop("benchmark", "half")
    out = audit.primary_run(cells, fx.pop, fx.reps, SHORT, (0.5,), 1, unit_table(fx), joint.joint_estimator(CAP_SEED, 4))
    return rounded(out["control_summary"], 6)


@query("dif_experiment")
def dif_experiment(fx):
    """Penalty choice across halves, effects at the chosen penalty, features, held-out prediction metrics."""
    cells = fx.resp.filter(F.col("benchmark") == BENCHMARK)
    grid = audit.dif_penalty_grid(fx.resp, rasch(fx)[0], (1.0, 4.0), ["benchmark"])
    penalty = grid.filter(F.col("selected") & (F.col("benchmark") == BENCHMARK)).first()["penalty"]
    effects = cut(dif.fit_family_dif(cells, rasch(fx)[0], FOLD, penalty))
    families = [r["family"] for r in effects.select("family").distinct().orderBy("family").collect()]
    items = effects.join(fx.items, "item_id")
    wide = items.groupBy("item_id", "item_group").pivot("half", list(population.HALVES)).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("family", "effect"))), lambda x: x["effect"]))
    split = hash_row_number(wide, ["item_group"], draw_key(BOOT_SEED, "item_id", tag="fold"), "item_id")
    targets = cut(split.withColumn("fold", (F.col("rn") - 1) % 4).withColumn("y", F.col("discovery")).drop("rn", "rn_of"))
    features = item_features(fx)
    width = features.agg(F.max("index").alias("m")).first()["m"] + 1
    rows = cut(predict.pack_rows(features, targets))
    model = predict.ridge_fit(rows.filter("fold > 0"), width, len(families), 10.0)
    out = predict.predict(rows.filter("fold = 0"), {(penalty,): model}, ["penalty"], families)
    truth = effects.filter("half = 'validation'").select("item_id", F.col("family").alias("target"), F.col("effect").alias("truth"))
    other = effects.filter("half = 'discovery'").select("item_id", F.col("family").alias("target"), F.col("effect").alias("prediction"))
    held = out.select("item_id", "target", "prediction").join(truth, ["item_id", "target"]).withColumn("representation", F.lit("item_features"))
    ceiling = other.join(truth, ["item_id", "target"]).join(rows.filter("fold = 0").select("item_id"), "item_id", "left_semi").withColumn(
        "representation", F.lit("other_half"))
    both = held.unionByName(ceiling.select(held.columns)).withColumnRenamed("target", "family")
    return rounded(predict.effect_metrics(both, ["representation"]), 6)


# --- synthesis ---------------------------------------------------------------

SYN_SQL = f"""SELECT r.benchmark, r.eligible_pairs, r.reversals, r.low_dif_reversal_rate, r.random_median_rate, r.excess_pp, r.p, r.status,
  b.tau_ci_low, b.tau_ci_high, b.close_flip_ci_low, b.close_flip_ci_high, c.cross_family_flip_rate, c.score_shift_range_points, c.score_shift_range_p, round(t.tau, 8) AS mean_kendall_tau_b
 FROM (SELECT benchmark, eligible_pairs, reversals, round(low_dif_reversal_rate, 8) AS low_dif_reversal_rate, round(CASE WHEN ok THEN med END, 8) AS random_median_rate,
    round(CASE WHEN ok THEN ex END, 8) AS excess_pp, round(CASE WHEN ok THEN pv END, 8) AS p, CASE WHEN eligible_pairs = 0 THEN 'insufficient_eligible_pairs' WHEN NOT ok THEN 'undefined_random_controls'
    WHEN ex > 0 AND pv <= 0.05 THEN 'excess_sensitivity_detected' ELSE 'no_significant_excess_detected' END AS status
    FROM (SELECT *, eligible_pairs > 0 AND undefined_replicates = 0 AS ok, 100.0 * (low_dif_reversal_rate - med) AS ex FROM {REVERSAL_SQL})) r
 JOIN (BOOT) b ON b.benchmark = r.benchmark
 JOIN (SELECT benchmark, max(observed) FILTER (metric = 'cross_family_flip_rate') AS cross_family_flip_rate, max(observed) FILTER (metric = 'score_shift_range_points') AS score_shift_range_points,
    max(p) FILTER (metric = 'score_shift_range_points') AS score_shift_range_p FROM ({CONTROL_SUMMARY_SQL}) GROUP BY 1) c ON c.benchmark = r.benchmark
 JOIN (SELECT benchmark, avg(kendall_tau_b) AS tau FROM fx_observed GROUP BY 1) t ON t.benchmark = r.benchmark"""


def _inner_boot() -> str:
    from .ranking_queries import BOOT_SQL, COMP_META_SQL

    return f"""WITH cs AS {COMP_META_SQL}, pooled AS (SELECT benchmark, replicate, avg(kendall_tau_b) AS tau,
      sum(close_cross_family_flips)::DOUBLE / nullif(sum(close_cross_family_pairs), 0) AS rate FROM {BOOT_SQL} GROUP BY ALL)
      SELECT benchmark, round(quantile_cont(tau, 0.025), 8) AS tau_ci_low, round(quantile_cont(tau, 0.975), 8) AS tau_ci_high,
      round(quantile_cont(rate, 0.025), 8) AS close_flip_ci_low, round(quantile_cont(rate, 0.975), 8) AS close_flip_ci_high FROM pooled GROUP BY 1"""


BOOT_ROWS_SQL = _inner_boot()


@query("benchmark_synthesis", SYN_SQL.replace("(BOOT)", f"({BOOT_ROWS_SQL})"))
def benchmark_synthesis(fx):
    obs = cut(observed_full(fx))
    boot = cut(resampling.composition_bootstrap(fx.aggregates, fx.scored, REPLICATES, BOOT_SEED, FOLD, GAP))
    return rounded(synthesis.benchmark_synthesis(
        summaries.reversal_summary(obs, fx.controls, ["benchmark"]), summaries.bootstrap_summary(boot, ["benchmark"]),
        summaries.control_summary(obs, fx.controls, ["benchmark"]), obs))


CTES["fx_common"] = """SELECT l.benchmark || ' vs ' || r.benchmark AS pair, l.half, l.model_id, l.owner, l.family, l.score_shift AS left_shift, r.score_shift AS right_shift
  FROM fx_shifts l JOIN fx_shifts r ON r.half = l.half AND r.model_id = l.model_id AND r.owner = l.owner AND r.family = l.family AND l.benchmark < r.benchmark"""
CTES["fx_common_boot"] = f"""SELECT pair, replicate, family, 100.0 * sum(times * left_shift) / sum(times) AS l, 100.0 * sum(times * right_shift) / sum(times) AS r
  FROM fx_common JOIN {times_sql('fx_common', 'owner', 'pair', OWNER_SEED)} USING (pair, owner) GROUP BY ALL"""
PAIRS = (("A", "N"), ("A", "R"), ("N", "R"))


@lru_cache(maxsize=4)
def common(fx: Fixture):
    shifts = cut(fx.shifts)
    out = None
    for left, right in PAIRS:
        part = synthesis.common_models(shifts, left, right)
        out = part if out is None else out.unionByName(part)
    return cut(out)


@query("exact_common_family_shifts", f"""SELECT e.pair, e.family, n_common_models, n_common_owners, replicates, {rnd('left_shift_points', 'right_shift_points')}, round(right_shift_points - left_shift_points, 8) AS right_minus_left_points,
  {rnd('left_ci_low', 'left_ci_high', 'right_ci_low', 'right_ci_high', 'difference_ci_low', 'difference_ci_high')} FROM
 (SELECT pair, family, 100.0 * avg(left_shift) AS left_shift_points, 100.0 * avg(right_shift) AS right_shift_points, count(*) AS n_common_models, count(DISTINCT owner) AS n_common_owners FROM fx_common GROUP BY ALL) e
 JOIN (SELECT pair, family, quantile_cont(l, 0.025) AS left_ci_low, quantile_cont(l, 0.975) AS left_ci_high, quantile_cont(r, 0.025) AS right_ci_low, quantile_cont(r, 0.975) AS right_ci_high,
   quantile_cont(r - l, 0.025) AS difference_ci_low, quantile_cont(r - l, 0.975) AS difference_ci_high, count(*) AS replicates FROM fx_common_boot GROUP BY ALL) c ON c.pair = e.pair AND c.family = e.family""")
def exact_common_family_shifts(fx):
    return rounded(synthesis.common_family_shifts(common(fx), REPLICATES, OWNER_SEED))


CONTRAST = "max({c}) FILTER (family = 'BUILDING') - max({c}) FILTER (family = 'MACHINERY')"


@query("exact_common_models", f"""WITH e AS (SELECT pair, {CONTRAST.format(c='l')} AS l, {CONTRAST.format(c='r')} AS r FROM (SELECT pair, family, 100.0 * avg(left_shift) AS l, 100.0 * avg(right_shift) AS r FROM fx_common GROUP BY ALL) GROUP BY 1),
 b AS (SELECT * FROM (SELECT pair, replicate, {CONTRAST.format(c='l')} AS l, {CONTRAST.format(c='r')} AS r FROM fx_common_boot GROUP BY ALL) WHERE l IS NOT NULL),
 et AS (SELECT pair, unnest(['left', 'right', 'difference']) AS side, unnest([l, r, r - l]) AS estimate_points FROM e), bt AS (SELECT pair, unnest(['left', 'right', 'difference']) AS side, unnest([l, r, r - l]) AS v FROM b)
 SELECT et.pair, et.side, round(any_value(estimate_points), 8) AS estimate_points, round(quantile_cont(v, 0.025), 8) AS owner_bootstrap_ci_low, round(quantile_cont(v, 0.975), 8) AS owner_bootstrap_ci_high, count(*) AS replicates,
  any_value(n_common_models) AS n_common_models, any_value(n_common_owners) AS n_common_owners FROM et JOIN bt ON bt.pair = et.pair AND bt.side = et.side
  JOIN (SELECT pair, count(*) AS n_common_models, count(DISTINCT owner) AS n_common_owners FROM fx_common GROUP BY 1) n ON n.pair = et.pair GROUP BY et.pair, et.side""")
def exact_common_models(fx):
    return rounded(synthesis.common_contrast(common(fx), "BUILDING", "MACHINERY", REPLICATES, OWNER_SEED))


# --- fractions ---------------------------------------------------------------

FRAC_SQL = ", ".join(f"{f}::DOUBLE" for f in FRACTIONS)
CTES["fx_frac"] = f"""SELECT *, r <= k AS selected, CASE WHEN r <= k THEN n::DOUBLE / k ELSE 0.0::DOUBLE END AS weight FROM (SELECT *, greatest(1, least(n, round_even(round(fraction * n, 9), 0)))::BIGINT AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY benchmark, half, fraction, cell ORDER BY magnitude, item_id) AS r, count(*) OVER (PARTITION BY benchmark, half, fraction, cell) AS n
  FROM (SELECT *, unnest([{FRAC_SQL}]) AS fraction FROM fx_cells)))"""
CTES["fx_frac_scores"] = """SELECT t.benchmark, t.half, f.fraction, t.model_id, t.family, t.owner, round(avg(y), 12) AS full_score, round(sum(weight * y) / sum(weight), 12) AS low_score
  FROM fx_target t JOIN fx_frac f ON f.benchmark = t.benchmark AND f.half = t.half AND f.item_id = t.item_id GROUP BY ALL"""
CTES["fx_frac_pairs"] = pair_counts_sql("fx_frac_scores", (*FOLD, "fraction"))


@lru_cache(maxsize=4)
def fraction_anchors(fx: Fixture):
    cells = fx.cells.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in FRACTIONS])))
    return cut(blueprint.anchor_select(cells, F.col("fraction"), "magnitude", [*FOLD, "fraction"]))


def fraction_observed(fx: Fixture):
    keys = [*FOLD, "fraction"]
    target = fx.target.withColumn("fraction", F.explode(F.array(*[F.lit(f) for f in FRACTIONS])))
    low = scoring.weighted_accuracy(target, fraction_anchors(fx), keys).withColumnRenamed("score", "low_score")
    scored = low.join(fx.scored.drop("low_score"), [*FOLD, "model_id"])
    return pairs.pairwise_reversals(cut(scored), keys, GAP)


@query("anchor_table", f"SELECT benchmark, half, fraction, item_id, item_group, cell, selected, {rnd('weight', 'magnitude', 'intercept')} FROM fx_frac")
def anchor_table(fx):
    return rounded(fraction_anchors(fx).select(*FOLD, "fraction", "item_id", "item_group", "cell", "selected", "weight", "magnitude", "intercept"))


@query("ranking_gate", f"""WITH per AS (SELECT benchmark, fraction, avg(kendall_tau_b) AS tau, sum(close_cross_family_pairs) AS pairs, sum(close_cross_family_flips)::DOUBLE / sum(close_cross_family_pairs) AS rate FROM fx_frac_pairs GROUP BY ALL),
 t AS (SELECT benchmark, max(tau) FILTER (fraction = 0.5) AS tau, max(rate) FILTER (fraction = 0.5) AS rate, max(pairs) FILTER (fraction = 0.5) AS pairs, bool_and(tau <= 0.97 AND rate >= 0.075) FILTER (fraction <> 0.5) AS sens FROM per GROUP BY 1),
 c AS (SELECT benchmark, max(p) FILTER (metric IN ('close_cross_family_flip_rate', 'score_shift_range_points')) <= 0.01 AS sup FROM ({CONTROL_SUMMARY_SQL}) GROUP BY 1), b AS ({BOOT_ROWS_SQL}),
 g AS (SELECT t.benchmark, tau <= 0.95 AS tau_le_095, rate >= 0.1 AS flip_rate_ge_010, tau_ci_high < 0.98 AS bootstrap_tau_lt_098, close_flip_ci_low > 0.05 AS bootstrap_flip_gt_005, sens AS sensitivity_consistent, pairs >= 50 AS at_least_50_pairs, sup AS controls_support
   FROM t JOIN b ON b.benchmark = t.benchmark JOIN c ON c.benchmark = t.benchmark)
 SELECT *, CASE WHEN tau_le_095 AND flip_rate_ge_010 AND bootstrap_tau_lt_098 AND bootstrap_flip_gt_005 AND sensitivity_consistent AND at_least_50_pairs THEN 'go' WHEN controls_support THEN 'narrow_go' ELSE 'no_go' END AS decision FROM g""")
def ranking_gate(fx):
    return synthesis.ranking_gate(fraction_observed(fx), bootstrap_table(fx), control_summary(fx), 0.5)


# --- variants and gaps -------------------------------------------------------

CTES["fx_var_obs"] = """SELECT 'baseline' AS variant, benchmark, half, close_cross_family_pairs AS p, close_cross_family_flips AS f, kendall_tau_b FROM fx_observed
  UNION ALL SELECT 'discrimination_matched', benchmark, half, close_cross_family_pairs, close_cross_family_flips, kendall_tau_b FROM fx_observed
  UNION ALL SELECT 'all_swapped', benchmark, half, close_cross_family_pairs, close_cross_family_flips, kendall_tau_b FROM fx_allswap_pairs"""
CTES["fx_var_ctl"] = """SELECT 'baseline' AS variant, benchmark, replicate, close_cross_family_pairs AS p, close_cross_family_flips AS f FROM fx_control_pairs
  UNION ALL SELECT 'discrimination_matched', benchmark, replicate, close_cross_family_pairs, close_cross_family_flips FROM fx_eval_disc
  UNION ALL SELECT 'all_swapped', benchmark, replicate, close_cross_family_pairs, close_cross_family_flips FROM fx_counter_pairs"""
CTES["fx_variants"] = """SELECT benchmark, variant, eligible_pairs, reversals, rate, med, pv, tau, replicates, rate > med AS positive_excess, rate > med AND pv <= 0.05 AS significant_positive_excess FROM (
  SELECT o.benchmark, o.variant, any_value(o.p) AS eligible_pairs, any_value(o.f) AS reversals, any_value(o.rate) AS rate, any_value(o.tau) AS tau, quantile_cont(n.r, 0.5) AS med,
    (1 + count(*) FILTER (n.r >= o.rate))::DOUBLE / (1 + count(*)) AS pv, count(*) AS replicates FROM
    (SELECT variant, benchmark, sum(p)::BIGINT AS p, sum(f)::BIGINT AS f, sum(f)::DOUBLE / sum(p) AS rate, avg(kendall_tau_b) AS tau FROM fx_var_obs GROUP BY ALL) o
    JOIN (SELECT variant, benchmark, replicate, sum(f)::DOUBLE / sum(p) AS r FROM fx_var_ctl GROUP BY ALL) n ON n.variant = o.variant AND n.benchmark = o.benchmark GROUP BY o.benchmark, o.variant)"""


@lru_cache(maxsize=4)
def variant_table(fx: Fixture):
    """Three weighting variants whose observed and control counts are checkable."""
    found = cut(matching.pair_random(fx.anchors, CONTROL_SEED, FOLD))
    swap, every, _ = scenario_tables(fx, fx.anchors, fx.target, fx.scored, found, "random_pairing", REPLICATES)
    counter = swap.select(*FOLD, "replicate", F.col("complement_pairs").alias("close_cross_family_pairs"), F.col("complement_flips").alias("close_cross_family_flips"))
    tag = lambda t, v: t.withColumn("variant", F.lit(v))
    cols = ["variant", *FOLD, "close_cross_family_pairs", "close_cross_family_flips"]
    obs = cut(observed(fx))
    all_obs = audit._union([tag(t, v).select(*cols, "kendall_tau_b") for t, v in (
        (obs, "baseline"), (obs, "discrimination_matched"), (every.drop("scenario"), "all_swapped"))])
    all_ctl = audit._union([tag(t, v).select(*cols, "replicate") for t, v in (
        (fx.controls, "baseline"), (cut(evaluated(fx, disc_weights(fx))), "discrimination_matched"), (counter, "all_swapped"))])
    return cut(summaries.variant_summary(all_obs, all_ctl, ["benchmark", "variant"]))


@query("variant_summary", """SELECT benchmark, variant, eligible_pairs, reversals, round(rate, 8) AS low_dif_reversal_rate, round(med, 8) AS random_median_rate, round(pv, 8) AS p, round(tau, 8) AS mean_kendall_tau_b,
  replicates, positive_excess, significant_positive_excess FROM fx_variants""")
def variant_summary(fx):
    return rounded(variant_table(fx))


@query("variant_criteria", """SELECT variant, count(*) FILTER (positive_excess) AS positive_benchmarks, count(*) FILTER (significant_positive_excess) AS significant_benchmarks,
  count(*) FILTER (positive_excess) >= 2 AS passes_direction_gate, count(*) FILTER (significant_positive_excess) >= 2 AS passes_significance_gate FROM fx_variants GROUP BY 1""")
def variant_criteria(fx):
    return summaries.variant_criteria(variant_table(fx), 2)


@query("variant_run")
def variant_run(fx):
    """Two owner caps through both folds of one benchmark at a frozen dimension."""
    cells = benchmark_cells(fx)
    caps = audit._union([population.owner_cap(fx.models, c, CAP_SEED).withColumn("variant", F.lit(f"owner_cap_{c}")) for c in (1, 3)])
    out = audit.variant_run(cells, caps.select("variant", "model_id", "family", "owner"), fx.owner_halves, SHORT, 1)
    return rounded(summaries.variant_summary(out["observed"], out["controls"], ["variant"]), 6)


@query("gap_run", f"""SELECT g.*, CASE WHEN g.gap <> {GAP} THEN 'other_gap' WHEN g.pairs = o.p AND g.flips = o.f THEN 'equal' ELSE 'differs' END AS primary_check FROM ({GAP_SUMMARY_SQL}) g
  JOIN (SELECT benchmark, sum(close_cross_family_pairs)::BIGINT AS p, sum(close_cross_family_flips)::BIGINT AS f FROM fx_observed GROUP BY 1) o ON o.benchmark = g.benchmark""")
def gap_run(fx):
    """All gap tables of all benchmarks; the one-point row must equal the primary counts."""
    table = summaries.gap_summary(*[cut(t) for t in gap_tables(fx)], ["benchmark"])
    primary = observed(fx).groupBy("benchmark").agg(F.sum("close_cross_family_pairs").alias("_p"), F.sum("close_cross_family_flips").alias("_f"))
    same = (F.col("pairs") == F.col("_p")) & (F.col("flips") == F.col("_f"))
    return rounded(table.join(primary, "benchmark").withColumn(
        "primary_check", F.when(F.col("gap") != GAP, "other_gap").when(same, "equal").otherwise("differs")).drop("_p", "_f"))


