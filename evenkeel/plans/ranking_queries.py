"""Registered queries: scores, pair reversals, controls, bootstraps and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import inference
from ..functions.ranks import percentile_rank
from ..operators import pairs, resampling, scoring, summaries
from .fixture import (BOOT_SEED, FOLD, GAP, GAPS, OWNER_SEED, REPLICATES, Fixture, pair_counts_sql, percentile_sql,
                      pick_sql)
from .registry import query, rnd, rounded

GAP_LIST = ", ".join(f"{g}::DOUBLE" for g in GAPS)
METRICS = ["all_pairs", "all_flips", "cross_family_pairs", "cross_family_flips", "close_cross_family_pairs",
           "close_cross_family_flips"]
METRIC_SQL = ", ".join(METRICS)


def observed(fx: Fixture):
    return pairs.pairwise_reversals(fx.scored, FOLD, GAP)


def observed_full(fx: Fixture):
    return observed(fx).join(scoring.family_shift_range(fx.shifts, FOLD), list(FOLD))


@query("full_scores", f"SELECT benchmark, model_id, count(*) AS n, sum(y)::BIGINT AS s, round(avg(y), 8) AS acc FROM fx_all GROUP BY ALL")
def full_scores(fx):
    return rounded(scoring.full_scores(fx.all_responses, ["benchmark"]))


@query("weighted_accuracy", "SELECT benchmark, half, model_id, round(low_score, 8) AS score FROM fx_scored")
def weighted_accuracy(fx):
    return rounded(scoring.weighted_accuracy(fx.target, fx.anchors, FOLD))


@query("percentile_ranks", f"SELECT benchmark, half, model_id, round({percentile_sql('', 'benchmark, half', 'full_score', 'x').replace(' AS x', '')}, 8) AS pct FROM fx_scored")
def percentile_ranks(fx):
    return rounded(percentile_rank(fx.scored, FOLD, "full_score", "pct").select(*FOLD, "model_id", "pct"))


@query("score_shift_table", f"SELECT benchmark, half, model_id, family, owner, {rnd('full_score', 'low_score', 'full_pct', 'low_pct', 'score_shift', 'percentile_shift')} FROM fx_shifts")
def score_shift_table(fx):
    return rounded(fx.shifts)


@query("model_pairs", f"""SELECT a.benchmark, a.half, a.model_id AS left_id, b.model_id AS right_id, round(abs(a.full_score - b.full_score), 8) AS gap,
  a.family = b.family AS same_family FROM fx_scored a JOIN fx_scored b ON a.benchmark = b.benchmark AND a.half = b.half AND a.model_id < b.model_id
  WHERE a.owner <> b.owner AND round(abs(a.full_score - b.full_score), 12) <= {GAP}""")
def model_pairs(fx):
    return rounded(pairs.near_pairs(fx.scored, GAP, FOLD, cross_family=False))


@query("pairwise_reversals", f"""SELECT benchmark, half, {METRIC_SQL}, round(all_flips::DOUBLE / nullif(all_pairs, 0), 8) AS all_flip_rate,
  round(cross_family_flips::DOUBLE / nullif(cross_family_pairs, 0), 8) AS cross_family_flip_rate,
  round(close_cross_family_flips::DOUBLE / nullif(close_cross_family_pairs, 0), 8) AS close_cross_family_flip_rate, {rnd('kendall_tau_b')} FROM fx_observed""")
def pairwise_reversals(fx):
    m = pairs.with_rates(observed(fx), ["all", "cross_family", "close_cross_family"])
    return rounded(m.drop("close_same_family_pairs", "close_same_family_flips"))


@query("pairwise_cross_within", """SELECT benchmark, half, close_cross_family_pairs, close_cross_family_flips, close_same_family_pairs, close_same_family_flips,
  round(close_cross_family_flips::DOUBLE / nullif(close_cross_family_pairs, 0), 8) AS close_cross_family_flip_rate,
  round(close_same_family_flips::DOUBLE / nullif(close_same_family_pairs, 0), 8) AS close_same_family_flip_rate FROM fx_observed""")
def pairwise_cross_within(fx):
    m = pairs.with_rates(observed(fx), ["close_cross_family", "close_same_family"])
    return rounded(m.select(*FOLD, *[c for c in m.columns if c.startswith("close_")]))


@query("kendall_tau_b", f"SELECT benchmark, half, {rnd('kendall_tau_b')} FROM fx_observed")
def kendall_tau_b(fx):
    return rounded(pairs.kendall_tau_b(fx.scored, FOLD, "full_score", "low_score"))


def _gap_sql(src: str, by: str) -> str:
    cols = by.split(", ")
    on = " AND ".join(f"a.{c} = b.{c}" for c in cols)
    return f"""(SELECT {by}, gap, count(*) FILTER (d <= gap AND t <> 0) AS pairs, count(*) FILTER (d <= gap AND t < 0) AS flips
      FROM (SELECT {', '.join('a.' + c for c in cols)}, round(abs(a.full_score - b.full_score), 12) AS d,
        sign(round(a.full_score - b.full_score, 12)) * sign(round(a.low_score - b.low_score, 12)) AS t, unnest([{GAP_LIST}]) AS gap
        FROM {src} a JOIN {src} b ON {on} AND a.model_id < b.model_id WHERE a.owner <> b.owner AND a.family <> b.family) GROUP BY ALL)"""


GAP_OBS_SQL = _gap_sql("fx_scored", "benchmark, half")
GAP_CTL_SQL = _gap_sql("fx_control_scores", "benchmark, half, replicate")


@query("gap_curve", f"SELECT * FROM {GAP_OBS_SQL}")
def gap_curve(fx):
    return pairs.gap_curve(fx.scored, GAPS, FOLD)


@query("family_shifts", """SELECT benchmark, half, family, count(*) AS representatives, round(avg(percentile_shift), 8) AS mean_percentile_shift,
  round(median(percentile_shift), 8) AS median_percentile_shift, round(100.0 * avg(score_shift), 8) AS mean_score_shift_points FROM fx_shifts GROUP BY ALL""")
def family_shifts(fx):
    return rounded(scoring.family_shifts(fx.shifts, FOLD))


@query("family_shift_range", f"SELECT benchmark, half, {rnd('score_shift_range_points', 'percentile_shift_range')} FROM fx_ranges")
def family_shift_range(fx):
    return rounded(scoring.family_shift_range(fx.shifts, FOLD))


@query("source_aggregates", f"SELECT benchmark, half, unit, model_id, full_success, full_mass, {rnd('low_success', 'low_mass')} FROM fx_aggregates")
def source_aggregates(fx):
    return rounded(fx.aggregates)


# --- resampling --------------------------------------------------------------

@query("matched_random_controls", f"""SELECT benchmark, half, replicate, {METRIC_SQL}, close_same_family_pairs, close_same_family_flips,
  {rnd('kendall_tau_b', 'score_shift_range_points', 'percentile_shift_range')} FROM fx_controls""")
def matched_random_controls(fx):
    return rounded(resampling.matched_random_controls(
        fx.target, fx.anchors, fx.scored, REPLICATES, 13, FOLD, GAP))


def times_sql(src: str, unit: str, by: str, seed: int, reps: int = REPLICATES) -> str:
    """Multinomial draw counts per (by, replicate, unit)."""
    keys = by.split(", ") if by else []
    key_list = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {by}" if by else ""
    tag = ", ".join(["'%d'" % seed, "'slot'", *keys, unit])
    slots = f"""(SELECT {key_list}{unit}, row_number() OVER ({part} ORDER BY md5(concat_ws('|', {tag})), {unit}) - 1 AS slot,
      count(*) OVER ({part}) AS n FROM (SELECT DISTINCT {key_list}{unit} FROM {src}))"""
    drawn = f"""(SELECT {key_list}replicate, {pick_sql(seed, 'n', *keys, 'replicate', 'slot')} AS slot FROM
      (SELECT *, unnest(range(1, {reps + 1})) AS replicate FROM {slots}))"""
    using = ", ".join([*keys, "slot"])
    return f"(SELECT {key_list}replicate, {unit}, count(*) AS times FROM {drawn} JOIN {slots} USING ({using}) GROUP BY ALL)"


COMP_SQL = f"""(SELECT benchmark, half, replicate, model_id, round(sum(times * full_success)::DOUBLE / sum(times * full_mass), 12) AS full_score,
  round(sum(times * low_success) / sum(times * low_mass), 12) AS low_score
  FROM fx_aggregates JOIN {times_sql('fx_aggregates', 'unit', 'benchmark, half', BOOT_SEED)} USING (benchmark, half, unit) GROUP BY ALL)"""
COMP_META_SQL = f"""(SELECT c.benchmark, c.half, c.replicate, c.model_id, c.full_score, c.low_score, s.family, s.owner, s.full_score AS obs
  FROM {COMP_SQL} c JOIN fx_scored s ON s.benchmark = c.benchmark AND s.half = c.half AND s.model_id = c.model_id)"""
BOOT_SQL = f"""(SELECT * FROM ({pair_counts_sql('cs', ('benchmark', 'half', 'replicate')).replace('round(abs(a.full_score - b.full_score), 12)', 'round(abs(a.obs - b.obs), 12)')}))"""


def _boot(select: str) -> str:
    return f"WITH cs AS {COMP_META_SQL} SELECT {select} FROM {BOOT_SQL}"


@query("composition_bootstrap", _boot(f"benchmark, half, replicate, {METRIC_SQL}, {rnd('kendall_tau_b')}"))
def composition_bootstrap(fx):
    return rounded(resampling.composition_bootstrap(fx.aggregates, fx.scored, REPLICATES, BOOT_SEED, FOLD, GAP))


@query("bootstrap_summary", f"""WITH cs AS {COMP_META_SQL}, pooled AS (SELECT benchmark, replicate, avg(kendall_tau_b) AS tau,
  sum(close_cross_family_flips)::DOUBLE / nullif(sum(close_cross_family_pairs), 0) AS rate FROM {BOOT_SQL} GROUP BY ALL)
 SELECT benchmark, round(quantile_cont(tau, 0.025), 8) AS tau_ci_low, round(quantile_cont(tau, 0.975), 8) AS tau_ci_high,
  round(quantile_cont(rate, 0.025), 8) AS close_flip_ci_low, round(quantile_cont(rate, 0.975), 8) AS close_flip_ci_high, count(*) AS replicates
 FROM pooled GROUP BY 1""")
def bootstrap_summary(fx):
    boot = resampling.composition_bootstrap(fx.aggregates, fx.scored, REPLICATES, BOOT_SEED, FOLD, GAP)
    return rounded(summaries.bootstrap_summary(boot, ["benchmark"]))


OWNER_BOOT_SQL = f"""(SELECT benchmark, replicate, family, sum(times * percentile_shift) / sum(times) AS mean_percentile_shift,
  100.0 * sum(times * score_shift) / sum(times) AS mean_score_shift_points
  FROM fx_shifts JOIN {times_sql('fx_shifts', 'owner', 'benchmark', OWNER_SEED)} USING (benchmark, owner) GROUP BY ALL)"""


@query("owner_bootstrap", f"SELECT benchmark, replicate, family, {rnd('mean_percentile_shift', 'mean_score_shift_points')} FROM {OWNER_BOOT_SQL}")
def owner_bootstrap(fx):
    return rounded(resampling.owner_bootstrap(fx.shifts, REPLICATES, OWNER_SEED, ["benchmark"]))


@query("owner_bootstrap_summary", f"""SELECT e.*, {rnd('percentile_shift_ci_low', 'percentile_shift_ci_high', 'score_shift_ci_low', 'score_shift_ci_high')} FROM
 (SELECT benchmark, family, count(*) AS representatives, round(avg(percentile_shift), 8) AS mean_percentile_shift, round(100.0 * avg(score_shift), 8) AS mean_score_shift_points
  FROM fx_shifts GROUP BY ALL) e JOIN
 (SELECT benchmark, family, quantile_cont(mean_percentile_shift, 0.025) AS percentile_shift_ci_low, quantile_cont(mean_percentile_shift, 0.975) AS percentile_shift_ci_high,
  quantile_cont(mean_score_shift_points, 0.025) AS score_shift_ci_low, quantile_cont(mean_score_shift_points, 0.975) AS score_shift_ci_high
  FROM {OWNER_BOOT_SQL} GROUP BY ALL) c ON c.benchmark = e.benchmark AND c.family = e.family""")
def owner_bootstrap_summary(fx):
    boot = resampling.owner_bootstrap(fx.shifts, REPLICATES, OWNER_SEED, ["benchmark"])
    return rounded(summaries.owner_bootstrap_summary(fx.shifts, boot, ["benchmark"]))


@query("quantile_interval", """SELECT c_mktsegment AS family, round(quantile_cont(c_acctbal, 0.025), 6) AS ci_low, round(quantile_cont(c_acctbal, 0.975), 6) AS ci_high
  FROM customer GROUP BY 1""")
def quantile_interval(fx):
    t = fx.table("customer").groupBy(F.col("c_mktsegment").alias("family")).agg(*inference.quantile_interval("c_acctbal"))
    return rounded(t, 6)


FIVE = ["kendall_tau_b", "cross_family_flip_rate", "close_cross_family_flip_rate", "score_shift_range_points", "percentile_shift_range"]


def five_sql(src: str, by: str) -> str:
    return f"""(SELECT {by}, unnest({FIVE}) AS metric, unnest([round(avg(kendall_tau_b), 12),
      round(sum(cross_family_flips)::DOUBLE / nullif(sum(cross_family_pairs), 0), 12),
      round(sum(close_cross_family_flips)::DOUBLE / nullif(sum(close_cross_family_pairs), 0), 12),
      round(avg(score_shift_range_points), 12), round(avg(percentile_shift_range), 12)]) AS value FROM {src} GROUP BY {by})"""


CONTROL_SUMMARY_SQL = f"""SELECT n.benchmark, n.metric, round(any_value(o.value), 8) AS observed, round(quantile_cont(n.value, 0.5), 8) AS random_median,
  round(quantile_cont(n.value, 0.025), 8) AS random_ci_low, round(quantile_cont(n.value, 0.975), 8) AS random_ci_high,
  round((1 + count(*) FILTER (CASE WHEN n.metric = 'kendall_tau_b' THEN n.value <= o.value ELSE n.value >= o.value END))::DOUBLE / (1 + count(*)), 8) AS p,
  CASE WHEN n.metric = 'kendall_tau_b' THEN 'control <= observed' ELSE 'control >= observed' END AS extreme_direction, count(*) AS replicates
  FROM {five_sql('fx_controls', 'benchmark, replicate')} n JOIN {five_sql('fx_observed_full', 'benchmark')} o ON o.benchmark = n.benchmark AND o.metric = n.metric
  GROUP BY n.benchmark, n.metric"""


@query("control_summary", CONTROL_SUMMARY_SQL)
def control_summary(fx):
    return rounded(summaries.control_summary(observed_full(fx), fx.controls, ["benchmark"]))


REVERSAL_SQL = """(SELECT o.benchmark, any_value(o.p) AS eligible_pairs, any_value(o.f) AS reversals, any_value(o.rate) AS low_dif_reversal_rate, count(*) AS replicates,
    count(*) FILTER (n.rate IS NULL) AS undefined_replicates, quantile_cont(n.rate, 0.5) AS med,
    (1 + count(*) FILTER (n.rate >= o.rate))::DOUBLE / (1 + count(*)) AS pv
  FROM (SELECT benchmark, sum(close_cross_family_pairs)::BIGINT AS p, sum(close_cross_family_flips)::BIGINT AS f,
      sum(close_cross_family_flips)::DOUBLE / nullif(sum(close_cross_family_pairs), 0) AS rate FROM fx_observed GROUP BY 1) o
  JOIN (SELECT benchmark, replicate, sum(close_cross_family_flips)::DOUBLE / nullif(sum(close_cross_family_pairs), 0) AS rate FROM fx_controls GROUP BY ALL) n
    ON n.benchmark = o.benchmark GROUP BY o.benchmark)"""


@query("reversal_summary", f"""SELECT benchmark, eligible_pairs, reversals, {rnd('low_dif_reversal_rate')}, replicates, undefined_replicates,
  round(CASE WHEN ok THEN med END, 8) AS random_median_rate, round(CASE WHEN ok THEN ex END, 8) AS excess_pp, round(CASE WHEN ok THEN pv END, 8) AS p,
  CASE WHEN eligible_pairs = 0 THEN 'insufficient_eligible_pairs' WHEN NOT ok THEN 'undefined_random_controls'
    WHEN ex > 0 AND pv <= 0.05 THEN 'excess_sensitivity_detected' ELSE 'no_significant_excess_detected' END AS status
  FROM (SELECT *, eligible_pairs > 0 AND undefined_replicates = 0 AS ok, 100.0 * (low_dif_reversal_rate - med) AS ex FROM {REVERSAL_SQL})""")
def reversal_summary(fx):
    return rounded(summaries.reversal_summary(observed(fx), fx.controls, ["benchmark"]))


@query("empirical_p", """SELECT n.benchmark, round((1 + count(*) FILTER (n.v >= o.v))::DOUBLE / (1 + count(*)), 8) AS p,
  round((1 + count(*) FILTER (abs(n.v) >= abs(o.v)))::DOUBLE / (1 + count(*)), 8) AS p_two_sided
  FROM (SELECT benchmark, replicate, round(avg(kendall_tau_b), 12) AS v FROM fx_controls GROUP BY ALL) n
  JOIN (SELECT benchmark, round(avg(kendall_tau_b), 12) AS v FROM fx_observed GROUP BY 1) o ON o.benchmark = n.benchmark GROUP BY 1""")
def empirical_p(fx):
    null = fx.controls.groupBy("benchmark", "replicate").agg(F.round(F.avg("kendall_tau_b"), 12).alias("v"))
    obs = observed(fx).groupBy("benchmark").agg(F.round(F.avg("kendall_tau_b"), 12).alias("observed"))
    one = summaries.empirical_p(null, obs, ["benchmark"], "v")
    two = summaries.empirical_p(null, obs, ["benchmark"], "v", True).withColumnRenamed("p", "p_two_sided")
    return rounded(one.join(two, "benchmark"))


@query("pooled_rates", """SELECT benchmark, replicate, sum(close_cross_family_pairs)::BIGINT AS pairs, sum(close_cross_family_flips)::BIGINT AS flips,
  round(sum(close_cross_family_flips)::DOUBLE / nullif(sum(close_cross_family_pairs), 0), 8) AS rate FROM fx_controls GROUP BY ALL""")
def pooled_rates(fx):
    return rounded(summaries.pooled_rates(fx.controls, ["benchmark", "replicate"], "close_cross_family_pairs", "close_cross_family_flips"))


GAP_BOOT_SQL = f"""(SELECT benchmark, half, replicate, gap, count(*) FILTER (t <> 0) AS pairs, count(*) FILTER (t < 0) AS flips FROM
  (SELECT a.benchmark, a.half, a.replicate, g.gap, sign(round(a.full_score - b.full_score, 12)) * sign(round(a.low_score - b.low_score, 12)) AS t
   FROM cs a JOIN cs b ON a.benchmark = b.benchmark AND a.half = b.half AND a.replicate = b.replicate AND a.model_id < b.model_id
   JOIN (SELECT unnest([{GAP_LIST}]) AS gap) g ON round(abs(a.obs - b.obs), 12) <= g.gap + 1e-12
   WHERE a.owner <> b.owner AND a.family <> b.family) GROUP BY ALL)"""


@query("gap_bootstrap", f"WITH cs AS {COMP_META_SQL} SELECT * FROM {GAP_BOOT_SQL}")
def gap_bootstrap(fx):
    return resampling.gap_bootstrap(fx.aggregates, fx.scored, GAPS, REPLICATES, BOOT_SEED, FOLD)


@query("gap_controls", f"SELECT * FROM {GAP_CTL_SQL}")
def gap_controls(fx):
    return resampling.gap_controls(fx.control_scores, GAPS, FOLD)


GAP_SUMMARY_SQL = f"""WITH cs AS {COMP_META_SQL},
 o AS (SELECT benchmark, gap, sum(pairs)::BIGINT AS pairs, sum(flips)::BIGINT AS flips, sum(flips)::DOUBLE / nullif(sum(pairs), 0) AS flip_rate FROM {GAP_OBS_SQL} GROUP BY ALL),
 b AS (SELECT benchmark, gap, quantile_cont(r, 0.025) AS bootstrap_ci_low, quantile_cont(r, 0.975) AS bootstrap_ci_high, quantile_cont(r, 0.5) AS bootstrap_median
   FROM (SELECT benchmark, gap, replicate, sum(flips)::DOUBLE / nullif(sum(pairs), 0) AS r FROM {GAP_BOOT_SQL} GROUP BY ALL) GROUP BY ALL),
 n AS (SELECT benchmark, gap, replicate, sum(flips)::DOUBLE / nullif(sum(pairs), 0) AS r FROM {GAP_CTL_SQL} GROUP BY ALL),
 c AS (SELECT n.benchmark, n.gap, quantile_cont(r, 0.025) AS random_ci_low, quantile_cont(r, 0.975) AS random_ci_high, quantile_cont(r, 0.5) AS random_median,
   (1 + count(*) FILTER (r >= flip_rate))::DOUBLE / (1 + count(*)) AS p FROM n JOIN o ON o.benchmark = n.benchmark AND o.gap = n.gap GROUP BY ALL)
 SELECT o.benchmark, o.gap, pairs, flips, {rnd('flip_rate', 'bootstrap_ci_low', 'bootstrap_ci_high', 'bootstrap_median', 'random_ci_low', 'random_ci_high', 'random_median', 'p')},
  round(flip_rate - random_median, 8) AS excess FROM o JOIN b ON b.benchmark = o.benchmark AND b.gap = o.gap JOIN c ON c.benchmark = o.benchmark AND c.gap = o.gap"""


def gap_tables(fx: Fixture):
    return (pairs.gap_curve(fx.scored, GAPS, FOLD),
            resampling.gap_bootstrap(fx.aggregates, fx.scored, GAPS, REPLICATES, BOOT_SEED, FOLD),
            resampling.gap_controls(fx.control_scores, GAPS, FOLD))


@query("gap_summary", GAP_SUMMARY_SQL)
def gap_summary(fx):
    return rounded(summaries.gap_summary(*gap_tables(fx), ["benchmark"]))


@query("frozen_fold_inputs", """SELECT benchmark, half, count(*) AS models, count(*) FILTER (abs(f.full_score - g.s) > 1e-12) AS score_differs,
  count(*) FILTER (f.model_id IS NULL OR g.model_id IS NULL) AS missing FROM fx_scored f FULL JOIN
  (SELECT benchmark, half, model_id, round(avg(y), 12) AS s FROM fx_target GROUP BY ALL) g USING (benchmark, half, model_id) GROUP BY ALL""")
def frozen_fold_inputs(fx):
    again = fx.target.groupBy(*FOLD, "model_id").agg(F.round(F.avg("y"), 12).alias("score"))
    return summaries.frozen_fold_inputs(fx.scored.select(*FOLD, "model_id", F.col("full_score").alias("score")), again, FOLD)


@query("within_family_summary", """WITH o AS (SELECT benchmark, sum(close_cross_family_pairs)::BIGINT AS cp, sum(close_same_family_pairs)::BIGINT AS sp,
   sum(close_cross_family_flips)::DOUBLE / nullif(sum(close_cross_family_pairs), 0) AS c, sum(close_same_family_flips)::DOUBLE / nullif(sum(close_same_family_pairs), 0) AS s FROM fx_observed GROUP BY 1),
 n AS (SELECT benchmark, replicate, sum(close_cross_family_flips)::DOUBLE / nullif(sum(close_cross_family_pairs), 0) AS c,
   sum(close_same_family_flips)::DOUBLE / nullif(sum(close_same_family_pairs), 0) AS s FROM fx_controls GROUP BY ALL)
 SELECT o.benchmark, any_value(cp) AS cross_family_pairs, any_value(sp) AS same_family_pairs, round(any_value(o.c), 8) AS cross_family_rate, round(any_value(o.s), 8) AS same_family_rate,
  round(100 * (any_value(o.c) - median(n.c)), 8) AS cross_family_excess_points, round(100 * (any_value(o.s) - median(n.s)), 8) AS same_family_excess_points,
  round(100 * (any_value(round(o.c - o.s, 12)) - median(round(n.c - n.s, 12))), 8) AS specificity_excess_points,
  round((1 + count(*) FILTER (n.c >= o.c))::DOUBLE / (1 + count(*)), 8) AS cross_family_p, round((1 + count(*) FILTER (n.s >= o.s))::DOUBLE / (1 + count(*)), 8) AS same_family_p,
  round((1 + count(*) FILTER (round(n.c - n.s, 12) >= round(o.c - o.s, 12)))::DOUBLE / (1 + count(*)), 8) AS specificity_p, count(*) AS replicates
 FROM o JOIN n ON n.benchmark = o.benchmark GROUP BY o.benchmark""")
def within_family_summary(fx):
    return rounded(summaries.within_family_summary(observed(fx), fx.controls, ["benchmark"]))


# --- tests -------------------------------------------------------------------

@query("cell_permutation_null", f"""SELECT a.benchmark, a.half, a.replicate, round(sum(a.magnitude * b.magnitude), 8) AS product, count(*) AS n FROM
  (SELECT *, unnest(range(1, {REPLICATES + 1})) AS replicate, row_number() OVER (PARTITION BY benchmark, half, cell ORDER BY item_id) AS k FROM fx_cells) a JOIN
  (SELECT *, row_number() OVER (PARTITION BY benchmark, half, cell, replicate ORDER BY md5(concat_ws('|', '{BOOT_SEED}', benchmark, half, cell, replicate, item_id)), item_id) AS k
   FROM (SELECT *, unnest(range(1, {REPLICATES + 1})) AS replicate FROM fx_cells)) b
  ON a.benchmark = b.benchmark AND a.half = b.half AND a.cell = b.cell AND a.replicate = b.replicate AND a.k = b.k GROUP BY ALL""")
def cell_permutation_null(fx):
    shuffled = resampling.permute_within(
        fx.cells.withColumn("drawn", F.col("magnitude")), [*FOLD, "cell"], "item_id", ["drawn"], REPLICATES, BOOT_SEED)
    return rounded(shuffled.groupBy(*FOLD, "replicate").agg(
        F.sum(F.col("magnitude") * F.col("drawn")).alias("product"), F.count(F.lit(1)).alias("n")))


BINOM_IN_SQL = "(SELECT s_nationkey AS k, count(*) FILTER (s_acctbal > 5000) AS x, count(*) AS n FROM supplier GROUP BY 1)"
TERM = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5))"


@query("binomial_exact", f"""SELECT k, x, n, round(least(1.0, sum({TERM}) FILTER (i >= x)), 8) AS p_greater,
  round(least(1.0, sum({TERM}) FILTER (abs(i - n / 2.0) >= abs(x - n / 2.0))), 8) AS p_two_sided
  FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM {BINOM_IN_SQL}) GROUP BY ALL""")
def binomial_exact(fx):
    t = fx.table("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(
        F.count_if(F.col("s_acctbal") > 5000).alias("x"), F.count(F.lit(1)).alias("n"))
    return rounded(t.withColumn("p_greater", inference.binomial_greater(F.col("x"), F.col("n")))
                   .withColumn("p_two_sided", inference.binomial_two_sided(F.col("x"), F.col("n"))))


WIL_IN_SQL = """(SELECT s_nationkey AS g, round(s_acctbal / 500.0, 0) - 8 AS d FROM supplier)"""


@query("wilcoxon_signed_rank", f"""WITH nz AS (SELECT * FROM {WIL_IN_SQL} WHERE d <> 0),
 r AS (SELECT g, d, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS r FROM nz),
 t AS (SELECT g, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT g, abs(d), count(*) AS c FROM nz GROUP BY ALL) GROUP BY 1),
 s AS (SELECT g, count(*)::DOUBLE AS n, coalesce(sum(r) FILTER (d > 0), 0) AS up, coalesce(sum(r) FILTER (d < 0), 0) AS down FROM r GROUP BY 1)
 SELECT s.g, n::BIGINT AS n, round(least(up, down), 8) AS statistic, round((up - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 8) AS z FROM s JOIN t ON t.g = s.g""")
def wilcoxon_signed_rank(fx):
    d = fx.table("supplier").select(F.col("s_nationkey").alias("g"), (F.round(F.col("s_acctbal") / 500.0, 0) - 8).alias("d"))
    return rounded(inference.wilcoxon(d, ["g"], "d").select("g", "n", "statistic", "z"))


UNTIED_SQL = "(SELECT s_nationkey AS g, round(s_acctbal - 4500, 6) AS d FROM supplier)"


@query("wilcoxon_exact", f"""WITH RECURSIVE chances(n, c) AS (SELECT 0, [1.0::DOUBLE] UNION ALL
   SELECT n + 1, list_transform(range(0, len(c) + n + 1), lambda s: 0.5 * (coalesce(c[s + 1], 0) + CASE WHEN s >= n + 1 THEN c[s - n] ELSE 0 END)) FROM chances WHERE n < 50),
 r AS (SELECT g, d, row_number() OVER (PARTITION BY g ORDER BY abs(d)) AS r FROM {UNTIED_SQL}),
 s AS (SELECT g, count(*) AS n, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, count(DISTINCT abs(d)) = count(*) AND bool_and(d <> 0) AS plain FROM r GROUP BY 1)
 SELECT g, s.n, round(w::DOUBLE, 8) AS statistic, round(least(1.0, 2 * list_sum(c[1:w::INT + 1])), 8) AS p FROM s JOIN chances USING (n) WHERE plain AND s.n <= 50""")
def wilcoxon_exact(fx):
    d = fx.table("supplier").select(F.col("s_nationkey").alias("g"), F.round(F.col("s_acctbal") - 4500, 6).alias("d"))
    fit = d.groupBy("g").agg((F.count_distinct(F.abs("d")) == F.count("d")).alias("plain"), F.count_if(F.col("d") == 0).alias("zeros"))
    tested = inference.wilcoxon(d, ["g"], "d").join(fit.where("plain AND zeros = 0").select("g"), "g").where(F.col("n") <= inference.EXACT_PAIRS)
    return rounded(tested.select("g", "n", "statistic", "p"))


BH_IN_SQL = "(SELECT o_orderpriority AS g, o_orderkey AS id, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS p FROM orders)"


@query("bh_adjust", f"""SELECT g, id, round(p, 8) AS p, round(least(1.0, min(p * n / rn) OVER (PARTITION BY g ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q
 FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, id) AS rn, count(*) OVER (PARTITION BY g) AS n FROM {BH_IN_SQL})""")
def bh_adjust(fx):
    orders = fx.table("orders")
    top = orders.agg(F.max("o_totalprice")).first()[0]
    p = orders.select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / top).alias("p"))
    return rounded(inference.bh_adjust(p, ["g"], "p", "id"))
