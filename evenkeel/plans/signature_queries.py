"""Registered queries: item signatures, group effects and score-shift attribution."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..operators import signatures as sig
from ..session import cut
from .estimator_queries import both, spectral_fit
from .fixture import BOOT_SEED, CTES, REPLICATES, Fixture
from .ranking_queries import TERM
from .registry import query, rnd, rounded

FAMILIES = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

CTES["fx_ccells"] = """SELECT benchmark, item_id, item_group, item_group || '|' || (ntile(4) OVER (PARTITION BY benchmark, item_group ORDER BY i, item_id) - 1) AS cell FROM (
  SELECT benchmark, item_id, item_group, round(avg(intercept), 12) AS i FROM fx_itemfit GROUP BY ALL)"""
CTES["fx_marks"] = """SELECT d.benchmark, d.item_id, d.cell, d.high AS hd, v.high AS hv, d.adv AS ad, v.adv AS av, d.cm AS md, v.cm AS mv FROM fx_hmarks d JOIN fx_hmarks v
  ON v.benchmark = d.benchmark AND v.item_id = d.item_id AND v.half = 'validation' WHERE d.half = 'discovery'"""
CTES["fx_hmarks"] = """SELECT i.benchmark, i.half, i.item_id, c.cell, round(i.magnitude - avg(i.magnitude) OVER (PARTITION BY i.benchmark, i.half, c.cell), 9) AS cm, a.adv,
  row_number() OVER (PARTITION BY i.benchmark, i.half, c.cell ORDER BY i.magnitude DESC, i.item_id) <= greatest(1, least(count(*) OVER (PARTITION BY i.benchmark, i.half, c.cell),
    round_even(0.2 * count(*) OVER (PARTITION BY i.benchmark, i.half, c.cell), 0))) AS high
  FROM fx_itemfit i JOIN fx_ccells c ON c.benchmark = i.benchmark AND c.item_id = i.item_id
  JOIN (SELECT benchmark, half, item_id, (list(family ORDER BY effect DESC, family))[1] AS adv FROM fx_effects GROUP BY ALL) a ON a.benchmark = i.benchmark AND a.half = i.half AND a.item_id = i.item_id"""
CTES["fx_ceff"] = """SELECT d.benchmark, d.item_id, d.family, d.e AS ed, v.e AS ev FROM fx_ceff_half d JOIN fx_ceff_half v
  ON v.benchmark = d.benchmark AND v.item_id = d.item_id AND v.family = d.family AND v.half = 'validation' WHERE d.half = 'discovery'"""
CTES["fx_ceff_half"] = """SELECT e.benchmark, e.half, e.item_id, e.family, round(effect - avg(effect) OVER (PARTITION BY e.benchmark, e.half, c.cell, e.family), 9) AS e
  FROM fx_effects e JOIN fx_ccells c ON c.benchmark = e.benchmark AND c.item_id = e.item_id"""


def ar(value: str, by: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0)"


CTES["fx_mrank"] = f"SELECT *, {ar('md', 'benchmark')} AS rx, {ar('mv', 'benchmark')} AS ry FROM fx_marks"
CTES["fx_frank"] = f"SELECT *, {ar('ed', 'benchmark, family')} AS rx, {ar('ev', 'benchmark, family')} AS ry FROM fx_ceff"
CTES["fx_shuffle"] = f"""SELECT a.benchmark, a.replicate, a.item_id, b.item_id AS other FROM
  (SELECT *, row_number() OVER (PARTITION BY benchmark, cell, replicate ORDER BY item_id) AS k FROM (SELECT *, unnest(range(1, {REPLICATES + 1})) AS replicate FROM fx_ccells)) a JOIN
  (SELECT *, row_number() OVER (PARTITION BY benchmark, cell, replicate ORDER BY md5(concat_ws('|', '{BOOT_SEED}', benchmark, cell, replicate, item_id)), item_id) AS k
    FROM (SELECT *, unnest(range(1, {REPLICATES + 1})) AS replicate FROM fx_ccells)) b
  ON a.benchmark = b.benchmark AND a.cell = b.cell AND a.replicate = b.replicate AND a.k = b.k"""
CTES["fx_stability"] = f"""WITH f AS (SELECT benchmark, round(median(r), 12) AS median_family_spearman, min(r) AS min_family_spearman, max(r) AS max_family_spearman FROM
   (SELECT benchmark, family, corr(rx, ry) AS r FROM fx_frank GROUP BY ALL) GROUP BY 1),
 m AS (SELECT benchmark, round(corr(rx, ry), 12) AS magnitude_spearman, count(*) AS items, count(*) FILTER (hd) AS high_items, count(*) FILTER (hd AND hv) AS stable_items,
   count(*) FILTER (hd AND hv)::DOUBLE / count(*) FILTER (hd) AS overlap, count(*) FILTER (hd AND hv AND ad = av)::DOUBLE / nullif(count(*) FILTER (hd AND hv), 0) AS agreement FROM fx_mrank GROUP BY 1),
 nm AS (SELECT s.benchmark, s.replicate, round(corr(a.rx, b.ry), 12) AS n_mag, count(*) FILTER (a.hd AND b.hv)::DOUBLE / count(*) FILTER (a.hd) AS n_over,
   count(*) FILTER (a.hd AND b.hv AND a.ad = b.av)::DOUBLE / nullif(count(*) FILTER (a.hd AND b.hv), 0) AS n_agree
   FROM fx_shuffle s JOIN fx_mrank a ON a.benchmark = s.benchmark AND a.item_id = s.item_id JOIN fx_mrank b ON b.benchmark = s.benchmark AND b.item_id = s.other GROUP BY ALL),
 nf AS (SELECT benchmark, replicate, round(median(r), 12) AS n_fam FROM (SELECT s.benchmark, s.replicate, a.family, corr(a.rx, b.ry) AS r FROM fx_shuffle s
   JOIN fx_frank a ON a.benchmark = s.benchmark AND a.item_id = s.item_id JOIN fx_frank b ON b.benchmark = s.benchmark AND b.item_id = s.other AND b.family = a.family GROUP BY ALL) GROUP BY ALL),
 p AS (SELECT m.benchmark, (1 + count(*) FILTER (n_fam >= median_family_spearman))::DOUBLE / (1 + count(*)) AS family_p, (1 + count(*) FILTER (n_mag >= magnitude_spearman))::DOUBLE / (1 + count(*)) AS magnitude_p,
   (1 + count(*) FILTER (n_over >= overlap))::DOUBLE / (1 + count(*)) AS overlap_p, (1 + count(*) FILTER (n_agree >= agreement))::DOUBLE / (1 + count(*)) AS agreement_p
   FROM nm JOIN nf USING (benchmark, replicate) JOIN m USING (benchmark) JOIN f USING (benchmark) GROUP BY m.benchmark),
 rm AS (SELECT benchmark, corr({'a'}, {'b'}) AS raw_magnitude_spearman FROM (SELECT d.benchmark, {ar('d.magnitude', 'd.benchmark')} AS a, {ar('v.magnitude', 'd.benchmark')} AS b FROM fx_itemfit d JOIN fx_itemfit v
   ON v.benchmark = d.benchmark AND v.item_id = d.item_id AND v.half = 'validation' WHERE d.half = 'discovery') GROUP BY 1),
 rf AS (SELECT benchmark, median(r) AS raw_median_family_spearman FROM (SELECT benchmark, family, corr(a, b) AS r FROM (SELECT d.benchmark, d.family, {ar('d.effect', 'd.benchmark, d.family')} AS a, {ar('v.effect', 'd.benchmark, d.family')} AS b
   FROM fx_effects d JOIN fx_effects v ON v.benchmark = d.benchmark AND v.item_id = d.item_id AND v.family = d.family AND v.half = 'validation' WHERE d.half = 'discovery') GROUP BY ALL) GROUP BY 1)
 SELECT *, median_family_spearman > 0.2 AND family_p <= 0.05 AS passes_family, overlap > 0.3 AND overlap_p <= 0.05 AS passes_overlap, coalesce(agreement > 0.4 AND agreement_p <= 0.05, false) AS passes_agreement
 FROM m JOIN f USING (benchmark) JOIN p USING (benchmark) JOIN rm USING (benchmark) JOIN rf USING (benchmark)"""


@lru_cache(maxsize=4)
def stability(fx: Fixture):
    return cut(sig.signature_stability(fx.itemfit, fx.effects, REPLICATES, BOOT_SEED))


@query("owner_half_fits")
def owner_half_fits(fx):
    """Both half fits, with a check that the effect ranges match the saved magnitudes."""
    def one(fx, half):
        fit = spectral_fit(fx, half)
        span = fit.effects.groupBy("item_id").agg((F.max("effect") - F.min("effect")).alias("range"))
        return fit.anchors.join(span, "item_id").select("item_id", "magnitude", "intercept", (F.abs(F.col("range") - F.col("magnitude")) <= 1e-9).alias("agrees"))
    return rounded(both(fx, one), 6)


SIG_SQL = ", ".join(f"round(max(effect) FILTER (half = '{h}' AND family = '{f}'), 8) AS \"{h}_{f}_effect\"" for h in sig.HALVES for f in FAMILIES)


@query("item_signatures", f"""SELECT c.benchmark, c.item_id, c.item_group, c.cell, round(d.magnitude, 8) AS discovery_magnitude, round(v.magnitude, 8) AS validation_magnitude, e.* EXCLUDE (benchmark, item_id)
  FROM fx_ccells c JOIN fx_itemfit d ON d.benchmark = c.benchmark AND d.item_id = c.item_id AND d.half = 'discovery' JOIN fx_itemfit v ON v.benchmark = c.benchmark AND v.item_id = c.item_id AND v.half = 'validation'
  JOIN (SELECT benchmark, item_id, {SIG_SQL} FROM fx_effects GROUP BY ALL) e ON e.benchmark = c.benchmark AND e.item_id = c.item_id""")
def item_signatures(fx):
    return rounded(sig.item_signatures(fx.itemfit, fx.effects, FAMILIES))


@query("rank_correlation", f"""SELECT benchmark, round(corr(a, b), 8) AS spearman, count(*) AS n FROM (SELECT d.benchmark, {ar('d.magnitude', 'd.benchmark')} AS a, {ar('v.magnitude', 'd.benchmark')} AS b
  FROM fx_itemfit d JOIN fx_itemfit v ON v.benchmark = d.benchmark AND v.item_id = d.item_id AND v.half = 'validation' WHERE d.half = 'discovery') GROUP BY 1""")
def rank_correlation(fx):
    return rounded(sig.rank_correlation(fx.itemfit, "magnitude"))


@query("signature_stability", f"""SELECT benchmark, items, high_items, stable_items, {rnd('median_family_spearman', 'min_family_spearman', 'max_family_spearman', 'magnitude_spearman', 'overlap', 'agreement',
  'family_p', 'magnitude_p', 'overlap_p', 'agreement_p', 'raw_magnitude_spearman', 'raw_median_family_spearman')}, passes_family, passes_overlap, passes_agreement, passes_family AND passes_overlap AND passes_agreement AS passes_all FROM fx_stability""")
def signature_stability(fx):
    return rounded(stability(fx))


CTES["fx_source"] = """SELECT d.benchmark, d.family, d.item_group, d.items, d.m AS discovery, v.m AS validation FROM fx_source_half d JOIN fx_source_half v
  ON v.benchmark = d.benchmark AND v.family = d.family AND v.item_group = d.item_group AND v.half = 'validation' WHERE d.half = 'discovery'"""
CTES["fx_source_half"] = """SELECT benchmark, half, family, item_group, round(avg(c), 12) AS m, count(*) AS items FROM (
  SELECT *, effect - avg(effect) OVER (PARTITION BY benchmark, half, family) AS c FROM fx_effects) GROUP BY benchmark, half, family, item_group"""
CTES["fx_source_ext"] = """SELECT *, discovery * validation > 0 AS sign_replicated, validation / nullif(discovery, 0) AS attenuation FROM (
  SELECT benchmark, family, item_group, items, discovery, validation, CASE WHEN r <= 2 THEN 'disadvantage' WHEN r > n - 2 THEN 'advantage' END AS direction FROM (
    SELECT *, row_number() OVER (PARTITION BY benchmark, family ORDER BY discovery, item_group) AS r, count(*) OVER (PARTITION BY benchmark, family) AS n FROM fx_source WHERE items >= 20) WHERE n >= 4)
  WHERE direction IS NOT NULL"""
CTES["fx_contrib"] = """SELECT benchmark, half, family, item_group, source_items, 100.0 * avg(c) AS contribution_points FROM (
  SELECT t.benchmark, t.half, t.family, t.model_id, t.item_group, count(*) AS source_items, sum((weight - 1.0) * y) / 200.0 AS c FROM fx_target t JOIN fx_anchors a
    ON a.benchmark = t.benchmark AND a.half = t.half AND a.item_id = t.item_id GROUP BY ALL) GROUP BY ALL"""
CTES["fx_contrib_ext"] = """SELECT *, discovery * validation > 0 AS sign_replicated FROM (
  SELECT benchmark, family, item_group, discovery, validation, CASE WHEN r <= 2 THEN 'negative_contribution' WHEN r > n - 2 THEN 'positive_contribution' END AS direction FROM (
    SELECT d.benchmark, d.family, d.item_group, round(d.contribution_points, 12) AS discovery, round(v.contribution_points, 12) AS validation,
      row_number() OVER (PARTITION BY d.benchmark, d.family ORDER BY round(d.contribution_points, 12), d.item_group) AS r, count(*) OVER (PARTITION BY d.benchmark, d.family) AS n
    FROM fx_contrib d JOIN fx_contrib v ON v.benchmark = d.benchmark AND v.family = d.family AND v.item_group = d.item_group AND v.half = 'validation' WHERE d.half = 'discovery') WHERE n >= 4)
  WHERE direction IS NOT NULL"""


@query("source_effects", f"SELECT benchmark, family, item_group, items, {rnd('discovery', 'validation')} FROM fx_source")
def source_effects(fx):
    return rounded(sig.source_effects(fx.effects))


@query("source_extremes", f"SELECT benchmark, family, item_group, items, direction, sign_replicated, {rnd('discovery', 'validation')}, round(attenuation, 6) AS attenuation FROM fx_source_ext")
def source_extremes(fx):
    return rounded(sig.source_extremes(sig.source_effects(fx.effects)).withColumn("attenuation", F.round("attenuation", 6)))


@query("source_effect_correlation", f"""SELECT benchmark, family, count(*) AS sources, round(corr(a, b), 8) AS spearman FROM (
  SELECT benchmark, family, {ar('discovery', 'benchmark, family')} AS a, {ar('validation', 'benchmark, family')} AS b FROM fx_source) GROUP BY ALL""")
def source_effect_correlation(fx):
    return rounded(sig.source_effect_correlation(sig.source_effects(fx.effects)))


@query("source_shift_attribution", f"SELECT benchmark, half, family, item_group, source_items, {rnd('contribution_points')} FROM fx_contrib")
def source_shift_attribution(fx):
    return rounded(sig.shift_contributions(fx.target, fx.anchors))


@query("source_shift_check", """SELECT c.benchmark, c.half, c.family, round(s, 8) AS summed_points, round(d, 8) AS direct_points, abs(s - d) < 1e-9 AS exact FROM
  (SELECT benchmark, half, family, sum(contribution_points) AS s FROM fx_contrib GROUP BY ALL) c JOIN (SELECT benchmark, half, family, 100.0 * avg(score_shift) AS d FROM fx_shifts GROUP BY ALL) x
  ON x.benchmark = c.benchmark AND x.half = c.half AND x.family = c.family""")
def source_shift_check(fx):
    t = sig.contribution_check(sig.shift_contributions(fx.target, fx.anchors), fx.shifts)
    return rounded(t.withColumn("exact", F.col("absolute_error") < 1e-9).drop("absolute_error"))


@query("source_shift_extremes", f"SELECT benchmark, family, item_group, direction, sign_replicated, {rnd('discovery', 'validation')} FROM fx_contrib_ext")
def source_shift_extremes(fx):
    return rounded(sig.contribution_extremes(sig.shift_contributions(fx.target, fx.anchors)))


def replication_sql(src: str) -> str:
    return f"""(SELECT benchmark, x AS replicated, n AS selected, x::DOUBLE / n AS rate, least(1.0, sum({TERM}) FILTER (i >= x)) AS p FROM (
      SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT benchmark, count(*) AS n, count(*) FILTER (sign_replicated) AS x FROM {src} GROUP BY 1
        UNION ALL SELECT 'pooled', count(*), count(*) FILTER (sign_replicated) FROM {src})) GROUP BY benchmark, x, n)"""


@query("replication_summary", f"""SELECT 'effects' AS kind, benchmark, selected, replicated, {rnd('rate', 'p')} FROM {replication_sql('fx_source_ext')}
  UNION ALL SELECT 'shifts', benchmark, selected, replicated, {rnd('rate', 'p')} FROM {replication_sql('fx_contrib_ext')}""")
def replication_summary(fx):
    a, b = replication_tables(fx)
    return rounded(a.withColumn("kind", F.lit("effects")).unionByName(b.withColumn("kind", F.lit("shifts"))))


def replication_tables(fx: Fixture):
    return (sig.replication_summary(sig.source_extremes(sig.source_effects(fx.effects))),
            sig.replication_summary(sig.contribution_extremes(sig.shift_contributions(fx.target, fx.anchors))))


@query("extreme_examples", """SELECT benchmark, family, item_group, direction, item_id, rk::INTEGER AS example_rank, round(d, 6) AS discovery, round(v, 6) AS validation, round(st, 6) AS strength FROM (
  SELECT *, row_number() OVER (PARTITION BY benchmark, family, item_group, direction ORDER BY st DESC, item_id) AS rk FROM (
    SELECT x.benchmark, x.family, x.item_group, x.direction, c.item_id, c.d, c.v, least(CASE WHEN direction = 'advantage' THEN d ELSE -d END, CASE WHEN direction = 'advantage' THEN v ELSE -v END) AS st
    FROM fx_source_ext x JOIN (SELECT benchmark, family, item_group, item_id, max(c) FILTER (half = 'discovery') AS d, max(c) FILTER (half = 'validation') AS v FROM (
      SELECT *, round(effect - avg(effect) OVER (PARTITION BY benchmark, half, family), 9) AS c FROM fx_effects) GROUP BY ALL) c
    ON c.benchmark = x.benchmark AND c.family = x.family AND c.item_group = x.item_group)) WHERE rk <= 2""")
def extreme_examples(fx):
    return rounded(sig.extreme_examples(sig.source_extremes(sig.source_effects(fx.effects)), fx.effects).select(
        "benchmark", "family", "item_group", "direction", "item_id", "example_rank", "discovery", "validation", "strength"), 6)


@query("stability_gates", f"""SELECT 'stability' AS gate, count(*) FILTER (passes_family AND passes_overlap AND passes_agreement) >= 2 AS passes FROM fx_stability
  UNION ALL SELECT 'group_effects', max(rate) FILTER (benchmark = 'pooled') >= 0.7 AND max(p) FILTER (benchmark = 'pooled') <= 0.05 AND count(*) FILTER (benchmark <> 'pooled' AND rate >= 0.65) >= 2 FROM {replication_sql('fx_source_ext')}
  UNION ALL SELECT 'group_shifts', max(rate) FILTER (benchmark = 'pooled') >= 0.7 AND max(p) FILTER (benchmark = 'pooled') <= 0.05 AND count(*) FILTER (benchmark <> 'pooled' AND rate >= 0.65) >= 2 FROM {replication_sql('fx_contrib_ext')}""")
def stability_gates(fx):
    return sig.stability_gates(stability(fx), *replication_tables(fx), needed=2)


