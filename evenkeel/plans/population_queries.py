"""Registered queries: populations, splits, samples, blueprint cells and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blueprint as bp
from ..operators import population as pop
from .fixture import (BOOT_SEED, CAP_SEED, CONTROL_SEED, FOLD, FRACTION, HALF_SEED, REPLICATES, STRATA, Fixture,
                      md5_sql, pick_sql)
from .registry import query, rnd, rounded, shares_sql

# Model names in the style of public checkpoints, derived from customers and nations.
NAME_STEMS = ("Qwen-7B", "llama-13b", "gemma-2b", "Mixtral-8x7B", "phi-2", "llama-mistral-merge", "deepseek-dpo", "gpt-neo")
STEM_LIST = ", ".join(f"'{s}'" for s in NAME_STEMS)
NAMES_SQL = f"""(SELECT c_custkey AS model_id, CASE WHEN c_custkey % 10 = 9 THEN 'Solo-' || c_custkey ELSE
  n_name || '__' || ([{STEM_LIST}])[c_custkey % 8 + 1] || '-' || c_custkey END AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def named_models(fx: Fixture):
    stem = F.element_at(F.array(*[F.lit(s) for s in NAME_STEMS]), (F.col("c_custkey") % 8 + 1).cast("int"))
    key = F.col("c_custkey").cast("string")
    name = F.when(F.col("c_custkey") % 10 == 9, F.concat(F.lit("Solo-"), key)).otherwise(
        F.concat_ws("", F.col("n_name"), F.lit("__"), stem, F.lit("-"), key))
    return fx.table("customer").join(fx.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("model_id"), name.alias("name"))


HIT_SQL = ", ".join(
    f"CASE WHEN regexp_matches(lower(name), '{p}') THEN '{f}' END" for f, p in pop.FAMILY_PATTERNS.items())
CLASSIFIED_SQL = f"""(SELECT model_id, name, CASE WHEN len(h) = 1 THEN h[1] END AS family,
  CASE WHEN len(h) = 1 THEN 'unique_regex_match' WHEN len(h) > 1 THEN 'ambiguous:' || array_to_string(h, ',') ELSE 'unmatched' END AS reason
  FROM (SELECT *, list_filter([{HIT_SQL}], lambda x: x IS NOT NULL) AS h FROM {NAMES_SQL}))"""
OWNER_SQL = "lower(CASE WHEN contains(name, '__') THEN trim(split_part(name, '__', 1)) ELSE name END)"


@query("classify_family", f"SELECT * FROM {CLASSIFIED_SQL}")
def classify_family(fx):
    return pop.classify_family(named_models(fx), "name")


@query("owner_of", f"SELECT {OWNER_SQL} AS owner, count(*) AS models FROM {NAMES_SQL} GROUP BY 1")
def owner_of(fx):
    return named_models(fx).groupBy(pop.owner_of(F.col("name")).alias("owner")).agg(F.count(F.lit(1)).alias("models"))


DEFAULTS_SQL = ", ".join(f"'{f}'" for f in pop.DEFAULT_FAMILIES)


@query("family_candidates", f"""SELECT c.model_id, c.name, c.family, c.reason, {OWNER_SQL} AS owner, {rnd('acc')}
  FROM {CLASSIFIED_SQL} c JOIN (SELECT model_id, acc FROM fx_accuracy) a ON a.model_id = c.model_id
  WHERE c.family IN ({DEFAULTS_SQL})""")
def family_candidates(fx):
    models = pop.classify_family(named_models(fx), "name").withColumn("owner", pop.owner_of(F.col("name")))
    return rounded(pop.family_candidates(models, fx.accuracy.select("model_id", "acc"), pop.DEFAULT_FAMILIES))


@query("owner_cap", f"SELECT model_id, family, owner, {rnd('acc')} FROM fx_capped")
def owner_cap(fx):
    return rounded(fx.capped.select("model_id", "family", "owner", "acc"))


def _split_oracle() -> str:
    """Greedy split as a recursive query: one row per owner, list state per family."""
    return f"""WITH RECURSIVE fam AS (SELECT family, count(*)::DOUBLE AS n, avg(acc) AS mu FROM fx_capped GROUP BY 1),
 par AS (SELECT o.owner, f.family, f.n, f.mu, coalesce(c.n, 0)::DOUBLE AS dn, coalesce(c.a, 0)::DOUBLE AS da
   FROM (SELECT DISTINCT owner FROM fx_capped) o CROSS JOIN fam f LEFT JOIN
     (SELECT owner, family, count(*) AS n, sum(acc) AS a FROM fx_capped GROUP BY ALL) c ON c.owner = o.owner AND c.family = f.family),
 own AS (SELECT owner, list(n ORDER BY family) AS n, list(mu ORDER BY family) AS mu, list(dn ORDER BY family) AS dn,
   list(da ORDER BY family) AS da, ('0x' || substr({md5_sql(CAP_SEED, "'side'", 'owner')}, 1, 8))::BIGINT % 2 AS side,
   row_number() OVER (ORDER BY sum(dn) DESC, {md5_sql(CAP_SEED, "'tie'", 'owner')}, owner) AS k FROM par GROUP BY owner),
 walk AS (
   SELECT 0::BIGINT AS k, NULL::BIGINT AS owner, 0::BIGINT AS side, list_transform((SELECT n FROM own WHERE k = 1), lambda x: 0.0::DOUBLE) AS c,
     list_transform((SELECT n FROM own WHERE k = 1), lambda x: 0.0::DOUBLE) AS a
   UNION ALL
   SELECT k, owner, side,
     list_transform(dn, lambda x, i: c[i] + CASE WHEN side = 0 THEN x ELSE -x END),
     list_transform(da, lambda x, i: a[i] + CASE WHEN side = 0 THEN x ELSE -x END)
   FROM (SELECT o.k, o.owner, o.dn, o.da, w.c, w.a, CASE WHEN cost0 = cost1 THEN o.side WHEN cost1 < cost0 THEN 1 ELSE 0 END AS side
     FROM walk w JOIN own o ON o.k = w.k + 1, LATERAL (SELECT
       round(list_sum(list_transform(o.n, lambda x, i: abs(w.c[i] + o.dn[i]) / x
         + abs(w.a[i] + o.da[i] - (w.c[i] + o.dn[i]) * o.mu[i]) / x)), 12) AS cost0,
       round(list_sum(list_transform(o.n, lambda x, i: abs(w.c[i] - o.dn[i]) / x
         + abs(w.a[i] - o.da[i] - (w.c[i] - o.dn[i]) * o.mu[i]) / x)), 12) AS cost1)))
 SELECT c.model_id, c.owner, CASE WHEN w.side = 0 THEN 'discovery' ELSE 'validation' END AS half
 FROM fx_capped c JOIN walk w ON w.owner = c.owner"""


@query("owner_balanced_split", _split_oracle())
def owner_balanced_split(fx):
    return pop.balanced_owner_split(fx.capped, CAP_SEED).select("model_id", "owner", "half")


@query("split_checks", """
SELECT 'owner_in_both_halves' AS rule, count(*) FILTER (h > 1) AS violations FROM (SELECT owner, count(DISTINCT half) AS h FROM fx_pop GROUP BY 1)
UNION ALL SELECT 'family_missing_in_a_half', count(*) FILTER (least(d, v) = 0) FROM
  (SELECT family, count(*) FILTER (half = 'discovery') AS d, count(*) FILTER (half = 'validation') AS v FROM fx_pop GROUP BY 1)
UNION ALL SELECT 'family_below_minimum', count(*) FILTER (least(d, v) < 2) FROM
  (SELECT family, count(*) FILTER (half = 'discovery') AS d, count(*) FILTER (half = 'validation') AS v FROM fx_pop GROUP BY 1)
UNION ALL SELECT 'nested_split_impossible', count(*) FILTER (o < 2 OR n < 12) FROM
  (SELECT half, count(DISTINCT owner) AS o, count(*) AS n FROM fx_pop GROUP BY 1)""")
def split_checks(fx):
    return pop.split_checks(fx.pop)


@query("representatives_median", f"SELECT model_id, family, owner, half, {rnd('acc')} FROM fx_reps")
def representatives_median(fx):
    return rounded(pop.representatives_median(fx.pop).select("model_id", "family", "owner", "half", "acc"))


@query("representatives_lexicographic", """SELECT m.model_id, m.family, m.owner, h.half FROM
  (SELECT min(model_id) AS model_id, family, owner FROM fx_models GROUP BY family, owner) m JOIN fx_halves h ON h.owner = m.owner""")
def representatives_lexicographic(fx):
    return pop.representatives_lexicographic(fx.models, fx.owner_halves).select("model_id", "family", "owner", "half")


@query("validate_population", """
SELECT 'unknown_model' AS rule, count(*) FILTER (m.model_id IS NULL) AS violations FROM fx_pop p LEFT JOIN fx_models m ON m.model_id = p.model_id
UNION ALL SELECT 'metadata_differs', count(*) FILTER (m.family <> p.family OR m.owner <> p.owner) FROM fx_pop p LEFT JOIN fx_models m ON m.model_id = p.model_id
UNION ALL SELECT 'bad_half', count(*) FILTER (half NOT IN ('discovery', 'validation')) FROM fx_pop
UNION ALL SELECT 'owner_crosses_halves', count(*) FILTER (h > 1) FROM (SELECT count(DISTINCT half) AS h FROM fx_pop GROUP BY owner)
UNION ALL SELECT 'repeated_model', count(*) FILTER (c > 1) FROM (SELECT count(*) AS c FROM fx_pop GROUP BY model_id)""")
def validate_population(fx):
    return pop.validate_population(fx.pop, fx.models)


@query("strict_lineage_filter", f"SELECT model_id, name FROM {NAMES_SQL} WHERE NOT regexp_matches(name, '{pop.LINEAGE_MARKERS}')")
def strict_lineage_filter(fx):
    return pop.strict_lineage_filter(named_models(fx), "name")


def _capped(cap: int, where: str = "true", src: str = "fx_models") -> str:
    return f"""SELECT model_id, family, owner FROM (SELECT *, row_number() OVER (PARTITION BY family, owner
      ORDER BY {md5_sql(CAP_SEED, '0', 'model_id')}, model_id) AS rn FROM {src} WHERE {where}) WHERE rn <= {cap}"""


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("population_variants", "\nUNION ALL ".join([
    *[f"SELECT 'owner_cap_{c}' AS variant, * FROM ({_capped(c)})" for c in (1, 3)],
    f"SELECT 'owner_cap_5_baseline' AS variant, * FROM ({_capped(5)})",
    """SELECT 'lexicographic_checkpoint' AS variant, m.* FROM (SELECT min(model_id) AS model_id, family, owner
       FROM fx_models GROUP BY family, owner) m JOIN fx_halves h ON h.owner = m.owner""",
    f"""SELECT 'strict_lineage' AS variant, * FROM ({_capped(5, 'true', f'''(SELECT m.* FROM fx_models m JOIN {NAMES_SQL} n
       ON n.model_id = m.model_id WHERE NOT regexp_matches(name, '{pop.LINEAGE_MARKERS}'))''')})""",
    *[f"SELECT 'omit_{s.lower()}' AS variant, * FROM ({_capped(5, f"family <> '{s}'")})" for s in SEGMENTS]]))
def population_variants(fx):
    models = fx.models.join(named_models(fx), "model_id")
    return pop.population_variants(models, "name", CAP_SEED, SEGMENTS, fx.owner_halves)


@query("selection_audit", """SELECT a.*, b.representatives, b.discovery_representatives, b.validation_representatives FROM
 (SELECT family, count(*) AS audit_models, count(DISTINCT owner) AS owners, count(*) FILTER (half = 'discovery') AS discovery_audit_models,
   count(*) FILTER (half = 'validation') AS validation_audit_models FROM fx_pop GROUP BY 1) a JOIN
 (SELECT family, count(*) AS representatives, count(*) FILTER (half = 'discovery') AS discovery_representatives,
   count(*) FILTER (half = 'validation') AS validation_representatives FROM fx_reps GROUP BY 1) b ON b.family = a.family""")
def selection_audit(fx):
    return pop.selection_audit(fx.pop, fx.reps)


DOC_ITEMS = "(SELECT doc_id AS item_id, lang FROM documents)"


def doc_items(fx):
    return fx.table("documents").select(F.col("doc_id").alias("item_id"), "lang")


def _ranked(key: str) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {key}, item_id) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM {DOC_ITEMS})"""


@query("stratified_item_split", f"""SELECT r.item_id, r.lang, CASE WHEN rn <= share THEN 'train' ELSE 'test' END AS part
  FROM {_ranked(md5_sql(BOOT_SEED, "'item'", 'item_id'))} r JOIN {shares_sql(DOC_ITEMS, 'lang', 0.7)} s ON s.lang = r.lang""")
def stratified_item_split(fx):
    return pop.stratified_item_split(doc_items(fx), "lang", "item_id", 0.7, BOOT_SEED)


@query("stratified_kfold", f"SELECT item_id, lang, (rn - 1) % 5 AS fold FROM {_ranked(md5_sql(BOOT_SEED, "'fold'", 'item_id'))}")
def stratified_kfold(fx):
    return pop.stratified_kfold(doc_items(fx), "lang", "item_id", 5, BOOT_SEED)


@query("calibration_mask", f"""SELECT item_id, lang, rn <= CASE WHEN n = 1 THEN 1 ELSE greatest(1, least(n - 1, round_even(0.5 * n, 0))) END AS is_calibration
  FROM {_ranked(md5_sql(BOOT_SEED, "'calibration'", 'item_id'))}""")
def calibration_mask(fx):
    return pop.calibration_mask(doc_items(fx), "lang", "item_id", BOOT_SEED)


@query("model_split", f"""SELECT model_id, CASE WHEN rn <= e THEN 'evaluation' ELSE 'population' END AS split, rn > e AND rn <= e + 50 AS tuning
  FROM (SELECT model_id, rn, round_even(0.2 * n, 0) AS e FROM (SELECT model_id, count(*) OVER () AS n,
    row_number() OVER (ORDER BY {md5_sql(BOOT_SEED, "'model'", 'model_id')}, model_id) AS rn FROM fx_models))""")
def model_split(fx):
    return pop.model_split(fx.models.select("model_id"), 0.2, 50, BOOT_SEED)


@query("nested_owner_split", f"""SELECT p.model_id, p.half, p.owner, o.is_validation FROM fx_pop p JOIN (
  SELECT half, owner, rn <= greatest(1, least(n - 1, round_even(0.25 * n, 0))) AS is_validation FROM (
    SELECT half, owner, count(*) OVER (PARTITION BY half) AS n, row_number() OVER (PARTITION BY half ORDER BY
      {md5_sql(HALF_SEED, "'owner'", 'half', 'owner')}, owner) AS rn FROM (SELECT DISTINCT half, owner FROM fx_pop))) o
  ON o.half = p.half AND o.owner = p.owner""")
def nested_owner_split(fx):
    return pop.nested_owner_split(fx.pop, ["half"], HALF_SEED).select("model_id", "half", "owner", "is_validation")


@query("sample_cells", f"""SELECT benchmark, item_id, model_id, y FROM (SELECT *, row_number() OVER (ORDER BY
  {md5_sql(BOOT_SEED, "'cell'", 'item_id', 'model_id')}, item_id, model_id) AS rn FROM fx_all WHERE benchmark = 'N') WHERE rn <= 5000""")
def sample_cells(fx):
    cells = fx.all_responses.filter("benchmark = 'N'").select("benchmark", "item_id", "model_id", "y")
    return pop.sample_cells(cells, 5000, BOOT_SEED)


# --- blueprint ---------------------------------------------------------------

@query("difficulty_cells", f"SELECT benchmark, half, item_id, item_group, {rnd('intercept', 'magnitude')}, cell FROM fx_cells")
def difficulty_cells(fx):
    return rounded(bp.difficulty_cells(fx.itemfit, "intercept", STRATA, FOLD).select(
        *FOLD, "item_id", "item_group", "intercept", "magnitude", "cell"))


@query("anchor_select", f"SELECT benchmark, half, item_id, cell, {rnd('magnitude', 'weight')}, selected FROM fx_anchors")
def anchor_select(fx):
    return rounded(bp.anchor_select(fx.cells, FRACTION, "magnitude", FOLD).select(
        *FOLD, "item_id", "cell", "magnitude", "weight", "selected"))


@query("matched_random_weights", f"SELECT benchmark, half, replicate, item_id, cell, {rnd('weight')} FROM fx_weights")
def matched_random_weights(fx):
    return rounded(bp.matched_random_weights(fx.anchors, REPLICATES, CONTROL_SEED, FOLD))


DISC_CELLS_SQL = """(SELECT *, cell || '|' || (ntile(4) OVER (PARTITION BY benchmark, half, cell ORDER BY magnitude, item_id) - 1) AS disc_cell FROM fx_anchors)"""


@query("discrimination_cells", f"SELECT benchmark, half, item_id, cell, disc_cell FROM {DISC_CELLS_SQL}")
def discrimination_cells(fx):
    return bp.discrimination_cells(fx.anchors, "magnitude", 4, FOLD).select(*FOLD, "item_id", "cell", "disc_cell")


# A spread that crosses the selection, so that strata keep both kinds of items.
DISC2_SQL = """(SELECT *, cell || '|' || (ntile(2) OVER (PARTITION BY benchmark, half, cell ORDER BY intercept, item_id) - 1) AS disc_cell FROM fx_anchors)"""


@query("discrimination_matched_weights", f"""SELECT w.benchmark, w.half, w.replicate, w.item_id, w.cell, round(c.wt, 8) AS weight FROM (
  SELECT d.*, replicate, row_number() OVER (PARTITION BY benchmark, half, replicate, disc_cell ORDER BY
    {md5_sql(CONTROL_SEED, 'benchmark', 'half', 'replicate', 'item_id')}, item_id) AS r
  FROM {DISC2_SQL} d CROSS JOIN (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate)) w
 JOIN (SELECT benchmark, half, cell, disc_cell, count(*) FILTER (selected) AS kk FROM {DISC2_SQL} GROUP BY ALL) f
   ON f.benchmark = w.benchmark AND f.half = w.half AND f.disc_cell = w.disc_cell
 JOIN (SELECT benchmark, half, cell, count(*)::DOUBLE / count(*) FILTER (selected) AS wt FROM fx_anchors GROUP BY ALL) c
   ON c.benchmark = w.benchmark AND c.half = w.half AND c.cell = w.cell WHERE r <= kk""")
def discrimination_matched_weights(fx):
    refined = bp.discrimination_cells(fx.anchors, "intercept", 2, FOLD)
    return rounded(bp.discrimination_matched_weights(refined, REPLICATES, CONTROL_SEED, FOLD))


@query("composition_units", """SELECT item_id, item_group, CASE WHEN (SELECT count(DISTINCT item_group) FROM fx_items) >= 5 THEN item_group::VARCHAR END AS unit,
  'native_source_block' AS strategy FROM fx_items""")
def composition_units(fx):
    return bp.composition_units(fx.items, 20).select("item_id", "item_group", "unit", "strategy")


@query("composition_units_clustered", """SELECT item_id, 'item_cluster_' || lpad((((row_number() OVER (ORDER BY item_id) - 1) * 40) // count(*) OVER ())::VARCHAR, 3, '0') AS unit,
  'contiguous_item_cluster' AS strategy FROM fx_items""")
def composition_units_clustered(fx):
    return bp.composition_units(fx.items, 40, min_groups=9).select("item_id", "unit", "strategy")


@query("high_dif_mask", """SELECT benchmark, half, item_id, cell, row_number() OVER (PARTITION BY benchmark, half, cell ORDER BY magnitude DESC, item_id)
  <= greatest(1, least(n, round_even(0.2 * n, 0))) AS high FROM fx_anchors""")
def high_dif_mask(fx):
    return bp.high_mask(fx.cells, 0.2, "magnitude", [*FOLD, "cell"]).select(*FOLD, "item_id", "cell", "high")


@query("center_within_cells", """SELECT benchmark, half, item_id, cell, round(magnitude - avg(magnitude) OVER (PARTITION BY benchmark, half, cell), 8) AS magnitude FROM fx_cells""")
def center_within_cells(fx):
    return rounded(bp.center_within(fx.cells, [*FOLD, "cell"], ["magnitude"]).select(*FOLD, "item_id", "cell", "magnitude"))


PAIRS_SQL = f"""(SELECT a.benchmark, a.half, a.cell, a.item_id, b.item_id AS control_id FROM
  (SELECT *, row_number() OVER (PARTITION BY benchmark, half, cell ORDER BY {md5_sql(CONTROL_SEED, "'pair'", 'benchmark', 'half', 'item_id')}, item_id) AS pr FROM fx_anchors WHERE selected) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY benchmark, half, cell ORDER BY {md5_sql(CONTROL_SEED, "'pair'", 'benchmark', 'half', 'item_id')}, item_id) AS pr FROM fx_anchors WHERE NOT selected) b
  ON a.benchmark = b.benchmark AND a.half = b.half AND a.cell = b.cell AND a.pr = b.pr)"""
SWAPPED_SQL = f"""(SELECT benchmark, half, replicate, CASE WHEN control_id IS NOT NULL AND coin = 1 THEN control_id ELSE item_id END AS item_id, cell, weight FROM (
  SELECT a.benchmark, a.half, a.item_id, a.cell, a.weight, p.control_id, replicate, {pick_sql(CONTROL_SEED, '2', 'a.benchmark', 'a.half', 'replicate', 'a.item_id')} AS coin
  FROM fx_anchors a LEFT JOIN {PAIRS_SQL} p ON p.benchmark = a.benchmark AND p.half = a.half AND p.item_id = a.item_id
  CROSS JOIN (SELECT unnest(range(1, {REPLICATES + 1})) AS replicate) WHERE a.selected))"""


def swapped(fx, complement: bool = False):
    from ..operators.matching import pair_random

    pairs = pair_random(fx.anchors, CONTROL_SEED, FOLD)
    chosen = fx.anchors.filter("selected").select(*FOLD, "item_id", "cell", "weight")
    return bp.swap_weights(chosen, pairs.select(*FOLD, "item_id", "control_id"), REPLICATES, CONTROL_SEED, complement, FOLD)


@query("swap_weights", f"SELECT benchmark, half, replicate, item_id, cell, {rnd('weight')} FROM {SWAPPED_SQL}")
def swap_weights(fx):
    return rounded(swapped(fx))


@query("weight_invariants", f"""SELECT g.benchmark, g.half, g.replicate, count(*) FILTER (low < 0) AS negative, count(*) FILTER (c <> k) AS cell_count,
  count(*) FILTER (abs(w - n) > 1e-9) AS cell_mass, round(sum(w), 6) AS total_mass, sum(n)::BIGINT AS items FROM
  (SELECT benchmark, half, replicate, cell, count(*) AS c, sum(weight) AS w, min(weight) AS low FROM {SWAPPED_SQL} GROUP BY ALL) g
  JOIN (SELECT DISTINCT benchmark, half, cell, k, n FROM fx_anchors) a ON a.benchmark = g.benchmark AND a.half = g.half AND a.cell = g.cell GROUP BY ALL""")
def weight_invariants(fx):
    return bp.weight_invariants(swapped(fx), fx.anchors, FOLD)


@query("anchor_jaccard", """SELECT benchmark, count(*) FILTER (d AND v) AS shared, count(*) AS "either", round(count(*) FILTER (d AND v) / count(*)::DOUBLE, 8) AS jaccard
  FROM (SELECT benchmark, item_id, bool_or(half = 'discovery') AS d, bool_or(half = 'validation') AS v FROM fx_anchors WHERE selected GROUP BY ALL) GROUP BY 1""")
def anchor_jaccard(fx):
    part = lambda h: fx.anchors.filter(F.col("half") == h)
    return rounded(bp.anchor_jaccard(part("discovery"), part("validation"), ["benchmark"]))
