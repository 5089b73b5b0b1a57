"""Registered queries: paired labels and annotator agreement.

Two annotators label every document: axis values are letter-count parities of
the whole text (annotator_a), and the same with keyed slips (annotator_b).
Languages are the cells, source numbers modulo five the benchmarks.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ..functions.exprs import draw_key, pick
from ..functions.ranks import hash_row_number
from ..operators import annotation as ann
from ..operators import signatures as sig
from ..session import cut, shared_folder, sorted_join
from .fixture import CTES, Fixture, md5_sql, pick_sql
from .registry import query, rnd, rounded

NAMES = ("annotator_a", "annotator_b")
# Label axes of the content protocol.
BINARY = ("quantitative_symbolic", "formal_rule_reasoning", "factual_domain_knowledge", "contextual_reading", "commonsense_narrative",
          "spatial_temporal", "linguistic_wordplay", "negation_exception", "code_structured_representation", "distractor_discrimination")
ORDINAL = ("reasoning_steps", "context_burden", "ambiguity_degree")
FAMILIES = ("gemma", "llama", "mistral", "phi", "qwen")
LETTERS = dict(zip((*BINARY, *ORDINAL), "abcdefghijklm"))
BOOSTED = "quantitative_symbolic"
SEED = 31
PERMUTATIONS = 10_000  # as the reference draws
FAM_LIST = ", ".join(f"'{f}'" for f in FAMILIES)

CTES["fx_panel"] = f"""SELECT doc_id AS blinded_id, benchmark, cell, benchmark || '|' || cell || '|' || ((r - 1) // 2) AS pair_id,
   CASE WHEN r % 2 = 1 THEN 'stable_high_dif' ELSE 'matched_control' END AS grp, disc_family,
   CASE WHEN {pick_sql(33, '10', 'doc_id')} < 7 THEN disc_family ELSE ([{FAM_LIST}])[{pick_sql(34, '5', 'doc_id')} + 1] END AS val_family, text
  FROM (SELECT doc_id, benchmark, cell, text, ([{FAM_LIST}])[{pick_sql(32, '5', 'doc_id')} + 1] AS disc_family,
    row_number() OVER (PARTITION BY benchmark, cell ORDER BY {md5_sql(SEED, "'panel'", 'doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY benchmark, cell) AS n
    FROM (SELECT doc_id, 'B' || (substr(source, 4)::INTEGER % 5) AS benchmark, lang AS cell, text FROM documents)) WHERE r <= 2 * (n // 2)"""


def _axis_sql() -> str:
    rows = []
    for axis, letter in LETTERS.items():
        count = f"(length(text) - length(replace(text, '{letter}', '')))"
        if axis in BINARY:
            v = f"{count} % 2"
            if axis == BOOSTED:
                v = f"CASE WHEN grp = 'stable_high_dif' AND {pick_sql(35, '10', 'blinded_id')} < 6 THEN 1 ELSE {v} END"
            rows.append(f"{{'axis': '{axis}', 'kind': 'binary', 'value': ({v})::INTEGER}}")
        else:
            rows.append(f"{{'axis': '{axis}', 'kind': 'ordinal', 'value': ({count} % 4)::INTEGER}}")
    return ", ".join(rows)


CTES["fx_axes"] = f"SELECT * EXCLUDE (x), x.axis AS axis, x.kind AS kind, x.value AS v FROM (SELECT * EXCLUDE (text), unnest([{_axis_sql()}]) AS x FROM fx_panel)"
CTES["fx_labels"] = f"""SELECT 'annotator_a' AS annotator, * EXCLUDE (v), v AS value FROM fx_axes UNION ALL SELECT 'annotator_b', * EXCLUDE (v),
  CASE WHEN kind = 'binary' THEN CASE WHEN {pick_sql(36, '10', 'axis', 'blinded_id')} = 0 THEN 1 - v ELSE v END
    ELSE CASE WHEN {pick_sql(36, '5', 'axis', 'blinded_id')} = 0 THEN least(3, v + 1) ELSE v END END FROM fx_axes"""


@lru_cache(maxsize=4)
def panel(fx: Fixture):
    docs = fx.table("documents").select(
        "doc_id", F.concat(F.lit("B"), (F.substring("source", 4, 9).cast("int") % 5).cast("string")).alias("benchmark"), F.col("lang").alias("cell"), "text")
    r = hash_row_number(docs, ["benchmark", "cell"], draw_key(SEED, "doc_id", tag="panel"), "doc_id")
    fam = lambda seed: F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (pick(seed, F.lit(5), "doc_id") + 1).cast("int"))
    kept = r.filter(F.col("rn") <= 2 * F.floor(F.col("rn_of") / 2)).withColumn("disc_family", fam(32))
    return cut(kept.select(
        F.col("doc_id").alias("blinded_id"), "benchmark", "cell",
        F.concat_ws("|", "benchmark", "cell", F.floor((F.col("rn") - 1) / 2).cast("string")).alias("pair_id"),
        F.when(F.col("rn") % 2 == 1, ann.GROUPS[0]).otherwise(ann.GROUPS[1]).alias("grp"), "disc_family",
        F.when(pick(33, F.lit(10), "doc_id") < 7, F.col("disc_family")).otherwise(fam(34)).alias("val_family"), "text"))


def _axis(axis: str):
    count = F.length("text") - F.length(F.replace("text", F.lit(LETTERS[axis]), F.lit("")))
    v = count % 2 if axis in BINARY else count % 4
    if axis == BOOSTED:
        v = F.when((F.col("grp") == ann.GROUPS[0]) & (pick(35, F.lit(10), "blinded_id") < 6), 1).otherwise(v)
    return F.struct(F.lit(axis).alias("axis"), F.lit("binary" if axis in BINARY else "ordinal").alias("kind"), v.cast("int").alias("v"))


@lru_cache(maxsize=4)
def labels(fx: Fixture):
    long = panel(fx).withColumn("x", F.explode(F.array(*[_axis(a) for a in LETTERS]))).drop("text").select("*", "x.*").drop("x")
    v = F.col("v")
    slip = F.when(F.col("kind") == "binary", F.when(pick(36, F.lit(10), "axis", "blinded_id") == 0, 1 - v).otherwise(v)).otherwise(
        F.when(pick(36, F.lit(5), "axis", "blinded_id") == 0, F.least(F.lit(3), v + 1)).otherwise(v))
    two = F.explode(F.array(F.struct(F.lit(NAMES[0]).alias("annotator"), v.alias("value")), F.struct(F.lit(NAMES[1]).alias("annotator"), slip.alias("value"))))
    return cut(long.withColumn("_t", two).select("*", "_t.*").drop("_t", "v"))


@query("label_panel_check", """SELECT p.annotator, items, repeated_ids, bad_group, pair_size, pair_groups, pair_crosses_cells, 0::BIGINT AS not_by_both FROM (
  SELECT annotator, count(*) FILTER (n <> 2) AS pair_size, count(*) FILTER (g <> 2) AS pair_groups, count(*) FILTER (c <> 1) AS pair_crosses_cells FROM (
    SELECT annotator, benchmark, pair_id, count(*) AS n, count(DISTINCT grp) AS g, count(DISTINCT cell) AS c FROM fx_labels WHERE axis = 'reasoning_steps' GROUP BY ALL) GROUP BY 1) p
  JOIN (SELECT annotator, count(*) AS items, count(*) - count(DISTINCT blinded_id) AS repeated_ids, count(*) FILTER (grp NOT IN ('stable_high_dif', 'matched_control')) AS bad_group
    FROM fx_labels WHERE axis = 'reasoning_steps' GROUP BY 1) q ON q.annotator = p.annotator""")
def label_panel_check(fx):
    return ann.panel_violations(labels(fx).filter("axis = 'reasoning_steps'"))


@query("pair_sample", f"""WITH m AS (SELECT * FROM fx_marks),
 a AS (SELECT benchmark, cell, item_id AS high_id, row_number() OVER (PARTITION BY benchmark, cell ORDER BY {md5_sql(SEED, "'high'", 'benchmark', 'item_id')}, item_id) AS r FROM m WHERE hd AND hv),
 b AS (SELECT benchmark, cell, item_id AS control_id, row_number() OVER (PARTITION BY benchmark, cell ORDER BY {md5_sql(SEED, "'control'", 'benchmark', 'item_id')}, item_id) AS r FROM m WHERE NOT hd AND NOT hv)
 SELECT benchmark, cell, pair, high_id, control_id FROM (SELECT a.benchmark, a.cell, high_id, control_id, row_number() OVER (PARTITION BY a.benchmark ORDER BY {md5_sql(SEED, "'sample'", 'a.benchmark', 'high_id')}, high_id) AS pair
   FROM a JOIN b ON a.benchmark = b.benchmark AND a.cell = b.cell AND a.r = b.r) WHERE pair <= 10""")
def pair_sample(fx):
    marks, _ = sig._tables(fx.itemfit, fx.effects, ["benchmark"])
    return ann.pair_sample(cut(marks.select("benchmark", "item_id", "cell", "hd", "hv")), 10, SEED)


@query("blind_packets", f"""SELECT 'item_' || CASE WHEN r - 1 < 1000 THEN lpad((r - 1)::VARCHAR, 4, '0') ELSE (r - 1)::VARCHAR END AS blinded_id, sha256(text) AS digest FROM (
  SELECT text, row_number() OVER (ORDER BY {md5_sql(SEED, "'blind'", 'blinded_id')}, blinded_id) AS r FROM fx_panel)""")
def blind_packets(fx):
    blinded = ann.blind(panel(fx).withColumnRenamed("blinded_id", "item_id"), "item_id", SEED)
    return blinded.select("blinded_id", F.sha2("text", 256).alias("digest"))


def payloads(fx: Fixture):
    """JSON batches of 20 items per annotator; every 17th record (by hash) carries a bad value."""
    r = hash_row_number(panel(fx).select("blinded_id").withColumn("_h", F.lit(0)), ["_h"], draw_key(SEED, "blinded_id", tag="batch"), "blinded_id")
    batch = r.select("blinded_id", F.floor((F.col("rn") - 1) / 20).alias("batch"))
    value = F.when(pick(38, F.lit(17), "annotator", "axis", "blinded_id") == 0, 7).otherwise(F.col("value")).cast("int")
    rows = labels(fx).join(sorted_join(batch), "blinded_id").select("annotator", "batch", "blinded_id", "axis", value.alias("value"))
    record = F.struct("blinded_id", "axis", "value")
    return rows.groupBy("annotator", "batch").agg(F.to_json(F.struct(F.collect_list(record).alias("annotations"))).alias("payload")), batch


@query("payload_validate", f"""WITH b AS (SELECT blinded_id, (row_number() OVER (ORDER BY {md5_sql(SEED, "'batch'", 'blinded_id')}, blinded_id) - 1) // 20 AS batch FROM fx_panel)
 SELECT annotator, batch, count(*) AS expected, 0::BIGINT AS missing, 0::BIGINT AS "foreign", 0::BIGINT AS repeated,
  count(*) FILTER ({pick_sql(38, '17', 'annotator', 'axis', 'blinded_id')} = 0) AS bad_values FROM fx_labels JOIN b USING (blinded_id) GROUP BY ALL""")
def payload_validate(fx):
    batches, batch = payloads(fx)
    out = None
    expected = labels(fx).select("annotator", "blinded_id", "axis").join(sorted_join(batch), "blinded_id")
    for name in NAMES:
        one = lambda t: t.filter(F.col("annotator") == name).drop("annotator")
        part = ann.payload_violations(one(batches), one(expected), BINARY, ORDINAL).withColumn("annotator", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("merge_annotations", f"""SELECT annotator, benchmark, grp, count(*) AS records, sum(CASE WHEN {pick_sql(38, '17', 'annotator', 'axis', 'blinded_id')} = 0 THEN 7 ELSE value END)::BIGINT AS total
  FROM fx_labels GROUP BY ALL""")
def merge_annotations(fx):
    """Batches written as JSON text, read back, exploded and joined with the blinding key."""
    import uuid

    path = f"{shared_folder(fx.spark)}/payloads-{uuid.uuid4().hex}"
    payloads(fx)[0].write.json(path)
    batches = fx.spark.read.schema("annotator string, batch bigint, payload string").json(path)
    merged = ann.merge_annotations(batches, panel(fx).drop("text"))
    return merged.groupBy("annotator", "benchmark", "grp").agg(F.count(F.lit(1)).alias("records"), F.sum("value").cast("bigint").alias("total"))


CTES["fx_two"] = """SELECT a.axis, a.kind, a.blinded_id, a.value AS a, b.value AS b FROM fx_labels a JOIN fx_labels b ON b.axis = a.axis AND b.blinded_id = a.blinded_id
  AND b.annotator = 'annotator_b' WHERE a.annotator = 'annotator_a'"""
CTES["fx_kappa"] = """SELECT axis, CASE WHEN abs(pe - 1) > 1e-8 THEN (po - pe) / (1 - pe) END AS cohen_kappa, po AS raw_agreement, pa AS annotator_a_prevalence, pb AS annotator_b_prevalence FROM (
  SELECT axis, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM fx_two WHERE kind = 'binary' GROUP BY 1)"""
CTES["fx_rho"] = """SELECT axis, avg((a = b)::INT) AS exact_agreement, avg(abs(a - b)) AS mean_absolute_difference, corr(ra, rb) AS spearman_r FROM (
  SELECT *, rank() OVER (PARTITION BY axis ORDER BY a) + (count(*) OVER (PARTITION BY axis, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY axis ORDER BY b) + (count(*) OVER (PARTITION BY axis, b) - 1) / 2.0 AS rb
  FROM fx_two WHERE kind = 'ordinal') GROUP BY 1"""


@query("cohen_kappa", f"SELECT axis, {rnd('cohen_kappa')} FROM fx_kappa")
def cohen_kappa(fx):
    return rounded(ann.kappa_table(labels(fx), NAMES))


@query("annotator_reliability", f"""SELECT axis, 'binary' AS kind, {rnd('raw_agreement')}, {rnd('cohen_kappa')}, {rnd('annotator_a_prevalence', 'annotator_b_prevalence')}, NULL::DOUBLE AS spearman_r, NULL::DOUBLE AS mean_absolute_difference FROM fx_kappa
  UNION ALL SELECT axis, 'ordinal', round(exact_agreement, 8), NULL, NULL, NULL, round(spearman_r, 8), round(mean_absolute_difference, 8) FROM fx_rho""")
def annotator_reliability(fx):
    binary, ordinal = ann.reliability(labels(fx), NAMES)
    b = binary.withColumn("kind", F.lit("binary"))
    o = ordinal.withColumnRenamed("exact_agreement", "raw_agreement").withColumn("kind", F.lit("ordinal"))
    return rounded(b.unionByName(o, allowMissingColumns=True))


CTES["fx_pairs"] = """SELECT annotator, axis, kind, benchmark, pair_id, max(value) FILTER (grp = 'stable_high_dif') AS high, max(value) FILTER (grp = 'matched_control') AS control
  FROM fx_labels GROUP BY ALL"""


def bh_sql(p: str, by: str = "annotator", key: str = "axis") -> str:
    return f"""least(1.0, min({p} * n / rn) OVER (PARTITION BY {by} ORDER BY {p}, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


TERM = "exp(lgamma(d + 1) - lgamma(i + 1) - lgamma(d - i + 1) + d * ln(0.5))"
CTES["fx_binary"] = f"""SELECT *, {bh_sql('mcnemar_exact_p')} AS bh_q FROM (SELECT *, row_number() OVER (PARTITION BY annotator ORDER BY mcnemar_exact_p, axis) AS rn, count(*) OVER (PARTITION BY annotator) AS n FROM (
  SELECT b.annotator, b.axis, h AS stable_high_rate, c AS matched_control_rate, up AS discordant_high_only, down AS discordant_control_only, h - c AS paired_difference, s.same AS benchmarks_same_direction,
    CASE WHEN up + down = 0 THEN 1.0 ELSE (SELECT round(least(1.0, sum({TERM})), 12) FROM (SELECT unnest(range(0, up + down + 1)) AS i, up + down AS d) WHERE abs(i - d / 2.0) >= abs(least(up, down) - d / 2.0)) END AS mcnemar_exact_p
  FROM (SELECT annotator, axis, avg(high) AS h, avg(control) AS c, count(*) FILTER (high = 1 AND control = 0) AS up, count(*) FILTER (high = 0 AND control = 1) AS down, sign(sum(high) - sum(control)) AS dir
    FROM fx_pairs WHERE kind = 'binary' GROUP BY ALL) b
  JOIN (SELECT x.annotator, x.axis, count(*) FILTER (x.s = y.s) AS same FROM (SELECT annotator, axis, benchmark, sign(sum(high) - sum(control)) AS s FROM fx_pairs WHERE kind = 'binary' GROUP BY ALL) x
    JOIN (SELECT annotator, axis, sign(sum(high) - sum(control)) AS s FROM fx_pairs WHERE kind = 'binary' GROUP BY ALL) y ON y.annotator = x.annotator AND y.axis = x.axis GROUP BY ALL) s
  ON s.annotator = b.annotator AND s.axis = b.axis))"""


@query("paired_binary", f"""SELECT annotator, axis, discordant_high_only, discordant_control_only, benchmarks_same_direction,
  {rnd('stable_high_rate', 'matched_control_rate', 'paired_difference', 'mcnemar_exact_p', 'bh_q')} FROM fx_binary""")
def paired_binary(fx):
    return rounded(binary_table(fx))


@lru_cache(maxsize=4)
def binary_table(fx: Fixture):
    return cut(ann.paired_binary(labels(fx)))


NORMAL_SQL = """(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))) * exp(-x * x)"""


@query("paired_ordinal", f"""WITH d AS (SELECT annotator, axis, high, control, (high - control)::DOUBLE AS d FROM fx_pairs WHERE kind = 'ordinal'), nz AS (SELECT * FROM d WHERE d <> 0),
 r AS (SELECT annotator, axis, d, rank() OVER (PARTITION BY annotator, axis ORDER BY abs(d)) + (count(*) OVER (PARTITION BY annotator, axis, abs(d)) - 1) / 2.0 AS r FROM nz),
 s AS (SELECT annotator, axis, count(*)::DOUBLE AS n, coalesce(sum(r) FILTER (d > 0), 0) AS up FROM r GROUP BY ALL),
 g AS (SELECT annotator, axis, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT annotator, axis, abs(d), count(*) AS c FROM nz GROUP BY ALL) GROUP BY ALL),
 z AS (SELECT s.annotator, s.axis, abs((up - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)) / sqrt(2.0) AS x FROM s JOIN g ON g.annotator = s.annotator AND g.axis = s.axis),
 p AS (SELECT b.*, coalesce(round({NORMAL_SQL}, 12), 1.0) AS wilcoxon_p FROM (SELECT annotator, axis, avg(high) AS stable_high_mean, avg(control) AS matched_control_mean, avg(d) AS paired_mean_difference FROM d GROUP BY ALL) b
   LEFT JOIN (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM z) z ON z.annotator = b.annotator AND z.axis = b.axis)
 SELECT annotator, axis, {rnd('stable_high_mean', 'matched_control_mean', 'paired_mean_difference', 'wilcoxon_p')}, round({bh_sql('wilcoxon_p')}, 8) AS bh_q FROM (
   SELECT *, row_number() OVER (PARTITION BY annotator ORDER BY wilcoxon_p, axis) AS rn, count(*) OVER (PARTITION BY annotator) AS n FROM p)""")
def paired_ordinal(fx):
    return rounded(ann.paired_ordinal(labels(fx)))


CTES["fx_stable"] = """SELECT annotator, axis, benchmark, blinded_id, disc_family AS family, value FROM fx_labels WHERE kind = 'binary' AND grp = 'stable_high_dif' AND disc_family = val_family"""
CTES["fx_pi"] = "SELECT annotator, axis, benchmark, avg(value) AS pi FROM fx_stable GROUP BY ALL"
CTES["fx_assoc"] = """SELECT annotator, axis, sum(CASE WHEN pi > 0 AND pi < 1 THEN (o - n * pi) * (o - n * pi) / (n * pi * (1 - pi)) ELSE 0 END) AS statistic FROM (
  SELECT annotator, axis, benchmark, family, sum(value) AS o, count(*) AS n FROM fx_stable GROUP BY ALL) JOIN fx_pi USING (annotator, axis, benchmark) GROUP BY ALL"""
CTES["fx_prev"] = """SELECT annotator, axis, family, sum(n)::BIGINT AS n_items, sum(s)::DOUBLE / sum(n) AS raw_prevalence, avg(r) AS standardized_prevalence FROM (
  SELECT annotator, axis, family, benchmark, avg(value) AS r, sum(value) AS s, count(*) AS n FROM fx_stable GROUP BY ALL) GROUP BY ALL"""


@query("conditional_association", f"SELECT annotator, axis, {rnd('statistic')} FROM fx_assoc")
def conditional_association(fx):
    return rounded(ann.conditional_association(labels(fx)))


@query("family_direction_prevalence", f"SELECT annotator, axis, family, n_items, {rnd('raw_prevalence', 'standardized_prevalence')} FROM fx_prev")
def family_direction_prevalence(fx):
    return rounded(ann.prevalence(labels(fx)))


CTES["fx_direction"] = f"""WITH it AS (SELECT DISTINCT annotator, benchmark, blinded_id, family FROM fx_stable),
 home AS (SELECT *, row_number() OVER (PARTITION BY annotator, benchmark ORDER BY {md5_sql(SEED, "'home'", 'annotator', 'benchmark', 'blinded_id')}, blinded_id) AS k FROM it),
 moved AS (SELECT annotator, benchmark, replicate, blinded_id, row_number() OVER (PARTITION BY annotator, benchmark, replicate ORDER BY {md5_sql(SEED, 'annotator', 'benchmark', 'replicate', 'blinded_id')}, blinded_id) AS k
   FROM (SELECT *, unnest(range(1, {PERMUTATIONS + 1})) AS replicate FROM it)),
 nul AS (SELECT annotator, axis, replicate, sum(CASE WHEN pi > 0 AND pi < 1 THEN (o - n * pi) * (o - n * pi) / (n * pi * (1 - pi)) ELSE 0 END) AS ns FROM (
   SELECT m.annotator, s.axis, m.replicate, m.benchmark, h.family, sum(s.value) AS o, count(*) AS n FROM moved m JOIN home h ON h.annotator = m.annotator AND h.benchmark = m.benchmark AND h.k = m.k
   JOIN fx_stable s ON s.annotator = m.annotator AND s.benchmark = m.benchmark AND s.blinded_id = m.blinded_id GROUP BY ALL) JOIN fx_pi USING (annotator, axis, benchmark) GROUP BY ALL),
 p AS (SELECT n.annotator, n.axis, any_value(statistic) AS statistic, round((1 + count(*) FILTER (round(ns, 9) >= round(statistic, 9)))::DOUBLE / (1 + count(*)), 12) AS permutation_p
   FROM nul n JOIN fx_assoc a ON a.annotator = n.annotator AND a.axis = n.axis GROUP BY n.annotator, n.axis),
 e AS (SELECT annotator, axis, (list(family ORDER BY round(standardized_prevalence, 12) DESC, family))[1] AS maximum_family, (list(family ORDER BY round(standardized_prevalence, 12), family))[1] AS minimum_family,
   max(standardized_prevalence) - min(standardized_prevalence) AS prevalence_range, sum(n_items)::BIGINT AS n_items FROM fx_prev GROUP BY ALL),
 q AS (SELECT *, {bh_sql('permutation_p')} AS bh_q FROM (SELECT p.*, maximum_family, minimum_family, prevalence_range, n_items, row_number() OVER (PARTITION BY p.annotator ORDER BY permutation_p, p.axis) AS rn,
   count(*) OVER (PARTITION BY p.annotator) AS n FROM p JOIN e ON e.annotator = p.annotator AND e.axis = p.axis))
 SELECT annotator, axis, n_items, statistic, permutation_p, maximum_family, minimum_family, prevalence_range, bh_q, (count(*) OVER (PARTITION BY axis) = 2 AND max(bh_q) OVER (PARTITION BY axis) <= 0.05) AS dual_annotator_signal FROM q"""


@query("family_direction", f"""SELECT annotator, axis, n_items, maximum_family, minimum_family, dual_annotator_signal, {rnd('statistic', 'permutation_p', 'prevalence_range', 'bh_q')} FROM fx_direction""")
def family_direction(fx):
    return rounded(direction_table(fx))


@lru_cache(maxsize=4)
def direction_table(fx: Fixture):
    return cut(ann.family_direction(labels(fx), PERMUTATIONS, SEED))


CTES["fx_confirm"] = """SELECT axis, count(*) AS annotators, count(*) FILTER (ok) AS qualifying, count(*) = 2 AND count(*) FILTER (ok) = 2 AND min(s) = max(s) AND min(s) <> 0 AS replicated FROM (
  SELECT *, sign(round(paired_difference, 12)) AS s, bh_q <= 0.05 AND abs(round(paired_difference, 12)) >= 0.08 AND benchmarks_same_direction >= 3 AS ok FROM fx_binary) GROUP BY 1"""


@query("confirmatory_axes", "SELECT * FROM fx_confirm")
def confirmatory_axes(fx):
    return ann.confirmatory_axes(binary_table(fx))


@query("reliability_gate", """SELECT round(k, 8) AS median_kappa, round(r, 8) AS median_rho, k >= 0.45 AND r >= 0.5 AS passes FROM (SELECT (SELECT median(cohen_kappa) FROM fx_kappa) AS k, (SELECT median(spearman_r) FROM fx_rho) AS r)""")
def reliability_gate(fx):
    return rounded(ann.reliability_gate(*ann.reliability(labels(fx), NAMES)))


@query("content_replay", """SELECT 'annotation_rows' AS metric, (SELECT count(*) FROM fx_labels WHERE axis = 'reasoning_steps')::DOUBLE AS value UNION ALL SELECT 'unique_items', (SELECT count(DISTINCT blinded_id) FROM fx_labels)
  UNION ALL SELECT 'matched_pairs', (SELECT count(*) FROM (SELECT DISTINCT benchmark, pair_id FROM fx_labels)) UNION ALL SELECT 'median_kappa', (SELECT round(median(cohen_kappa), 8) FROM fx_kappa)
  UNION ALL SELECT 'median_rho', (SELECT round(median(spearman_r), 8) FROM fx_rho) UNION ALL SELECT 'replicated_axes', (SELECT count(*) FILTER (replicated) FROM fx_confirm)
  UNION ALL SELECT 'dual_signal_axes', (SELECT count(DISTINCT axis) FILTER (dual_annotator_signal) FROM fx_direction)""")
def content_replay(fx):
    """All tables from the label table, reduced to the replay summary."""
    rows = labels(fx)
    binary, ordinal = ann.reliability(rows, NAMES)
    parts = {
        "annotation_rows": rows.filter("axis = 'reasoning_steps'").agg(F.count(F.lit(1))),
        "unique_items": rows.agg(F.countDistinct("blinded_id")), "matched_pairs": rows.agg(F.countDistinct("benchmark", "pair_id")),
        "median_kappa": binary.agg(F.round(F.percentile("cohen_kappa", 0.5), 8)), "median_rho": ordinal.agg(F.round(F.percentile("spearman_r", 0.5), 8)),
        "replicated_axes": ann.confirmatory_axes(binary_table(fx)).agg(F.count_if("replicated")),
        "dual_signal_axes": direction_table(fx).agg(F.countDistinct(F.when(F.col("dual_annotator_signal"), F.col("axis"))))}
    out = None
    for name, t in parts.items():
        part = t.toDF("v").select(F.lit(name).alias("metric"), F.col("v").cast("double").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


@query("annotation_audit", """SELECT annotator, count(*) AS rows, count(DISTINCT blinded_id) AS items, 0::BIGINT AS missing_keys, count(DISTINCT blinded_id) = (SELECT count(*) FROM fx_panel) AS covered, 0::BIGINT AS pair_cell_mismatches
  FROM fx_labels GROUP BY 1""")
def annotation_audit(fx):
    return ann.annotation_audit(labels(fx), panel(fx))


@query("direction_counts", "SELECT family, count(*) AS items FROM (SELECT DISTINCT benchmark, blinded_id, family FROM fx_stable) GROUP BY 1")
def direction_counts(fx):
    return ann.direction_counts(labels(fx))
