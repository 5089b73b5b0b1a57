"""Item-by-model outcomes derived from the given tables, in Spark and as SQL text.

Customers play the models, market segments the families, nations the owners,
part buckets the items and return flags the benchmarks. An outcome is 1 when
the customer bought a part of that bucket in an order line with that flag.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import draw_key
from ..functions.ranks import hash_row_number
from ..operators import blueprint, population, resampling, scoring
from ..session import cut, sorted_join

BENCHMARKS = ("A", "N", "R")
N_ITEMS = 200
N_WORDS = (N_ITEMS + 63) // 64
N_GROUPS = 8
STRATA = 4
FRACTION = 0.5
GAP = 0.01
GAPS = (0.0025, 0.005, 0.01, 0.02)
REPLICATES = 20
PART_ROWS = 250_000
CAP_SEED, HALF_SEED, CONTROL_SEED, BOOT_SEED, OWNER_SEED = 7, 11, 13, 17, 19
FOLD = ("benchmark", "half")


class Fixture:
    """Shared input tables of the registered queries for one data folder.

    Small derived tables are cut to the shared folder once and reused.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def models(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("model_id"), F.col("c_mktsegment").alias("family"),
            F.col("c_nationkey").cast("bigint").alias("owner"))

    @cached_property
    def items(self) -> DataFrame:
        item = F.col("p_partkey") % N_ITEMS
        return self.table("part").select(item.alias("item_id"), (item % N_GROUPS).alias("item_group")).distinct()

    @cached_property
    def bought(self) -> DataFrame:
        """(benchmark, model, item) of every line.

        Lines are dealt into parts of bounded size, so that what a task sorts does not grow with the table.
        """
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
        parts = max(self.spark.sparkContext.defaultParallelism, lines.count() // PART_ROWS + 1)
        lines = lines.repartition(parts, "l_orderkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return lines.join(sorted_join(orders), F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("l_returnflag").alias("benchmark"), F.col("o_custkey").alias("model_id"),
            (F.col("l_partkey") % N_ITEMS).alias("item_id"))

    @cached_property
    def hits(self) -> DataFrame:
        """Distinct (benchmark, model, item) successes."""
        return self.bought.distinct()

    @cached_property
    def hit_bits(self) -> DataFrame:
        """The successes of a model in a benchmark as one row: a bit for each item in `words`, and their number.

        Remainders of negative parts and unknown parts are no items, but count as distinct successes.
        """
        item = F.col("item_id")
        size = F.abs(item)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), size.bitwiseAND(63).cast("int"))
        masks = [F.bit_or(F.when((F.shiftright(size, 6) == k) & (item < 0 if below else item >= 0), bit)) for below in (False, True) for k in range(N_WORDS)]
        held = self.bought.groupBy("model_id", "benchmark").agg(
            *[F.coalesce(m, F.lit(0).cast("bigint")).alias(f"w{k}") for k, m in enumerate(masks)], F.max(item.isNull().cast("int")).alias("_none"))
        counts = [F.bit_count(f"w{k}") for k in range(len(masks))]
        return cut(held.select("model_id", "benchmark", F.array(*[f"w{k}" for k in range(N_WORDS)]).alias("words"),
                               sum(counts, F.col("_none")).cast("bigint").alias("s")))

    def dense(self, models: DataFrame) -> DataFrame:
        """Complete 0/1 matrix of `models`: the success sets are bounded by the item list."""
        grid = models.withColumn("benchmark", F.explode(F.array(*[F.lit(b) for b in BENCHMARKS])))
        cells = grid.join(sorted_join(self.hit_bits.select("model_id", "benchmark", "words")), ["model_id", "benchmark"], "left").withColumn(
            "item_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(N_ITEMS - 1).cast("bigint"))))
        word = F.get("words", F.shiftright("item_id", 6).cast("int"))
        y = F.coalesce(F.call_function("shiftright", word, F.col("item_id").bitwiseAND(63).cast("int")).bitwiseAND(1), F.lit(0)).cast("int")
        return cells.withColumn("y", y).withColumn("item_group", F.col("item_id") % N_GROUPS).drop("words")

    @cached_property
    def all_responses(self) -> DataFrame:
        return self.dense(self.models)

    @cached_property
    def accuracy(self) -> DataFrame:
        s = self.hit_bits.groupBy("model_id").agg(F.sum("s").alias("s"))
        return self.models.join(s, "model_id", "left").withColumn(
            "acc", F.round(F.coalesce("s", F.lit(0)) / float(N_ITEMS * len(BENCHMARKS)), 12)).drop("s")

    @cached_property
    def capped(self) -> DataFrame:
        return population.owner_cap(self.accuracy, 5, CAP_SEED)

    @cached_property
    def owner_halves(self) -> DataFrame:
        owners = self.models.select("owner").distinct().withColumn("_h", F.lit(0))
        r = hash_row_number(owners, ["_h"], draw_key(HALF_SEED, "owner", tag="half"), "owner")
        return r.select("owner", F.when(F.col("rn") % 2 == 1, "discovery").otherwise("validation").alias("half"))

    @cached_property
    def pop(self) -> DataFrame:
        return cut(self.capped.join(self.owner_halves, "owner"))

    @cached_property
    def reps(self) -> DataFrame:
        return cut(population.representatives_median(self.pop))

    @cached_property
    def resp(self) -> DataFrame:
        """Outcomes of the capped population with model and item attributes."""
        return cut(self.dense(self.pop.drop("acc")))

    @cached_property
    def rates(self) -> DataFrame:
        return cut(self.resp.groupBy(*FOLD, "item_id", "item_group", "family").agg(
            F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("s"), F.avg("y").alias("rate")))

    @cached_property
    def effects(self) -> DataFrame:
        """Family success rate minus the item's mean over families: a sum-zero effect."""
        mean = self.rates.groupBy(*FOLD, "item_id").agg(F.avg("rate").alias("_m"))
        return cut(self.rates.join(mean, [*FOLD, "item_id"]).select(
            *FOLD, "item_id", "item_group", "family", F.round(F.col("rate") - F.col("_m"), 12).alias("effect")))

    @cached_property
    def itemfit(self) -> DataFrame:
        ease = self.rates.groupBy(*FOLD, "item_id", "item_group").agg(
            F.round(F.sum("s") / F.sum("n"), 12).alias("intercept"))
        mag = self.effects.groupBy(*FOLD, "item_id").agg(
            F.round(F.max("effect") - F.min("effect"), 12).alias("magnitude"))
        return cut(ease.join(mag, [*FOLD, "item_id"]))

    @cached_property
    def cells(self) -> DataFrame:
        return cut(blueprint.difficulty_cells(self.itemfit, "intercept", STRATA, FOLD))

    @cached_property
    def anchors(self) -> DataFrame:
        return cut(blueprint.anchor_select(self.cells, FRACTION, "magnitude", FOLD))

    @cached_property
    def target(self) -> DataFrame:
        """Outcomes of the representatives, keyed by the audit half (the opposite of their own)."""
        other = F.when(F.col("half") == "discovery", "validation").otherwise("discovery")
        return cut(self.resp.join(self.reps.select("model_id"), "model_id", "left_semi").withColumn("half", other))

    @cached_property
    def scored(self) -> DataFrame:
        full = self.target.groupBy(*FOLD, "model_id", "family", "owner").agg(
            F.round(F.avg("y"), 12).alias("full_score"))
        low = scoring.weighted_accuracy(self.target, self.anchors, FOLD).withColumnRenamed("score", "low_score")
        return cut(full.join(low, [*FOLD, "model_id"]))

    @cached_property
    def shifts(self) -> DataFrame:
        return scoring.score_shift_table(self.scored, FOLD)

    @cached_property
    def control_scores(self) -> DataFrame:
        return cut(resampling.control_scores(self.target, self.anchors, self.scored, REPLICATES, CONTROL_SEED, FOLD))

    @cached_property
    def controls(self) -> DataFrame:
        return cut(resampling.control_metrics(self.control_scores, FOLD, GAP))

    @cached_property
    def aggregates(self) -> DataFrame:
        units = self.items.select("item_id", F.col("item_group").cast("string").alias("unit"))
        return cut(scoring.source_aggregates(self.target, units, self.anchors, FOLD))


_FIXTURES: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, folder: str) -> Fixture:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixture(spark, folder)
    return _FIXTURES[key]


def forget() -> None:
    """Drop the shared tables, so that the next query starts from the given files."""
    _FIXTURES.clear()


def md5_sql(seed: int, *parts: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(parts)}))"


def pick_sql(seed: int, n: str, *parts: str) -> str:
    return f"(('0x' || substr({md5_sql(seed, *parts)}, 1, 8))::BIGINT % {n})"


PAIR_COUNTS_SQL = """
SELECT {by},
  count(*) FILTER (ok) AS all_pairs, count(*) FILTER (ok AND flip) AS all_flips,
  count(*) FILTER (ok AND cross_f) AS cross_family_pairs, count(*) FILTER (ok AND cross_f AND flip) AS cross_family_flips,
  count(*) FILTER (ok AND cross_f AND near) AS close_cross_family_pairs,
  count(*) FILTER (ok AND cross_f AND near AND flip) AS close_cross_family_flips,
  count(*) FILTER (ok AND NOT cross_f AND near) AS close_same_family_pairs,
  count(*) FILTER (ok AND NOT cross_f AND near AND flip) AS close_same_family_flips,
  (count(*) FILTER (dx*dy > 0) - count(*) FILTER (dx*dy < 0))::DOUBLE
    / nullif(sqrt((count(*) FILTER (dx <> 0))::DOUBLE * (count(*) FILTER (dy <> 0))::DOUBLE), 0) AS kendall_tau_b
FROM (SELECT {by_a}, a.family <> b.family AS cross_f, sign(round(a.full_score - b.full_score, 12)) AS dx,
        sign(round(a.low_score - b.low_score, 12)) AS dy,
        a.owner <> b.owner AND round(a.full_score - b.full_score, 12) <> 0 AND round(a.low_score - b.low_score, 12) <> 0 AS ok,
        sign(round(a.full_score - b.full_score, 12)) * sign(round(a.low_score - b.low_score, 12)) < 0 AS flip,
        round(abs(a.full_score - b.full_score), 12) <= {gap} AS near
      FROM {src} a JOIN {src} b ON {on} AND a.model_id < b.model_id)
GROUP BY {by}"""


def pair_counts_sql(src: str, by: tuple[str, ...], gap: float = GAP) -> str:
    return PAIR_COUNTS_SQL.format(
        by=", ".join(by), by_a=", ".join(f"a.{c}" for c in by), src=src, gap=gap,
        on=" AND ".join(f"a.{c} = b.{c}" for c in by))


def percentile_sql(src: str, by: str, value: str, name: str) -> str:
    return f"""CASE WHEN count(*) OVER (PARTITION BY {by}) = 1 THEN 0.5 ELSE
 (rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0 - 1)
 / (count(*) OVER (PARTITION BY {by}) - 1) END AS {name}"""


CTES: dict[str, str] = {
    "fx_models": "SELECT c_custkey AS model_id, c_mktsegment AS family, c_nationkey::BIGINT AS owner FROM customer",
    "fx_items": "SELECT DISTINCT p_partkey % 200 AS item_id, (p_partkey % 200) % 8 AS item_group FROM part",
    "fx_hits": """SELECT DISTINCT l_returnflag AS benchmark, o_custkey AS model_id, l_partkey % 200 AS item_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "fx_grid": "SELECT model_id, family, owner, unnest(['A', 'N', 'R']) AS benchmark FROM fx_models",
    "fx_all": """SELECT g.model_id, g.family, g.owner, g.benchmark, i.item_id, i.item_group,
          CASE WHEN h.item_id IS NULL THEN 0 ELSE 1 END AS y
        FROM fx_grid g CROSS JOIN fx_items i LEFT JOIN fx_hits h
          ON h.model_id = g.model_id AND h.benchmark = g.benchmark AND h.item_id = i.item_id""",
    "fx_accuracy": """SELECT m.model_id, m.family, m.owner, round(coalesce(s, 0) / 600.0::DOUBLE, 12) AS acc
        FROM fx_models m LEFT JOIN (SELECT model_id, count(*) AS s FROM fx_hits GROUP BY 1) h ON h.model_id = m.model_id""",
    "fx_capped": f"""SELECT model_id, family, owner, acc FROM (SELECT *, row_number() OVER (
          PARTITION BY family, owner ORDER BY {md5_sql(CAP_SEED, '0', 'model_id')}, model_id) AS rn FROM fx_accuracy) WHERE rn <= 5""",
    "fx_halves": f"""SELECT owner, CASE WHEN row_number() OVER (ORDER BY {md5_sql(HALF_SEED, "'half'", 'owner')}, owner) % 2 = 1
          THEN 'discovery' ELSE 'validation' END AS half FROM (SELECT DISTINCT owner FROM fx_models)""",
    "fx_pop": "SELECT c.*, h.half FROM fx_capped c JOIN fx_halves h ON h.owner = c.owner",
    "fx_reps": """SELECT model_id, family, owner, acc, half FROM (SELECT *, row_number() OVER (PARTITION BY owner, family
          ORDER BY round(abs(acc - med), 12), model_id) AS rn
          FROM (SELECT *, median(acc) OVER (PARTITION BY owner, family) AS med FROM fx_pop)) WHERE rn = 1""",
    "fx_resp": """SELECT a.*, p.half FROM fx_all a JOIN fx_pop p ON p.model_id = a.model_id""",
    "fx_rates": """SELECT benchmark, half, item_id, item_group, family, count(*) AS n, sum(y)::BIGINT AS s, avg(y) AS rate
        FROM fx_resp GROUP BY ALL""",
    "fx_effects": """SELECT benchmark, half, item_id, item_group, family,
          round(rate - avg(rate) OVER (PARTITION BY benchmark, half, item_id), 12) AS effect FROM fx_rates""",
    "fx_itemfit": """SELECT e.*, m.magnitude FROM
          (SELECT benchmark, half, item_id, item_group, round(sum(s)::DOUBLE / sum(n)::DOUBLE, 12) AS intercept FROM fx_rates GROUP BY ALL) e
          JOIN (SELECT benchmark, half, item_id, round(max(effect) - min(effect), 12) AS magnitude FROM fx_effects GROUP BY ALL) m
          ON m.benchmark = e.benchmark AND m.half = e.half AND m.item_id = e.item_id""",
    "fx_cells": """SELECT *, item_group || '|' || (ntile(4) OVER (PARTITION BY benchmark, half, item_group
          ORDER BY intercept, item_id) - 1) AS cell FROM fx_itemfit""",
    "fx_anchors": """SELECT *, rn <= k AS selected, CASE WHEN rn <= k THEN n::DOUBLE / k ELSE 0.0::DOUBLE END AS weight FROM (
          SELECT *, greatest(1, least(n, round_even(0.5 * n, 0)))::BIGINT AS k FROM (
            SELECT *, row_number() OVER (PARTITION BY benchmark, half, cell ORDER BY magnitude, item_id) AS rn,
              count(*) OVER (PARTITION BY benchmark, half, cell) AS n FROM fx_cells))""",
    "fx_target": """SELECT r.model_id, r.family, r.owner, r.benchmark, r.item_id, r.item_group, r.y,
          CASE WHEN r.half = 'discovery' THEN 'validation' ELSE 'discovery' END AS half
        FROM fx_resp r JOIN fx_reps p ON p.model_id = r.model_id""",
    "fx_scored": """SELECT t.benchmark, t.half, t.model_id, t.family, t.owner, round(avg(y), 12) AS full_score,
          round(sum(weight * y) / sum(weight), 12) AS low_score
        FROM fx_target t JOIN fx_anchors a ON a.benchmark = t.benchmark AND a.half = t.half AND a.item_id = t.item_id
        GROUP BY ALL""",
    "fx_shifts": f"""SELECT *, low_score - full_score AS score_shift, low_pct - full_pct AS percentile_shift FROM (
          SELECT *, {percentile_sql('', 'benchmark, half', 'full_score', 'full_pct')},
            {percentile_sql('', 'benchmark, half', 'low_score', 'low_pct')} FROM fx_scored)""",
    "fx_weights": f"""SELECT benchmark, half, replicate, item_id, cell, n::DOUBLE / k AS weight FROM (
          SELECT *, row_number() OVER (PARTITION BY benchmark, half, replicate, cell ORDER BY draw, item_id) AS r FROM (
            SELECT benchmark, half, item_id, cell, n, k, replicate,
              {md5_sql(CONTROL_SEED, 'benchmark', 'half', 'replicate', 'item_id')} AS draw
            FROM (SELECT *, unnest(range(1, {REPLICATES + 1})) AS replicate FROM fx_anchors))) WHERE r <= k""",
    "fx_control_scores": """SELECT c.*, s.family, s.owner, s.full_score FROM (
          SELECT t.benchmark, t.half, w.replicate, t.model_id, round(sum(w.weight * t.y) / sum(w.weight), 12) AS low_score
          FROM fx_target t JOIN fx_weights w ON w.benchmark = t.benchmark AND w.half = t.half AND w.item_id = t.item_id
          GROUP BY ALL) c JOIN fx_scored s ON s.benchmark = c.benchmark AND s.half = c.half AND s.model_id = c.model_id""",
    "fx_observed": pair_counts_sql("fx_scored", FOLD),
    "fx_control_pairs": pair_counts_sql("fx_control_scores", (*FOLD, "replicate")),
    "fx_control_ranges": f"""SELECT benchmark, half, replicate, 100.0 * (max(ms) - min(ms)) AS score_shift_range_points,
          max(mp) - min(mp) AS percentile_shift_range FROM (
          SELECT benchmark, half, replicate, family, avg(low_score - full_score) AS ms, avg(low_pct - full_pct) AS mp FROM (
            SELECT *, {percentile_sql('', 'benchmark, half, replicate', 'full_score', 'full_pct')},
              {percentile_sql('', 'benchmark, half, replicate', 'low_score', 'low_pct')} FROM fx_control_scores)
          GROUP BY ALL) GROUP BY ALL""",
    "fx_controls": """SELECT p.*, r.score_shift_range_points, r.percentile_shift_range FROM fx_control_pairs p JOIN fx_control_ranges r
          ON r.benchmark = p.benchmark AND r.half = p.half AND r.replicate = p.replicate""",
    "fx_ranges": """SELECT benchmark, half, 100.0 * (max(ms) - min(ms)) AS score_shift_range_points, max(mp) - min(mp) AS percentile_shift_range
          FROM (SELECT benchmark, half, family, avg(score_shift) AS ms, avg(percentile_shift) AS mp FROM fx_shifts GROUP BY ALL) GROUP BY ALL""",
    "fx_observed_full": """SELECT o.*, r.score_shift_range_points, r.percentile_shift_range FROM fx_observed o JOIN fx_ranges r
          ON r.benchmark = o.benchmark AND r.half = o.half""",
    "fx_aggregates": """SELECT t.benchmark, t.half, t.item_group::VARCHAR AS unit, t.model_id, sum(y)::BIGINT AS full_success, count(*) AS full_mass,
          sum(weight * y) AS low_success, sum(weight) AS low_mass
        FROM fx_target t JOIN fx_anchors a ON a.benchmark = t.benchmark AND a.half = t.half AND a.item_id = t.item_id GROUP BY ALL""",
}


def with_ctes(body: str) -> str:
    """Prefix `body` with the shared tables it names, in dependency order."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"\bfx_\w+", sql):
            if name not in order and name in CTES:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {head}\nSELECT * FROM ({body})" if order else body
