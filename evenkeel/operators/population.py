"""Model populations: families, owner caps, owner-disjoint halves, samples."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import draw_key
from ..functions.ranks import bucketed_row_number, hash_row_number
from ..session import cut

# Name pattern of each family, default families, lineage markers.
FAMILY_PATTERNS = {
    "qwen": r"qwen",
    "llama": r"llama",
    "gemma": r"gemma",
    "mistral": r"mistral|mixtral",
    "deepseek": r"deepseek",
    "phi": r"(^|[^a-z])phi[-_ .0-9]",
}
DEFAULT_FAMILIES = ("qwen", "llama", "gemma", "mistral", "phi")
LINEAGE_MARKERS = (
    r"(?i)merge|slerp|franken|lora|qlora|adapter|distill|hybrid|fusion|fuse|"
    r"(^|[-_.])dpo($|[-_.])|(^|[-_.])ppo($|[-_.])|(^|[-_.])orpo($|[-_.])|"
    r"(^|[-_.])kto($|[-_.])|abliterat|uncensor"
)
HALVES = ("discovery", "validation")


def classify_family(df: DataFrame, name: str, patterns: Mapping[str, str] = FAMILY_PATTERNS) -> DataFrame:
    """Add `family` (null unless exactly one pattern matches) and `reason`."""
    low = F.lower(F.col(name))
    hits = F.filter(
        F.array(*[F.when(low.rlike(p), F.lit(f)) for f, p in patterns.items()]),
        lambda x: x.isNotNull())
    return (
        df.withColumn("_hits", hits)
        .withColumn("family", F.when(F.size("_hits") == 1, F.col("_hits")[0]))
        .withColumn("reason", F.when(F.size("_hits") == 1, F.lit("unique_regex_match"))
                    .when(F.size("_hits") > 1, F.concat(F.lit("ambiguous:"), F.array_join("_hits", ",")))
                    .otherwise(F.lit("unmatched")))
        .drop("_hits"))


def owner_of(name: Column) -> Column:
    """Lower-cased text before the first double underscore, or the whole name."""
    head = F.trim(F.substring_index(name, "__", 1))
    return F.lower(F.when(F.instr(name, "__") > 0, head).otherwise(name))


def family_candidates(models: DataFrame, accuracy: DataFrame, families: Sequence[str]) -> DataFrame:
    """Models of the requested families with their accuracy."""
    return models.filter(F.col("family").isin(list(families))).join(accuracy, "model_id")


def owner_cap(models: DataFrame, cap: int, seed: int) -> DataFrame:
    """At most `cap` random models per (family, owner); zero keeps all.

    The rank filter is pushed below the shuffle (window group limit), so a hot
    owner sends at most `cap` rows per partition.
    """
    if cap == 0:
        return models
    w = Window.partitionBy("family", "owner").orderBy("_draw", "model_id")
    return (
        models.withColumn("_draw", draw_key(seed, 0, "model_id"))
        .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_draw", "_rn"))


def family_shortfall(population: DataFrame, minimum: int) -> DataFrame:
    """Families with fewer than `minimum` models."""
    return population.groupBy("family").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < minimum)


def balanced_owner_split(population: DataFrame, seed: int) -> DataFrame:
    """Greedy two-way assignment of whole owners that balances counts and accuracy.

    Spark reduces the population to one row per owner. The greedy pass reads
    those rows in order as a stream with two small count and sum tables as its
    only state, so its memory does not grow with the number of owners.
    """
    totals = population.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.avg("acc").alias("mu")).orderBy("family").collect()
    families = [r["family"] for r in totals]
    size = {r["family"]: float(r["n"]) for r in totals}
    mean = {r["family"]: float(r["mu"]) for r in totals}
    per_family = population.groupBy("owner", "family").agg(
        F.count(F.lit(1)).alias("n"), F.sum("acc").alias("a"))
    owners = per_family.groupBy("owner").agg(
        F.sum("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("family", "n", "a"))).alias("parts"))
    ordered = (
        owners.withColumn("_draw", draw_key(seed, "owner", tag="tie"))
        .withColumn("_side", F.conv(F.substring(draw_key(seed, "owner", tag="side"), 1, 8), 16, 10)
                    .cast("bigint") % 2)
        .orderBy(F.col("n").desc(), "_draw", "owner").coalesce(1))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = [dict.fromkeys(families, 0.0) for _ in HALVES]
        total = [dict.fromkeys(families, 0.0) for _ in HALVES]
        for batch in batches:
            sides = []
            for parts, tie_side in zip(batch["parts"], batch["_side"]):
                add = {p["family"]: (float(p["n"]), float(p["a"])) for p in parts}
                cost = []
                for side in (0, 1):
                    c = 0.0
                    for f in families:
                        n, a = add.get(f, (0.0, 0.0))
                        sign = 1.0 if side == 0 else -1.0
                        dn = count[0][f] - count[1][f] + sign * n
                        da = total[0][f] - total[1][f] + sign * a
                        c += abs(dn) / size[f] + abs(da - dn * mean[f]) / size[f]
                    cost.append(round(c, 12))
                side = int(tie_side) if cost[0] == cost[1] else int(cost[1] < cost[0])
                for f, (n, a) in add.items():
                    count[side][f] += n
                    total[side][f] += a
                sides.append(HALVES[side])
            yield pd.DataFrame({"owner": batch["owner"], "half": sides})

    owner_type = population.schema["owner"].dataType.simpleString()
    halves = ordered.mapInPandas(assign, f"owner {owner_type}, half string")
    return population.join(halves, "owner")


def split_checks(population: DataFrame, min_per_half: int = 2) -> DataFrame:
    """Count of violations per rule of an owner-disjoint split."""
    owners = population.groupBy("owner").agg(F.countDistinct("half").alias("h"))
    cells = population.groupBy("family").agg(
        *[F.count_if(F.col("half") == h).alias(h) for h in HALVES])
    halves = population.groupBy("half").agg(
        F.countDistinct("owner").alias("o"), F.count(F.lit(1)).alias("n"))

    def one(df: DataFrame, rule: str, bad: Column) -> DataFrame:
        return df.agg(F.count_if(bad).alias("violations")).select(F.lit(rule).alias("rule"), "violations")

    low = F.least(*[F.col(h) for h in HALVES])
    return (
        one(owners, "owner_in_both_halves", F.col("h") > 1)
        .unionByName(one(cells, "family_missing_in_a_half", low == 0))
        .unionByName(one(cells, "family_below_minimum", low < min_per_half))
        .unionByName(one(halves, "nested_split_impossible", (F.col("o") < 2) | (F.col("n") < 12))))


def representatives_median(population: DataFrame) -> DataFrame:
    """Per (owner, family): the model nearest to the median accuracy, ties by id."""
    median = population.groupBy("owner", "family").agg(F.percentile("acc", 0.5).alias("_med"))
    near = population.join(median, ["owner", "family"]).withColumn(
        "_far", F.round(F.abs(F.col("acc") - F.col("_med")), 12))
    w = Window.partitionBy("owner", "family").orderBy("_far", "model_id")
    return (near.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
            .drop("_rn", "_far", "_med"))


def representatives_lexicographic(models: DataFrame, owner_halves: DataFrame) -> DataFrame:
    """First model id per (owner, family) with the frozen half of its owner."""
    w = Window.partitionBy("owner", "family").orderBy("model_id")
    first = models.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return first.join(owner_halves, "owner")


def validate_population(population: DataFrame, models: DataFrame) -> DataFrame:
    """Violations: unknown ids, metadata that differs, bad halves, impure owners, repeats."""
    ref = models.select("model_id", F.col("family").alias("_f"), F.col("owner").alias("_o"))
    rows = population.join(ref, "model_id", "left").agg(
        F.count_if(F.col("_f").isNull()).alias("unknown_model"),
        F.count_if((F.col("_f") != F.col("family")) | (F.col("_o") != F.col("owner"))).alias("metadata_differs"),
        F.count_if(~F.col("half").isin(*HALVES)).alias("bad_half"))
    owners = population.groupBy("owner").agg(F.countDistinct("half").alias("h")).agg(
        F.count_if(F.col("h") > 1).alias("owner_crosses_halves"))
    ids = population.groupBy("model_id").agg(F.count(F.lit(1)).alias("c")).agg(
        F.count_if(F.col("c") > 1).alias("repeated_model"))

    def tall(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "rule", "violations")

    return tall(rows).unionByName(tall(owners)).unionByName(tall(ids))


def strict_lineage_filter(models: DataFrame, name: str) -> DataFrame:
    """Drop names that signal merges, adapters or preference tuning."""
    return models.filter(~F.col(name).rlike(LINEAGE_MARKERS))


def population_variants(models: DataFrame, name: str, seed: int, families: Sequence[str],
                        owner_halves: DataFrame, caps: Sequence[int] = (1, 3)) -> DataFrame:
    """Tagged union of population rules: caps, first checkpoint, strict lineage, one family left out."""
    def tag(df: DataFrame, variant: str) -> DataFrame:
        return df.select(F.lit(variant).alias("variant"), "model_id", "family", "owner")

    parts = [tag(owner_cap(models, c, seed), f"owner_cap_{c}") for c in caps]
    parts.append(tag(owner_cap(models, 5, seed), "owner_cap_5_baseline"))
    parts.append(tag(representatives_lexicographic(models, owner_halves), "lexicographic_checkpoint"))
    parts.append(tag(owner_cap(strict_lineage_filter(models, name), 5, seed), "strict_lineage"))
    parts += [tag(owner_cap(models.filter(F.col("family") != f), 5, seed), f"omit_{f.lower()}")
              for f in sorted(families)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def selection_audit(population: DataFrame, representatives: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Model, owner and representative counts per family and half."""
    keys = [*keys, "family"]
    halves = lambda p: [F.count_if(F.col("half") == h).alias(f"{h}_{p}") for h in HALVES]
    a = population.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("audit_models"), F.countDistinct("owner").alias("owners"),
        *halves("audit_models"))
    b = representatives.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("representatives"), *halves("representatives"))
    return a.join(b, keys, "left").na.fill(0)


def apportion(sizes: DataFrame, stratum: str, fraction: float) -> DataFrame:
    """Whole shares of each stratum that add up to `fraction` of the total, what is over going to the rest.

    `sizes`: (stratum, n). Every stratum gets its quota rounded down; the places left go to the
    largest remainders, ties to the smaller name. Returns (stratum, share).
    """
    sizes = cut(sizes)
    whole, strata = sizes.agg(F.sum("n"), F.count(F.lit(1))).first()
    if not whole:
        return sizes.select(stratum, F.lit(0).cast("bigint").alias("share"))
    total = whole - math.ceil(round((1 - fraction) * whole, 9))
    quota = sizes.withColumn("_base", F.expr(f"{total}L * n div {whole}")).withColumn("_rest", F.expr(f"{total}L * n % {whole}"))
    left = total - quota.agg(F.sum("_base")).first()[0]
    ranked = bucketed_row_number(quota, [], [F.col("_rest").desc(), F.col(stratum)], F.floor(-256.0 * F.col("_rest") / F.lit(whole)), "_place", strata)
    return ranked.select(stratum, (F.col("_base") + (F.col("_place") <= left).cast("bigint")).alias("share"))


def stratified_item_split(items: DataFrame, stratum: str, id_col: str, fraction: float, seed: int) -> DataFrame:
    """Add `part` = train or test; the train items are exactly the total's share, apportioned to the strata."""
    shares = apportion(items.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), stratum, fraction)
    r = hash_row_number(items, [stratum], draw_key(seed, id_col, tag="item"), id_col).join(shares, stratum)
    part = F.when(F.col("rn") <= F.col("share"), F.lit("train")).otherwise(F.lit("test"))
    return r.withColumn("part", part).select(*[F.col(c) for c in items.columns], "part")


def model_split(models: DataFrame, eval_fraction: float, tuning: int, seed: int) -> DataFrame:
    """Random evaluation share; `tuning` of the rest are marked for tuning.

    One dummy key would make one hot group; the bucketed rank spreads it.
    """
    r = hash_row_number(models.withColumn("_all", F.lit(1)), ["_all"], draw_key(seed, "model_id", tag="model"), "model_id")
    n_eval = F.bround(F.lit(eval_fraction) * F.col("rn_of"), 0)
    return (
        r.withColumn("split", F.when(F.col("rn") <= n_eval, F.lit("evaluation")).otherwise(F.lit("population")))
        .withColumn("tuning", (F.col("rn") > n_eval) & (F.col("rn") <= n_eval + tuning))
        .drop("_all", "rn", "rn_of"))


def nested_owner_split(population: DataFrame, keys: Sequence[str], seed: int, fraction: float = 0.25) -> DataFrame:
    """Add `is_validation`: the models of a random quarter of the owners of each `keys` group."""
    keys = list(keys)
    owners = population.select(*keys, "owner").distinct()
    r = hash_row_number(owners, keys, draw_key(seed, *keys, "owner", tag="owner"), "owner")
    share = F.greatest(F.lit(1), F.least(F.col("rn_of") - 1, F.bround(F.lit(fraction) * F.col("rn_of"), 0)))
    marked = r.select(*keys, "owner", (F.col("rn") <= share).alias("is_validation"))
    return population.join(marked, [*keys, "owner"])


def calibration_mask(items: DataFrame, group: str, id_col: str, seed: int) -> DataFrame:
    """Add `is_calibration`: a random half inside each group; single items calibrate."""
    r = hash_row_number(items, [group], draw_key(seed, id_col, tag="calibration"), id_col)
    n = F.col("rn_of")
    share = F.when(n == 1, F.lit(1)).otherwise(
        F.greatest(F.lit(1), F.least(n - 1, F.bround(0.5 * n, 0))))
    return r.withColumn("is_calibration", F.col("rn") <= share).drop("rn", "rn_of")


def stratified_kfold(items: DataFrame, stratum: str, id_col: str, folds: int, seed: int) -> DataFrame:
    """Add `fold`: near-equal random folds inside each stratum."""
    r = hash_row_number(items, [stratum], draw_key(seed, id_col, tag="fold"), id_col)
    return r.withColumn("fold", (F.col("rn") - 1) % folds).drop("rn", "rn_of")


def sample_cells(responses: DataFrame, limit: int, seed: int) -> DataFrame:
    """A random sample of `limit` cells (the sampling operator); a per-partition top-k, not a full sort."""
    key = draw_key(seed, "item_id", "model_id", tag="cell")
    return responses.withColumn("_draw", key).orderBy("_draw", "item_id", "model_id").limit(limit).drop("_draw")


