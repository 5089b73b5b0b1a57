"""Contracts: violation tables, profiles, fingerprints, comparisons and scans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, sorted_join

# Patterns of text that must not be published, and column names that identify people or items.
SENSITIVE_PATTERNS = {
    "absolute_user_path": r"/(?:Users|home)/[^/$\s]+/",
    "openai_style_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "private_key": r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    "assigned_api_key": r"(?i)(?:api[_-]?key|access[_-]?token|secret)\s*[=:]\s*['\"][^'\"]{8,}",
    "absolute_machine_path": r"(?:^|[^:\w])/(?:private|tmp|mnt|workspace|root|scratch|gpfs|lustre|cluster|data)/[^\s\"'<>]+",
    "windows_user_path": r"\b[A-Za-z]:[\\/](?:Users|Documents and Settings)[\\/][^\s\"']+",
    "hosting_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{20,})\b",
}
SENSITIVE_COLUMNS = (
    "question", "question_text", "problem", "rationale", "prompt", "model_id", "owner", "uploader", "item_id",
    "blinded_id", "pair_id", "model_name", "owner_id", "original_item_id", "dataset_item_index",
    "dataset_model_index", "affiliation", "institution", "email")


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def validate_responses(responses: DataFrame, models: DataFrame, items: DataFrame,
                       keys: Sequence[str] = ()) -> DataFrame:
    """Violations of the outcome contract, one row per rule (zero violations = valid).

    Rules: only 0/1, complete and unique cells, unique and non-blank model and
    item rows, at least two families and four owners.
    """
    # A model's cells of up to 64 items are one row: a bit for each item seen.
    whole = dict(responses.dtypes)["item_id"] in ("tinyint", "smallint", "int", "bigint")
    item = F.col("item_id").cast("bigint") if whole else F.col("item_id")
    block = F.shiftright(item, 6) if whole else item
    place = F.coalesce(item.bitwiseAND(F.lit(63)), F.lit(0)).cast("int") if whole else F.lit(0)
    cells = responses.withColumn("_block", block).withColumn("_bit", F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    facts = cut(cells.groupBy(*keys, "_block", "model_id").agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col("y").isNull() | ~F.col("y").isin(0, 1)).alias("bad"), F.bit_or("_bit").alias("_seen")))
    f = facts.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("not_binary"), F.coalesce(F.sum(F.bit_count("_seen")), F.lit(0)).cast("bigint").alias("_cells"), F.lit(1).alias("_k"))
    listed = facts.groupBy(*keys, "_block").agg(F.bit_or("_seen").alias("_seen")).agg(
        F.coalesce(F.sum(F.bit_count("_seen")), F.lit(0)).cast("bigint").alias("_items"), F.lit(1).alias("_k"))
    # Single cells are counted only in the rows that hold more cells than bits.
    twice = facts.where(F.col("c") > F.bit_count("_seen")).select(*keys, "_block", "model_id")
    if twice.take(1):
        same = [cells[k].eqNullSafe(twice[k]) for k in (*keys, "_block", "model_id")]
        rows = cells.join(sorted_join(twice), reduce(Column.__and__, same), "left_semi")
        rep = rows.groupBy(*keys, "item_id", "model_id").agg(F.count(F.lit(1)).alias("c")).agg(
            F.count_if(F.col("c") > 1).alias("repeated_cell"), F.lit(1).alias("_k"))
        f = f.join(rep, "_k")
    else:
        f = f.withColumn("repeated_cell", F.lit(0).cast("bigint"))
    seen = facts.select("model_id").distinct().agg(F.count(F.lit(1)).alias("_models"), F.lit(1).alias("_k"))
    f = f.join(listed, "_k").join(seen, "_k").drop("_k")
    m = models.agg(
        (F.count(F.lit(1)) - F.countDistinct("model_id")).alias("repeated_model"),
        F.count_if(_blank("model_id") | _blank("family") | _blank("owner")).alias("blank_model_field"),
        F.when(F.countDistinct("family") < 2, 1).otherwise(0).cast("bigint").alias("fewer_than_two_families"),
        F.when(F.countDistinct("owner") < 4, 1).otherwise(0).cast("bigint").alias("fewer_than_four_owners"))
    i = items.agg((F.count(F.lit(1)) - F.countDistinct("item_id")).alias("repeated_item"),
                  F.count_if(_blank("item_group")).alias("blank_item_field"))
    f = f.withColumn("missing_cell", F.col("_items") * F.col("_models") - F.col("_cells")).drop("_items", "_models", "_cells")
    tall = [d.unpivot([], d.columns, "rule", "violations") for d in (f, m, i)]
    return tall[0].unionByName(tall[1]).unionByName(tall[2])


def require_valid(violations: DataFrame) -> None:
    broken = [r["rule"] for r in violations.filter("violations <> 0").select("rule").collect()]
    if broken:
        raise ValueError("contract broken: " + ", ".join(sorted(broken)))


def dense_id_check(df: DataFrame, id_col: str) -> DataFrame:
    """Are the ids exactly 0..n-1? Counts of repeats, ids out of range and missing ids."""
    per = df.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(
        F.sum("c").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("ids")).select(
        "n", "low", "high", (F.col("n") - F.col("ids")).alias("repeats"),
        (F.col("high") - F.col("low") + 1 - F.col("ids")).alias("holes"),
        ((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("ids") == F.col("n"))).alias("dense"))


def missing_ids(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """Ids of 0..n-1 that are absent (distributed range, anti join)."""
    return df.sparkSession.range(n).withColumnRenamed("id", id_col).join(df.select(id_col), id_col, "left_anti")


def matrix_profile(cells: DataFrame, n_items: int, n_models: int) -> DataFrame:
    """Shape, value counts, response counts per item and model, item accuracy, filter counts.

    Missing cells are absent rows. Facts are reduced once per item and once per model.
    """
    item = cells.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("one"), F.count_if(F.col("y") == 0).alias("zero"),
        F.avg("y").alias("p"), F.stddev_pop("y").alias("sd"))
    low, extreme_low, extreme_high = F.col("sd") < 0.01, F.col("p") <= 0.02, F.col("p") >= 0.98
    a = item.agg(
        F.sum("n").alias("valid_cells"), F.sum("one").alias("correct_cells"), F.sum("zero").alias("incorrect_cells"),
        F.sum(F.col("n") - F.col("one") - F.col("zero")).alias("other_cells"),
        F.min("n").alias("responses_per_item_min"), F.max("n").alias("responses_per_item_max"),
        F.min("p").alias("item_accuracy_min"), F.percentile("p", 0.5).alias("item_accuracy_median"),
        F.max("p").alias("item_accuracy_max"), F.count_if(low).alias("items_low_sd"),
        F.count_if(extreme_low).alias("items_at_most_002"), F.count_if(extreme_high).alias("items_at_least_098"),
        F.count_if(~low & ~extreme_low & ~extreme_high).alias("items_kept"), F.lit(1).alias("_k"))
    m = cells.groupBy("model_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.min("n").alias("responses_per_model_min"), F.max("n").alias("responses_per_model_max"), F.lit(1).alias("_k"))
    return a.join(m, "_k").drop("_k").withColumn(
        "missing_cells", F.lit(n_items).cast("bigint") * n_models - F.col("valid_cells")).withColumn(
        "overall_accuracy", F.col("correct_cells") / F.col("valid_cells"))


def two_stage_item_filter(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Items with sd >= 0.01 and accuracy strictly between 0.02 and 0.98."""
    return cells.groupBy(*keys, "item_id").agg(F.avg("y").alias("accuracy"), F.stddev_pop("y").alias("sd")).filter(
        (F.col("sd") >= 0.01) & (F.col("accuracy") > 0.02) & (F.col("accuracy") < 0.98))


def complete_models(cells: DataFrame) -> DataFrame:
    """Models observed on every item; the item count is one aggregate row."""
    per = cells.groupBy("model_id").agg(F.countDistinct("item_id").alias("n"))
    total = cells.select("item_id").distinct().count()
    return per.filter(F.col("n") == total).select("model_id")


def size_rule(cells: DataFrame, minimum: int) -> None:
    n = cells.agg(F.countDistinct("item_id").alias("i"), F.countDistinct("model_id").alias("m")).first()
    if min(n["i"], n["m"]) < minimum:
        raise ValueError(f"needs at least {minimum} items and models, found {n['i']} and {n['m']}")


def id_alignment(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one map old_id -> new_id over rows whose `keys` are unique on both sides.

    Other rows keep a status: repeated key, or no partner.
    """
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min("id").alias(f"{tag}_id"), F.count(F.lit(1)).alias(f"{tag}_n"))

    t = side(old, "old").join(side(new, "new"), list(keys), "full")
    status = (F.when(F.col("old_n").isNull() | F.col("new_n").isNull(), "no_partner")
              .when((F.col("old_n") > 1) | (F.col("new_n") > 1), "repeated_key").otherwise("aligned"))
    return t.select("old_id", "new_id", status.alias("status"))


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order-free digest of the content: row count and sum of row digests."""
    part = F.conv(F.substring(row_digest(df, columns), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(part).alias("digest"))


def table_diff(reference: DataFrame, actual: DataFrame, keys: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """Per reference column: rows that differ (exact, or rtol = atol = tolerance for doubles).

    Also rows without a partner, under the name `<rows>`; a column that is missing
    in `actual` counts all its rows as different.
    """
    keys = list(keys)
    values = [c for c in reference.columns if c not in keys]
    a = reference.select(*keys, F.lit(1).alias("_ref"), *[F.col(c).alias(f"r_{c}") for c in values])
    have = [c for c in values if c in actual.columns]
    b = actual.select(*keys, F.lit(1).alias("_act"), *[F.col(c).alias(f"a_{c}") for c in have])
    types = dict(reference.dtypes)

    def differs(c: str) -> Column:
        if c not in have:
            return F.lit(True)
        l, r = F.col(f"r_{c}"), F.col(f"a_{c}")
        if types[c] in ("double", "float"):
            return ~(l.eqNullSafe(r) | F.coalesce(F.abs(l - r) <= tolerance + tolerance * F.abs(l), F.lit(False)))
        return ~l.eqNullSafe(r)

    both = F.col("_ref").isNotNull() & F.col("_act").isNotNull()
    t = a.join(b, keys, "full").agg(
        F.count_if(~both).alias("<rows>"), *[F.count_if(both & differs(c)).alias(c) for c in values])
    return t.unpivot([], t.columns, "column_name", "differing")


def sensitive_scan(df: DataFrame, text_col: str, patterns: Mapping[str, str] = SENSITIVE_PATTERNS,
                   deny: Sequence[str] = ()) -> DataFrame:
    """Rows whose whole text matches each pattern or holds a denied term. One pass, no explode."""
    text = F.col(text_col)
    low = F.lower(text)
    hits = df.agg(*[F.count_if(text.rlike(p)).alias(n) for n, p in patterns.items()],
                  *[F.count_if(F.contains(low, F.lit(d.lower()))).alias(f"deny:{d}") for d in deny])
    return hits.unpivot([], hits.columns, "finding", "texts")


def sensitive_columns(df: DataFrame) -> list[str]:
    return sorted(set(c.lower() for c in df.columns) & set(SENSITIVE_COLUMNS))
