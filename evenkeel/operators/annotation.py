"""Paired labels of two annotators: sampling, blinding, agreement and enrichment tests.

Labels are long rows (annotator, blinded_id, benchmark, cell, pair_id, grp,
disc_family, val_family, axis, kind, value), so an axis is a key, not a column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import KeyedOrder
from ..functions.exprs import draw_key
from ..functions.inference import bh_adjust, binomial_two_sided, cohen_kappa, wilcoxon
from ..functions.ranks import hash_row_number, spearman
from ..session import cut, small_enough, sorted_join
from .blueprint import replicated

GROUPS = ("stable_high_dif", "matched_control")
# Gates of the confirmatory analysis.
BH_ALPHA, MIN_DIFFERENCE, MIN_BENCHMARKS = 0.05, 0.08, 3
KAPPA_GATE, RHO_GATE = 0.45, 0.50
PAYLOAD = T.StructType([T.StructField("annotations", T.ArrayType(T.StructType([
    T.StructField("blinded_id", T.LongType()), T.StructField("axis", T.StringType()), T.StructField("value", T.IntegerType())])))])


def pair_sample(items: DataFrame, per_benchmark: int, seed: int) -> DataFrame:
    """Stable-high items with one unused control of their cell, up to n random pairs per benchmark.

    `items`: (benchmark, item_id, cell, hd, hv). Both sides are ranked by hash inside
    the cell and joined on the rank, so no control is used twice.
    """
    high = items.filter("hd and hv")
    free = items.filter("not hd and not hv")
    rank = lambda t, tag: hash_row_number(t.select("benchmark", "cell", "item_id"), ["benchmark", "cell"],
                                          draw_key(seed, "benchmark", "item_id", tag=tag), "item_id")
    a = rank(high, "high").select("benchmark", "cell", "rn", F.col("item_id").alias("high_id"))
    b = rank(free, "control").select("benchmark", "cell", "rn", F.col("item_id").alias("control_id"))
    pairs = a.join(b, ["benchmark", "cell", "rn"]).drop("rn")
    placed = hash_row_number(pairs, ["benchmark"], draw_key(seed, "benchmark", "high_id", tag="sample"), "high_id")
    return placed.filter(F.col("rn") <= per_benchmark).select("benchmark", "cell", F.col("rn").alias("pair"), "high_id", "control_id")


def blind(items: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Random blinded ids; the key table and the text-only packet are two projections of the result."""
    r = hash_row_number(items.withColumn("_all", F.lit(0)), ["_all"], draw_key(seed, id_col, tag="blind"), id_col)
    number = (F.col("rn") - 1).cast("string")
    name = F.concat(F.lit("item_"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))
    return r.withColumn("blinded_id", name).drop("_all", "rn", "rn_of")


def payload_violations(batches: DataFrame, expected: DataFrame, binary: Sequence[str], ordinal: Sequence[str]) -> DataFrame:
    """Per batch: missing, foreign and repeated records and values outside their domain.

    `batches`: (batch, payload JSON). `expected`: (batch, blinded_id, axis).
    """
    rows = batches.select("batch", F.explode(F.from_json("payload", PAYLOAD)["annotations"]).alias("a")).select("batch", "a.*")
    bad = (F.col("axis").isin(*binary) & ~F.col("value").isin(0, 1)) | (F.col("axis").isin(*ordinal) & ~F.col("value").isin(0, 1, 2, 3)) | F.col("value").isNull()
    got = rows.groupBy("batch", "blinded_id", "axis").agg(F.count(F.lit(1)).alias("c"), F.count_if(bad).alias("bad"))
    want = expected.withColumn("_want", F.lit(1))
    t = got.join(want, ["batch", "blinded_id", "axis"], "full")
    return t.groupBy("batch").agg(
        F.count_if(F.col("_want").isNotNull()).alias("expected"), F.count_if(F.col("c").isNull()).alias("missing"),
        F.count_if(F.col("_want").isNull()).alias("foreign"), F.count_if(F.col("c") > 1).alias("repeated"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad_values"))


def merge_annotations(batches: DataFrame, key: DataFrame) -> DataFrame:
    """Records of all batches joined with the blinding key; rows without a key keep a null group."""
    rows = batches.select("annotator", F.explode(F.from_json("payload", PAYLOAD)["annotations"]).alias("a")).select("annotator", "a.*")
    return rows.join(key, "blinded_id", "left")


def panel_violations(panel: DataFrame) -> DataFrame:
    """Violations of the paired design per annotator. `panel`: one row per (annotator, blinded_id)."""
    pairs = panel.groupBy("annotator", "benchmark", "pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("grp").alias("g"), F.countDistinct("cell").alias("c"))
    a = pairs.groupBy("annotator").agg(
        F.count_if(F.col("n") != 2).alias("pair_size"), F.count_if(F.col("g") != 2).alias("pair_groups"),
        F.count_if(F.col("c") != 1).alias("pair_crosses_cells"))
    b = panel.groupBy("annotator").agg(
        F.count(F.lit(1)).alias("items"), (F.count(F.lit(1)) - F.countDistinct("blinded_id")).alias("repeated_ids"),
        F.count_if(~F.col("grp").isin(*GROUPS)).alias("bad_group"))
    single = panel.groupBy("blinded_id").agg(F.countDistinct("annotator").alias("a")).filter("a <> 2").agg(
        F.count(F.lit(1)).alias("not_by_both"))
    return a.join(b, "annotator").withColumn("_k", F.lit(1)).join(single.withColumn("_k", F.lit(1)), "_k").drop("_k")


def _two(labels: DataFrame, names: tuple[str, str]) -> DataFrame:
    one = lambda n, c: labels.filter(F.col("annotator") == n).select("blinded_id", "axis", "kind", F.col("value").alias(c))
    return one(names[0], "a").join(sorted_join(one(names[1], "b")), ["blinded_id", "axis", "kind"])


def kappa_table(labels: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Chance-corrected agreement per binary axis."""
    return _two(labels.filter("kind = 'binary'"), names).groupBy("axis").agg(cohen_kappa(F.col("a"), F.col("b")).alias("cohen_kappa"))


def reliability(labels: DataFrame, names: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """Binary (kappa, agreement, prevalence) and ordinal (rank correlation, agreement, distance) tables."""
    same = F.avg((F.col("a") == F.col("b")).cast("double"))
    binary = _two(labels.filter("kind = 'binary'"), names).groupBy("axis").agg(
        cohen_kappa(F.col("a"), F.col("b")).alias("cohen_kappa"), same.alias("raw_agreement"),
        F.avg("a").alias("annotator_a_prevalence"), F.avg("b").alias("annotator_b_prevalence"))
    t = _two(labels.filter("kind = 'ordinal'"), names)
    rho = spearman(t, ["axis"], "a", "b", "spearman_r").drop("n")
    ordinal = t.groupBy("axis").agg(same.alias("exact_agreement"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_absolute_difference"))
    return binary, ordinal.join(rho, "axis")


def _pairs(labels: DataFrame, kind: str) -> DataFrame:
    """One row per (annotator, axis, benchmark, pair): high and control value."""
    v = lambda g: F.max(F.when(F.col("grp") == g, F.col("value")))
    return labels.filter(F.col("kind") == kind).groupBy("annotator", "axis", "benchmark", "pair_id").agg(
        v(GROUPS[0]).alias("high"), v(GROUPS[1]).alias("control"))


def paired_binary(labels: DataFrame) -> DataFrame:
    """Rates, discordant pairs, exact McNemar p, direction count over benchmarks and q per annotator."""
    p = _pairs(labels, "binary")
    by = ["annotator", "axis"]
    base = p.groupBy(*by).agg(
        F.avg("high").alias("stable_high_rate"), F.avg("control").alias("matched_control_rate"),
        F.count_if((F.col("high") == 1) & (F.col("control") == 0)).alias("discordant_high_only"),
        F.count_if((F.col("high") == 0) & (F.col("control") == 1)).alias("discordant_control_only"),
        F.sign(F.sum("high") - F.sum("control")).alias("_dir"))
    per = p.groupBy(*by, "benchmark").agg(F.sign(F.sum("high") - F.sum("control")).alias("_s"))
    same = per.join(base.select(*by, "_dir"), by).groupBy(*by).agg(F.count_if(F.col("_s") == F.col("_dir")).alias("benchmarks_same_direction"))
    n = F.col("discordant_high_only") + F.col("discordant_control_only")
    t = base.join(same, by).withColumn("paired_difference", F.col("stable_high_rate") - F.col("matched_control_rate")).withColumn(
        "mcnemar_exact_p", F.round(binomial_two_sided(F.least("discordant_high_only", "discordant_control_only"), n), 12)).drop("_dir")
    return bh_adjust(t, ["annotator"], "mcnemar_exact_p", "axis").withColumnRenamed("q", "bh_q")


def paired_ordinal(labels: DataFrame) -> DataFrame:
    """Mean paired difference and signed-rank test per annotator and axis, with q per annotator."""
    p = _pairs(labels, "ordinal").withColumn("d", (F.col("high") - F.col("control")).cast("double"))
    by = ["annotator", "axis"]
    base = p.groupBy(*by).agg(F.avg("high").alias("stable_high_mean"), F.avg("control").alias("matched_control_mean"),
                              F.avg("d").alias("paired_mean_difference"))
    test = wilcoxon(p, by, "d").select(*by, F.round("p", 12).alias("wilcoxon_p"))
    return bh_adjust(base.join(test, by), ["annotator"], "wilcoxon_p", "axis").withColumnRenamed("q", "bh_q")


def _association(cells: DataFrame, by: Sequence[str], prevalence: DataFrame, prev_keys: Sequence[str]) -> DataFrame:
    """Sum over (benchmark, family) of (obs - n pi)^2 / (n pi (1 - pi)); certain benchmarks are skipped."""
    return _statistic(cells.groupBy(*by, "benchmark", "family").agg(F.sum("value").alias("o"), F.count(F.lit(1)).alias("n")), by, prevalence, prev_keys)


def _statistic(obs: DataFrame, by: Sequence[str], prevalence: DataFrame, prev_keys: Sequence[str]) -> DataFrame:
    """The sum of `_association` from the successes `o` of `n` values per (benchmark, family)."""
    pi, e = F.col("pi"), F.col("n") * F.col("pi")
    part = F.when((pi > 0) & (pi < 1), (F.col("o") - e) * (F.col("o") - e) / (e * (1 - pi))).otherwise(0.0)
    return obs.join(prevalence, [*prev_keys, "benchmark"]).groupBy(*by).agg(F.sum(part).alias("statistic"))


def stable_direction(labels: DataFrame) -> DataFrame:
    """High items whose advantaged family agrees in both halves, with that family."""
    return labels.filter((F.col("kind") == "binary") & (F.col("grp") == GROUPS[0]) & (F.col("disc_family") == F.col("val_family"))).withColumn(
        "family", F.col("disc_family"))


def conditional_association(labels: DataFrame) -> DataFrame:
    """Family association of every axis, stratified by benchmark."""
    t = stable_direction(labels)
    prev = t.groupBy("annotator", "axis", "benchmark").agg(F.avg("value").alias("pi"))
    return _association(t, ["annotator", "axis"], prev, ["annotator", "axis"])


def prevalence(labels: DataFrame) -> DataFrame:
    """Raw and benchmark-standardized prevalence per annotator, axis and family."""
    t = stable_direction(labels)
    by = ["annotator", "axis", "family"]
    cell = t.groupBy(*by, "benchmark").agg(F.avg("value").alias("r"), F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return cell.groupBy(*by).agg(F.sum("n").alias("n_items"), (F.sum("s") / F.sum("n")).alias("raw_prevalence"),
                                 F.avg("r").alias("standardized_prevalence"))


# From so many permutations on, each is drawn in a task from the packed items, if these fit a broadcast.
PACKED_PERMUTATIONS = 100
PACKED_BYTES = 64  # of an item, about


def _pack_items(t: pa.Table, seed: int) -> pa.Table:
    """All items of one annotator and benchmark as one row: ids, families in the order of the homes, and each item's pattern: sums and numbers of values per axis."""
    t = t.sort_by("blinded_id")
    who, benchmark = t["annotator"][0].as_py(), t["benchmark"][0].as_py()
    # a null id takes its place, but no value: as it meets none in a join
    tails = [b"" if v is None else f"|{v}".encode() for v in t["blinded_id"].to_pylist()]
    lists = t["_values"].combine_chunks()
    item, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
    value, axis = flat.field("value"), flat.field("axis").dictionary_encode()
    used = axis.is_valid().to_numpy(zero_copy_only=False) & t["blinded_id"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)[item]
    cell = item * len(axis.dictionary) + axis.indices.fill_null(0).to_numpy()
    size = t.num_rows * len(axis.dictionary)
    parts = [np.bincount(cell[used], w[used], size).reshape(t.num_rows, -1) for w in (
        value.cast(pa.float64()).fill_null(0).to_numpy(), np.ones(len(cell)), value.is_valid().to_numpy(zero_copy_only=False).astype(float))]
    patterns, pattern = np.unique(np.hstack(parts), axis=0, return_inverse=True)
    family = t["family"].combine_chunks().dictionary_encode()
    home = family.indices.to_numpy()[KeyedOrder(tails)(f"{seed}|home|{who}|{benchmark}")]
    one = lambda v, kind: pa.array([v], kind)
    return pa.table({
        "annotator": one(who, pa.string()), "benchmark": one(benchmark, pa.string()), "tails": one(tails, pa.list_(pa.binary())),
        "home": one(home.astype("<i4").tobytes(), pa.binary()), "families": one(family.dictionary.to_pylist(), pa.list_(pa.string())),
        "axes": one(axis.dictionary.to_pylist(), pa.list_(pa.string())), "pattern": one(pattern.ravel().astype("<i4").tobytes(), pa.binary()),
        "patterns": one(np.ascontiguousarray(patterns, "<f8").tobytes(), pa.binary())})


def _permuted_counts(items: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Successes `o` of `n` values of each (annotator, axis, replicate, benchmark, family) when the values move.

    `items`: (annotator, benchmark, blinded_id, family, _values), broadcast as one row per annotator and
    benchmark. A task draws its share of the permutations and counts the values of each family in it.
    """
    keys = ["annotator", "benchmark"]
    schema = "annotator string, benchmark string, tails array<binary>, home binary, families array<string>, axes array<string>, pattern binary, patterns binary"
    packed = items.where("annotator IS NOT NULL AND benchmark IS NOT NULL").withColumn("annotator", F.col("annotator").cast("string")).withColumn(
        "benchmark", F.col("benchmark").cast("string")).groupBy(*keys).applyInArrow(lambda t: _pack_items(t, seed), schema)
    spark = items.sparkSession
    parts = min(permutations, 8 * spark.sparkContext.defaultParallelism)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, who, benchmark, tails, home, families, axes, pattern, patterns = (
                    batch.column(c)[k] for c in ("id", *keys, "tails", "home", "families", "axes", "pattern", "patterns"))
                tails, n, across = tails.values.to_pylist(), len(families), len(axes)
                home, pattern = (np.frombuffer(v.as_buffer(), "<i4") for v in (home, pattern))
                patterns = np.frombuffer(patterns.as_buffer(), "<f8").reshape(-1, 3 * across)
                met = home.astype(np.int64) * len(patterns)
                replicates = np.arange(part.as_py() + 1, permutations + 1, parts)
                got = np.empty((len(replicates), n, 3 * across))
                drawn = KeyedOrder(tails)
                for r, replicate in enumerate(replicates):
                    order = drawn(f"{seed}|{who}|{benchmark}|{replicate}")
                    got[r] = np.bincount(met + pattern[order], minlength=n * len(patterns)).reshape(n, -1) @ patterns
                o, rows, filled = (got[:, :, c * across:(c + 1) * across].ravel() for c in range(3))
                some = rows > 0
                at = np.indices((len(replicates), n, across)).reshape(3, -1)[:, some]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(who, some.sum()), axes.values.take(pa.array(at[2])), pa.array(replicates[at[0]]), pa.repeat(benchmark, some.sum()),
                     families.values.take(pa.array(at[1])), pa.array(o[some], mask=filled[some] == 0), pa.array(rows[some].astype(np.int64))],
                    ["annotator", "axis", "replicate", "benchmark", "family", "o", "n"])

    return spark.range(0, parts, 1, parts).crossJoin(F.broadcast(packed)).mapInArrow(
        draw, "annotator string, axis string, replicate bigint, benchmark string, family string, o double, n bigint")


def _permuted_cells(t: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Values of each permutation with the family whose place they take, joined row by row."""
    items = t.select("annotator", "benchmark", "blinded_id", "family").distinct()
    keys = ["annotator", "benchmark"]
    place = lambda d, key: hash_row_number(d, [k for k in (*keys, "replicate") if k in d.columns], key, "blinded_id", "_k")
    home = place(items, draw_key(seed, *keys, "blinded_id", tag="home")).select(*keys, "_k", "family")
    moved = place(replicated(items.drop("family"), permutations), draw_key(seed, *keys, "replicate", "blinded_id")).select(
        *keys, "replicate", "_k", "blinded_id")
    # an item's values of all axes travel as one row
    values = t.groupBy(*keys, "blinded_id").agg(F.collect_list(F.struct("axis", "value")).alias("_values"))
    return moved.join(sorted_join(home), [*keys, "_k"]).join(sorted_join(values), [*keys, "blinded_id"]).select(
        *keys, "replicate", "family", F.inline("_values"))


def family_direction(labels: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Permutation test of the association inside benchmarks, extreme families, q and a two-annotator signal.

    Values move between items of one benchmark; the order is shared by all axes.
    """
    t = stable_direction(labels)
    prev = t.groupBy("annotator", "axis", "benchmark").agg(F.avg("value").alias("pi"))
    obs = _association(t, ["annotator", "axis"], prev, ["annotator", "axis"])
    by = ["annotator", "axis", "replicate"]
    null = None
    if permutations >= PACKED_PERMUTATIONS:
        whole = cut(t.groupBy("annotator", "benchmark", "blinded_id", "family").agg(F.collect_list(F.struct("axis", "value")).alias("_values")))
        if small_enough(whole.count(), PACKED_BYTES):
            null = cut(_statistic(_permuted_counts(whole, permutations, seed), by, cut(prev), ["annotator", "axis"]))
    if null is None:
        null = _association(_permuted_cells(t, permutations, seed), by, prev, ["annotator", "axis"])
    null = null.withColumnRenamed("statistic", "_n")
    p = null.join(obs, ["annotator", "axis"]).groupBy("annotator", "axis").agg(
        F.round((1 + F.count_if(F.round("_n", 9) >= F.round("statistic", 9))) / (1 + F.count(F.lit(1))), 12).alias("permutation_p"))
    std = prevalence(labels)
    s = F.round("standardized_prevalence", 12)
    ext = std.groupBy("annotator", "axis").agg(
        F.min_by("family", F.struct(-s, F.col("family"))).alias("maximum_family"), F.min_by("family", F.struct(s, F.col("family"))).alias("minimum_family"),
        (F.max("standardized_prevalence") - F.min("standardized_prevalence")).alias("prevalence_range"), F.sum("n_items").alias("n_items"))
    r = bh_adjust(obs.join(p, ["annotator", "axis"]).join(ext, ["annotator", "axis"]), ["annotator"], "permutation_p", "axis").withColumnRenamed("q", "bh_q")
    both = r.groupBy("axis").agg((F.min((F.col("bh_q") <= BH_ALPHA).cast("int")) == 1).alias("_all"), F.count(F.lit(1)).alias("_c"))
    return r.join(both.select("axis", (F.col("_all") & (F.col("_c") == 2)).alias("dual_annotator_signal")), "axis")


def confirmatory_axes(binary: DataFrame) -> DataFrame:
    """Axes that replicate: same non-zero sign, q, size and benchmark count hold for both annotators."""
    d = F.round("paired_difference", 12)
    ok = (F.col("bh_q") <= BH_ALPHA) & (F.abs(d) >= MIN_DIFFERENCE) & (F.col("benchmarks_same_direction") >= MIN_BENCHMARKS)
    return binary.groupBy("axis").agg(
        F.count(F.lit(1)).alias("annotators"), F.count_if(ok).alias("qualifying"),
        F.min(F.sign(d)).alias("_a"), F.max(F.sign(d)).alias("_b")).select(
        "axis", "annotators", "qualifying",
        ((F.col("annotators") == 2) & (F.col("qualifying") == 2) & (F.col("_a") == F.col("_b")) & (F.col("_a") != 0)).alias("replicated"))


def reliability_gate(binary: DataFrame, ordinal: DataFrame) -> DataFrame:
    a = binary.agg(F.percentile("cohen_kappa", 0.5).alias("median_kappa"), F.lit(1).alias("_k"))
    b = ordinal.agg(F.percentile("spearman_r", 0.5).alias("median_rho"), F.lit(1).alias("_k"))
    return a.join(b, "_k").drop("_k").withColumn(
        "passes", (F.col("median_kappa") >= KAPPA_GATE) & (F.col("median_rho") >= RHO_GATE))


def annotation_audit(labels: DataFrame, key: DataFrame) -> DataFrame:
    """Rows, items and coverage per annotator, and pairs that cross cells."""
    total = key.select("blinded_id").distinct().count()
    per = labels.groupBy("annotator").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("blinded_id").alias("items"),
                                          F.count_if(F.col("grp").isNull()).alias("missing_keys"))
    cross = key.groupBy("benchmark", "pair_id").agg(F.countDistinct("cell").alias("c")).agg(
        F.count_if(F.col("c") != 1).alias("pair_cell_mismatches"), F.lit(1).alias("_k"))
    return per.withColumn("covered", F.col("items") == total).withColumn("_k", F.lit(1)).join(cross, "_k").drop("_k")


def direction_counts(labels: DataFrame) -> DataFrame:
    """Items per stably advantaged family."""
    return stable_direction(labels).select("benchmark", "blinded_id", "family").distinct().groupBy("family").agg(F.count(F.lit(1)).alias("items"))

