"""Hand-made cases with known answers, and brute force on small tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.functions import inference
from evenkeel.functions.ranks import hash_row_number, value_row_number
from evenkeel.functions.exprs import draw_key
from evenkeel.operators import blueprint, matching, pairs, population, predict, resampling, scoring, summaries


def test_bh_adjust(spark):
    df = spark.createDataFrame([("a", 1, 0.01), ("a", 2, 0.04), ("a", 3, 0.03)], "g string, id int, p double")
    got = {r["id"]: round(r["q"], 10) for r in inference.bh_adjust(df, ["g"], "p", "id").collect()}
    assert got == {1: 0.03, 2: 0.04, 3: 0.04}


def test_binomial_and_wilcoxon_edges(spark):
    t = spark.range(1).select(
        inference.binomial_greater(F.lit(3), F.lit(4)).alias("g"), inference.binomial_two_sided(F.lit(0), F.lit(0)).alias("z"),
        inference.binomial_two_sided(F.lit(1), F.lit(4)).alias("t")).first()
    assert t["g"] == pytest.approx(5 / 16) and t["z"] == 1.0 and t["t"] == pytest.approx(10 / 16)
    zeros = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("b", 1.0), ("b", 2.0)], "g string, d double")
    got = {r["g"]: r for r in inference.wilcoxon(zeros, ["g"], "d").collect()}
    assert got["a"]["p"] == 1.0 and got["b"]["n"] == 2 and got["b"]["statistic"] == 0.0


def brute_pairs(rows, gap):
    out = dict.fromkeys(["all", "cross", "near", "same"], 0)
    flips = dict(out)
    for p, q in itertools.combinations(rows, 2):
        dx, dy = round(p[3] - q[3], 12), round(p[4] - q[4], 12)
        if p[2] == q[2] or dx == 0 or dy == 0:
            continue
        kinds = ["all"] + (["cross"] if p[1] != q[1] else [])
        if abs(dx) <= gap:
            kinds.append("near" if p[1] != q[1] else "same")
        for k in kinds:
            out[k] += 1
            flips[k] += dx * dy < 0
    return out, flips


@pytest.mark.parametrize("seed,hot", [(0, False), (1, True)])
def test_pair_counts_match_brute_force(spark, seed, hot):
    rng = np.random.default_rng(seed)
    n = 70
    rows = [(i, f"f{rng.integers(4)}", 0 if hot and i % 3 == 0 else int(rng.integers(9)),
             0.1 if hot and i % 3 == 1 else float(rng.integers(0, 60) / 200), float(rng.integers(0, 80) / 100)) for i in range(n)]
    df = spark.createDataFrame([("h", *r) for r in rows], "half string, model_id long, family string, owner int, full_score double, low_score double")
    got = pairs.pairwise_reversals(df).first()
    want, flips = brute_pairs(rows, 0.01)
    for name, k in (("all", "all"), ("cross_family", "cross"), ("close_cross_family", "near"), ("close_same_family", "same")):
        assert (got[f"{name}_pairs"], got[f"{name}_flips"]) == (want[k], flips[k])
    curve = {r["gap"]: (r["pairs"], r["flips"]) for r in pairs.gap_curve(df, [0.005, 0.02]).collect()}
    for g in (0.005, 0.02):
        w, f = brute_pairs(rows, g)
        assert curve.get(g, (0, 0)) == (w["near"], f["near"])
    listed = pairs.near_pairs(df, 0.01).count()
    x = [(p, q) for p, q in itertools.combinations(rows, 2) if p[1] != q[1] and p[2] != q[2] and abs(round(p[3] - q[3], 12)) <= 0.01]
    assert listed == len(x)


def test_pooling_counts_not_rates(spark):
    obs = spark.createDataFrame([("b", 2, 2), ("b", 8, 0)], "benchmark string, close_cross_family_pairs long, close_cross_family_flips long")
    ctl = spark.createDataFrame([("b", 1, 10, 0), ("b", 1, 10, 2), ("b", 2, 10, 1), ("b", 2, 10, 1), ("b", 3, 10, 2), ("b", 3, 10, 2)],
                                "benchmark string, replicate long, close_cross_family_pairs long, close_cross_family_flips long")
    r = summaries.reversal_summary(obs, ctl, ["benchmark"]).first()
    assert r["low_dif_reversal_rate"] == pytest.approx(0.2) and r["random_median_rate"] == pytest.approx(0.1) and r["p"] == pytest.approx(0.5)
    none = summaries.reversal_summary(obs.withColumn("close_cross_family_pairs", F.lit(0)), ctl, ["benchmark"]).first()
    assert none["status"] == "insufficient_eligible_pairs" and none["p"] is None
    undefined = ctl.withColumn("close_cross_family_pairs", F.when(F.col("replicate") == 1, 0).otherwise(F.col("close_cross_family_pairs")))
    r = summaries.reversal_summary(obs, undefined, ["benchmark"]).first()
    assert r["status"] == "undefined_random_controls" and r["excess_pp"] is None


def test_specificity_excess(spark):
    cols = "benchmark string, replicate long, close_cross_family_pairs long, close_cross_family_flips long, close_same_family_pairs long, close_same_family_flips long"
    obs = spark.createDataFrame([("b", 0, 10, 5, 10, 2)], cols)
    ctl = spark.createDataFrame([("b", 1, 10, 3, 10, 2)], cols)
    r = summaries.within_family_summary(obs, ctl, ["benchmark"]).first()
    assert r["specificity_excess_points"] == pytest.approx(20.0) and r["specificity_p"] == pytest.approx(0.5)


def test_anchor_weights_restore_mass(spark):
    rows = [("h", i, "a" if i < 3 else "b", float(i % 3)) for i in range(6)]
    t = blueprint.anchor_select(spark.createDataFrame(rows, "half string, item_id long, cell string, magnitude double"), 2 / 3)
    got = t.groupBy("cell").agg(F.count_if("selected").alias("k"), F.sum("weight").alias("w")).collect()
    assert sum(r["k"] for r in got) == 4 and all(r["w"] == pytest.approx(3.0) for r in got)


def test_buckets_equal_plain_window(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), F.col("id").alias("item_id"),
                                  F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.pmod(F.xxhash64("id"), F.lit(997)) / 997.0).alias("v"))
    a = value_row_number(df, ["k"], "v", "item_id").select("item_id", "rn", "rn_of")
    b = value_row_number(df, ["k"], "v", "item_id", rows=5000).select("item_id", "rn", "rn_of")
    assert a.exceptAll(b).count() == 0 and b.count() == 5000
    h = hash_row_number(df, ["k"], draw_key(1, "item_id"), "item_id")
    assert h.select("rn").distinct().count() == 5000 and h.agg(F.max("rn")).first()[0] == 5000


def test_replicate_scores_match_join(spark):
    rng = np.random.default_rng(3)
    cells = spark.createDataFrame([("h", i, m, int(rng.integers(2))) for i in range(30) for m in range(12)], "half string, item_id long, model_id long, y int")
    weights = spark.createDataFrame([("h", r, i, float(1 + i % 3)) for r in (1, 2) for i in range(30) if (i + r) % 2], "half string, replicate long, item_id long, weight double")
    fast = scoring.replicate_scores(cells, weights, ["half"], n_models=10 ** 7).select("replicate", "model_id", "score")
    plain = cells.join(weights, ["half", "item_id"]).groupBy("replicate", "model_id").agg(
        F.round(F.sum(F.col("weight") * F.col("y")) / F.sum("weight"), 12).alias("score"))
    assert fast.exceptAll(plain).count() == 0 and fast.count() == 24


def test_matched_random_counts(spark):
    rows = [("h", i, f"c{i % 4}", i % 3 == 0) for i in range(48)]
    anchors = spark.createDataFrame(rows, "half string, item_id long, cell string, selected boolean")
    w = blueprint.matched_random_weights(anchors, 5, 9)
    v = blueprint.weight_invariants(w, anchors).collect()
    assert len(v) == 5 and all(r["cell_count"] == 0 and r["cell_mass"] == 0 and r["total_mass"] == 48.0 for r in v)
    again = blueprint.matched_random_weights(anchors.repartition(7), 5, 9)
    assert w.exceptAll(again).count() == 0


def test_permutation_keeps_groups(spark):
    df = spark.createDataFrame([(f"c{i % 3}", i, float(i)) for i in range(30)], "cell string, item_id long, v double")
    p = resampling.permute_within(df, ["cell"], "item_id", ["v"], 3, 5)
    assert p.count() == 90 and p.filter(F.pmod(F.col("v").cast("int"), F.lit(3)) != F.substring("cell", 2, 1).cast("int")).count() == 0
    assert p.groupBy("replicate").agg(F.countDistinct("v").alias("d")).filter("d <> 30").count() == 0


def test_ridge_paths_agree(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 6))
    y = x @ rng.normal(size=(6, 2)) + 0.1 * rng.normal(size=(60, 2)) + 3.0
    rows = spark.createDataFrame([(i, 0, list(range(6)), [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(60)],
                                 "item_id long, fold long, idx array<long>, val array<double>, y array<double>")
    direct = predict.solve_ridge(sum(predict.normal_equations(rows, 6, 2).values()), 2.0)
    stepwise = predict.ridge_gradients(rows, 6, 2, 2.0, tolerance=1e-10)
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(6), xc.T @ yc)
    assert np.allclose(direct[1:], want, atol=1e-8) and np.allclose(stepwise, direct, atol=1e-6)


def test_threshold_and_auc(spark):
    rng = np.random.default_rng(2)
    z = np.round(rng.normal(size=300), 2)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * z))).astype(int)
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(z, y)], "g string, z double, y int")
    grid = np.unique(np.quantile(z, [round(k / 100, 2) for k in range(1, 100)]))
    ba = [0.5 * ((z[y == 1] >= t).mean() + (z[y == 0] < t).mean()) for t in grid]
    got = predict.choose_threshold(df, ["g"], "z").first()
    assert got["balanced_accuracy"] == pytest.approx(max(ba)) and got["threshold"] == pytest.approx(grid[int(np.argmax(np.round(ba, 12)))])
    wins = (z[y == 1][:, None] > z[y == 0][None, :]).mean() + 0.5 * (z[y == 1][:, None] == z[y == 0][None, :]).mean()
    assert predict.auc(df, ["g"], "z").first()["auc"] == pytest.approx(wins)


def test_balanced_split_is_owner_pure_and_balanced(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"f{i % 3}", int(rng.integers(40)), float(rng.random())) for i in range(400)]
    people = spark.createDataFrame(rows, "model_id long, family string, owner int, acc double")
    split = population.balanced_owner_split(people, 3)
    assert split.groupBy("owner").agg(F.countDistinct("half").alias("h")).filter("h > 1").count() == 0
    per = split.groupBy("family").pivot("half", ["discovery", "validation"]).count().collect()
    assert all(abs(r["discovery"] - r["validation"]) <= 12 for r in per)
    assert split.exceptAll(population.balanced_owner_split(people.repartition(3), 3)).count() == 0


def test_audit_settings_are_checked():
    from evenkeel.plans.audit import AuditConfig

    AuditConfig().check()
    with pytest.raises(ValueError, match="anchor_fraction=1.5.*resamples=0"):
        AuditConfig(anchor_fraction=1.5, resamples=0).check()
    for bad in ({"dimensions": ()}, {"owner_cap": -1}, {"gap_pp": float("nan")}, {"dif_cycles": 0}):
        with pytest.raises(ValueError):
            AuditConfig(**bad).check()


def test_matching_blocks_equal_the_standard_library():
    import random
    from difflib import SequenceMatcher

    from evenkeel.operators.blocks import matched

    r = random.Random(4)
    for k in range(400):
        letters = "ab" if k % 2 else "the quick brown é"
        a, b = ("".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(2))
        if k % 5 == 0:
            b = a[: r.randint(0, 30)] + b + a[r.randint(0, 30) :]
        want = SequenceMatcher(None, a, b, autojunk=False)
        assert matched(a, b) == sum(m.size for m in want.get_matching_blocks()), (a, b)
    assert matched("ab" * 2_000, "ab" * 2_000) == 4_000


def test_signed_rank_tails_are_exact(spark):
    for n in (1, 4, 9):
        sums = [sum(k + 1 for k in range(n) if bits >> k & 1) for bits in range(1 << n)]
        df = spark.createDataFrame([(n, float(w)) for w in range(n * (n + 1) // 2 + 1)], "n long, w double")
        for row in df.select("w", inference.signed_rank_tail(F.col("n"), F.col("w")).alias("p")).collect():
            assert row.p == pytest.approx(sum(s <= row.w for s in sums) / len(sums))
    d = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 4.0, 5.0)] + [(2, 1.0), (2, 1.0), (3, 0.0), (3, 1.0)], "g long, d double")
    got = {r.g: r.p for r in inference.wilcoxon(d, ["g"], "d").collect()}
    assert got[1] == pytest.approx(2 / 32) and got[2] != pytest.approx(0.5) and got[3] != 1.0


def test_strata_get_exactly_the_total(spark):
    for sizes, fraction in (([7, 3, 2], 0.7), ([1] * 9, 0.5), ([12_032 - 31, 30, 1], 0.7), ([5], 0.2)):
        df = spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "s string, n long")
        got = {r.s: r.share for r in population.apportion(df, "s", fraction).collect()}
        total = sum(sizes) - -(-round((1 - fraction) * sum(sizes) * 10**6) // 10**6)
        assert sum(got.values()) == total and all(abs(got[f"s{k}"] - total * n / sum(sizes)) < 1 for k, n in enumerate(sizes))
    assert sum(r.share for r in population.apportion(spark.createDataFrame([("a", 12_000), ("b", 32)], "s string, n long"), "s", 0.7).collect()) == 8_422
