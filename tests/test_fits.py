"""Recovery, leakage and equality of the two broadcast paths."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.operators import dif, newton, spectral
from evenkeel.plans.audit import AuditConfig, prepare_population


def simulate(spark, items=120, models=90, families=3, seed=0):
    rng = np.random.default_rng(seed)
    b, theta = rng.normal(size=items), rng.normal(size=models)
    effect = rng.normal(scale=0.8, size=(items, families))
    effect -= effect.mean(axis=1, keepdims=True)
    code = np.arange(models) % families
    y = rng.random((items, models)) < 1 / (1 + np.exp(-(b[:, None] + theta[None, :] + effect[:, code])))
    rows = [(i, i % 4, m, f"f{code[m]}", m // 3, int(y[i, m])) for i in range(items) for m in range(models)]
    return spark.createDataFrame(rows, "item_id long, item_group long, model_id long, family string, owner long, y int"), effect, theta


def test_rasch_and_family_effects_recover(spark):
    cells, effect, theta = simulate(spark)
    keyed = cells.withColumn("half", F.lit("h"))
    ability, _ = newton.fit_rasch(keyed, ["half"])
    a = ability.orderBy("model_id").toPandas()["ability"].to_numpy()
    assert np.corrcoef(a, theta)[0, 1] > 0.85 and abs(a.mean()) < 1e-9
    e = dif.fit_family_dif(keyed, ability, ["half"]).orderBy("item_id", "family").toPandas()
    got = e["effect"].to_numpy().reshape(-1, 3)
    assert np.abs(got.sum(axis=1)).max() < 1e-9
    assert np.mean([np.corrcoef(got[:, f], effect[:, f])[0, 1] for f in range(3)]) > 0.45


def test_intercepts_solve_their_equations(spark):
    cells, _, theta = simulate(spark, items=40)
    t = spark.createDataFrame([(m, float(v)) for m, v in enumerate(theta)], "model_id long, offset double")
    joined = cells.join(t, "model_id")
    fit = newton.fit_item_intercepts(joined, ["item_id"])
    gap = joined.join(fit, "item_id").groupBy("item_id").agg(
        F.abs(F.sum("y") - F.sum(1 / (1 + F.exp(-(F.col("intercept") + F.col("offset")))))).alias("g"))
    assert gap.agg(F.max("g")).first()[0] < 1e-6


def test_axes_in_tiles_equal_one_broadcast(spark):
    cells, _, _ = simulate(spark, items=60, models=45)
    packed = spectral.pack(cells)
    axes = spectral.model_axes(packed.items, packed.n_models, 3)
    assert np.allclose(axes.T @ axes, np.eye(3), atol=1e-9)
    tiles = [slice(0, 20), slice(20, 45)]
    order = lambda t: np.vstack(t.orderBy("item_id").toPandas()["effects"].to_numpy())
    one = order(spectral.fit_dif(packed, spectral.project(packed.items, axes), axes, 1.0, 5))
    two = order(spectral.fit_dif(packed, spectral.project(packed.items, axes, tiles), axes, 1.0, 5, tiles))
    assert np.abs(one - two).max() < 1e-9


def test_purification_keeps_mass_and_ignores_other_half(spark):
    cells, _, _ = simulate(spark, items=64, models=60)
    own, other = cells.filter("owner % 2 = 0"), cells.filter("owner % 2 = 1")
    fit = spectral.purify_anchors(spectral.pack(own), 2, rounds=2)
    mass = fit.anchors.groupBy("cell").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).filter("abs(w - n) > 1e-9")
    assert mass.count() == 0 and len(fit.rounds) == 2
    flipped = own.unionByName(other.withColumn("y", 1 - F.col("y"))).filter("owner % 2 = 0")
    again = spectral.purify_anchors(spectral.pack(flipped), 2, rounds=2)
    cols = ["item_id", "cell", "selected", "weight"]
    assert fit.anchors.select(cols).exceptAll(again.anchors.select(cols)).count() == 0
    with pytest.raises(ValueError):
        spectral.purify_anchors(spectral.pack(own), 64)


def test_bad_settings_and_populations_are_refused(spark):
    with pytest.raises(ValueError):
        AuditConfig(anchor_fraction=1.0).check()
    with pytest.raises(ValueError):
        AuditConfig(dimensions=()).check()
    cells, _, _ = simulate(spark, items=20, models=30)
    with pytest.raises(ValueError):
        prepare_population(cells, AuditConfig(min_family_models=1000))


def test_rasch_keeps_one_row_each_with_missing_cells(spark):
    """Equal totals over different numbers of items are different levels; no row is doubled."""
    rows = [(m, i, int((m * 7 + i * 3) % 5 < 2 + m % 2)) for m in range(6) for i in range(8) if m % 3 or i < 5]
    totals = {(m, sum(y for k, _, y in rows if k == m), sum(k == m for k, _, _ in rows)) for m in range(6)}
    assert len({t for _, t, _ in totals}) < len({(t, w) for _, t, w in totals})
    cells = spark.createDataFrame(rows, "model_id long, item_id long, y int").withColumn("k", F.lit("x"))
    ability, intercept = newton.fit_rasch(cells, ["k"])
    assert sorted(r["model_id"] for r in ability.collect()) == list(range(6))
    assert sorted(r["item_id"] for r in intercept.collect()) == list(range(8))
