"""Family-blind spectral adjustment of one audit half.

Facts are packed to one row per item (outcomes in a frozen model order). Model
axes come from MLlib; loadings, offsets and fits run where the item rows lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip
from ..session import BROADCAST_BYTES, cut
from .blueprint import anchor_select, difficulty_cells
from .dif import fit_rows, slices, spread_effects
from .newton import loss_by_dimension, one_se_rule
from .population import calibration_mask, nested_owner_split

MAX_OFFSET = 6.0
GRAM_MODELS = 4096  # up to here the model-by-model Gram matrix (128 MB) is formed; beyond, Lanczos steps
CANDIDATE_DIMENSIONS = (1, 2, 4, 8, 16, 32, 64, 128, 256)


@dataclass
class Packed:
    """Item rows (item_id, item_group, ys, p, scale); `ys` is ordered by model id (the matrix is complete)."""

    items: DataFrame
    models: DataFrame  # model_id, family, owner
    families: list[str]
    codes: np.ndarray
    n_models: int


def pack(cells: DataFrame) -> Packed:
    """Pack (item_id, item_group, model_id, family, owner, y) of one audit half."""
    models = cells.select("model_id", "family", "owner").distinct()
    order = models.select("model_id", "family").orderBy("model_id").toPandas()["family"]  # one short string per model
    families = sorted(order.unique())
    codes = order.map({f: i for i, f in enumerate(families)}).to_numpy(dtype=np.int32)
    rows = cells.groupBy("item_id", "item_group").agg(
        F.sort_array(F.collect_list(F.struct("model_id", F.col("y").cast("tinyint").alias("y")))).alias("g"),
        F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    p = clip((F.col("s") + 0.5) / (F.col("n") + 1.0), 1e-4, 1 - 1e-4)
    items = rows.select("item_id", "item_group", F.transform("g", lambda x: x["y"]).alias("ys"), p.alias("p")).withColumn(
        "scale", F.sqrt(F.col("p") * (1.0 - F.col("p"))))
    return Packed(cut(items), models, families, codes, len(order))


def model_axes(items: DataFrame, n_models: int, dimension: int) -> np.ndarray:
    """Top right singular vectors (models x K) of the standardized outcomes of `items`, sign-fixed."""
    working = F.transform("ys", lambda y: (y - F.col("p")) / F.col("scale"))
    vectors = MLUtils.convertVectorColumnsFromML(items.select(array_to_vector(working).alias("v")), "v")
    matrix = RowMatrix(vectors, numCols=n_models)
    if n_models <= GRAM_MODELS:
        _, axes = np.linalg.eigh(matrix.computeGramianMatrix().toArray())
        axes = axes[:, ::-1][:, :dimension]
    else:
        axes = matrix.computeSVD(dimension).V.toArray()
    top = np.abs(axes).argmax(axis=0)
    return axes * np.sign(axes[top, np.arange(axes.shape[1])])


def model_tiles(n_models: int, width: int, budget: int = BROADCAST_BYTES) -> list[slice]:
    """Ranges of models whose axes fit one broadcast."""
    step = max(1, budget // (8 * max(1, width)))
    return [slice(a, min(n_models, a + step)) for a in range(0, n_models, step)]


def _working(batch: pd.DataFrame, part: slice) -> np.ndarray:
    y = np.vstack(batch["ys"].to_numpy())[:, part].astype(float)
    return (y - batch["p"].to_numpy()[:, None]) / batch["scale"].to_numpy()[:, None]


def project(items: DataFrame, axes: np.ndarray, tiles: Sequence[slice] | None = None) -> DataFrame:
    """Add `loadings` (item x K). The axes travel tile by tile, one bounded broadcast per pass."""
    spark = items.sparkSession
    tiles = tiles or model_tiles(*axes.shape)
    for k, tile in enumerate(tiles):
        held = spark.sparkContext.broadcast(axes[tile])

        def add(batches: Iterator[pd.DataFrame], tile=tile, held=held, first=k == 0) -> Iterator[pd.DataFrame]:
            for batch in batches:
                part = [_working(batch.iloc[s], tile) @ held.value for s in slices(len(batch), len(held.value))]
                new = np.vstack(part) if part else np.zeros((0, 1))
                batch["loadings"] = list(new if first else new + np.vstack(batch["loadings"].to_numpy()))
                yield batch

        base = items.drop("loadings") if k == 0 else items
        types = ", ".join(f"{c} {t}" for c, t in base.dtypes if c != "loadings")
        items = base.mapInPandas(add, f"{types}, loadings array<double>")
        if k < len(tiles) - 1:
            items = cut(items)
    return items


def _offset_tiles(items: DataFrame, axes: np.ndarray, tiles: Sequence[slice]) -> DataFrame:
    """Add the full `offsets` array per item, tile by tile, when the axes exceed one broadcast."""
    for k, tile in enumerate(tiles):
        held = items.sparkSession.sparkContext.broadcast(axes[tile])

        def extend(batches: Iterator[pd.DataFrame], held=held, first=k == 0) -> Iterator[pd.DataFrame]:
            for batch in batches:
                more = np.vstack(batch["loadings"].to_numpy()) @ held.value.T / batch["scale"].to_numpy()[:, None]
                more = np.clip(more, -MAX_OFFSET, MAX_OFFSET)
                batch["offsets"] = list(more) if first else [
                    np.concatenate([a, b]) for a, b in zip(batch["offsets"], more)]
                yield batch

        types = ", ".join(f"{c} {t}" for c, t in items.dtypes if c != "offsets")
        items = cut(items.mapInPandas(extend, f"{types}, offsets array<double>"))
    return items


def fit_dif(packed: Packed, items: DataFrame, axes: np.ndarray, penalty: float, cycles: int,
            tiles: Sequence[slice] | None = None) -> DataFrame:
    """Intercept and family effects of every item given its spectral offsets.

    Rows: (item_id, item_group, intercept, effects, loadings, offset_sd).
    """
    tiles = tiles or model_tiles(*axes.shape)
    codes, families = packed.codes, len(packed.families)
    wide = len(tiles) > 1
    source = _offset_tiles(items, axes, tiles) if wide else items
    held = None if wide else items.sparkSession.sparkContext.broadcast(axes)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in slices(len(batch), len(codes)):
                some = batch.iloc[s]
                y = np.vstack(some["ys"].to_numpy()).astype(float)
                if wide:
                    offsets = np.vstack(some["offsets"].to_numpy())
                else:
                    raw = np.vstack(some["loadings"].to_numpy()) @ held.value.T
                    offsets = np.clip(raw / some["scale"].to_numpy()[:, None], -MAX_OFFSET, MAX_OFFSET)
                item, effects = fit_rows(y, np.ones(y.shape[1]), offsets, codes, families, penalty, cycles)
                out = some[["item_id", "item_group"]].copy()
                out["intercept"], out["effects"] = np.round(item, 12), list(np.round(effects, 12))
                out["loadings"], out["offset_sd"] = some["loadings"], offsets.std(axis=1)
                out["scale"] = some["scale"]
                yield out

    return source.mapInPandas(
        fit, "item_id bigint, item_group bigint, intercept double, effects array<double>, "
             "loadings array<double>, offset_sd double, scale double")


def check_dimension(dimension: int, n_anchors: int, n_models: int) -> None:
    if not 0 < dimension < min(n_anchors, n_models):
        raise ValueError(f"dimension {dimension} needs more than {dimension} anchors and models; it is not clipped")


@dataclass
class AnchorFit:
    """Selection and weights of the last round, effects of the final refit, and the round history."""

    anchors: DataFrame   # item_id, item_group, cell, selected, weight, magnitude, intercept
    effects: DataFrame   # item_id, family, effect
    profile: DataFrame   # item_id, loadings, scale, offset_sd
    axes: np.ndarray
    packed: Packed
    rounds: list[dict]


Estimator = Callable[[Packed, DataFrame, int, int], tuple[DataFrame, np.ndarray]]


def spectral_axes(packed: Packed, chosen: DataFrame, dimension: int, turn: int) -> tuple[DataFrame, np.ndarray]:
    axes = model_axes(chosen, packed.n_models, dimension)
    return project(packed.items, axes), axes


def purify_anchors(packed: Packed, dimension: int, strata: int = 4, penalty: float = 1.0, cycles: int = 5,
                   rounds: int = 3, fraction: float = 0.5, estimator: Estimator | None = None) -> AnchorFit:
    """Alternate adjustment, residual effects and low-effect selection, then refit once.

    `estimator(packed, chosen, dimension, turn)` returns items with loadings and the
    model axes; the default is the spectral one.

    The final refit updates effects and intercepts, not selection, weights or cells.
    """
    everything = packed.items
    chosen = everything
    previous: DataFrame | None = None
    history: list[dict] = []
    n_items = n_anchors = everything.count()
    anchors = None
    for turn in range(rounds + 1):
        check_dimension(dimension, n_anchors, packed.n_models)
        adjusted, axes = (estimator or spectral_axes)(packed, chosen, dimension, turn)
        fitted = cut(fit_dif(packed, adjusted, axes, penalty, cycles))
        magnitude = F.round(F.array_max("effects") - F.array_min("effects"), 12)
        table = fitted.select("item_id", "item_group", "intercept", magnitude.alias("magnitude"))
        if turn == rounds:
            frozen = anchors.drop("magnitude", "intercept", "item_group")
            final = cut(frozen.join(table, "item_id"))
            effects = spread_effects(fitted.select("item_id", "effects"), packed.families)
            return AnchorFit(final, effects, fitted.select("item_id", "loadings", "scale", "offset_sd"), axes, packed, history)
        cells = difficulty_cells(table, "intercept", strata, [], rows=n_items)
        anchors = cut(anchor_select(cells, fraction, "magnitude", [], rows=n_items))
        now, was = F.col("selected"), F.coalesce(F.col("_was"), F.lit(False))
        before = (anchors.select("item_id", F.col("selected").alias("_was")) if previous is None
                  else previous.select("item_id", F.col("selected").alias("_was")))
        seen = anchors.join(before, "item_id", "left").agg(
            F.count_if("selected").alias("n"), F.percentile("magnitude", 0.5).alias("m"),
            F.percentile(F.when(now, F.col("magnitude")), 0.5).alias("a"),
            (F.count_if(now & was) / F.count_if(now | was)).alias("j")).first()
        n_anchors = seen["n"]
        history.append({"round": turn + 1, "dimension": dimension, "n_anchors": n_anchors, "jaccard": float(seen["j"]),
                        "median_range_all": seen["m"], "median_range_anchor": seen["a"]})
        previous = anchors
        chosen = everything.join(anchors.filter("selected").select("item_id"), "item_id", "left_semi")
    raise AssertionError("unreachable")


def nested_design(cells: DataFrame, seed: int) -> tuple[Packed, Packed, DataFrame]:
    """Packed fit models, packed held-out models (a quarter of the owners) and the item calibration mask."""
    people = cells.select("model_id", "family", "owner").distinct()
    marked = cut(nested_owner_split(people.withColumn("_all", F.lit(0)), ["_all"], seed).drop("_all"))
    side = cells.join(marked.select("model_id", "is_validation"), "model_id")
    fit = pack(side.filter("not is_validation").drop("is_validation"))
    held = pack(side.filter("is_validation").drop("is_validation"))
    if held.n_models < 4 or fit.n_models < 8:
        raise ValueError("nested owner split has too few models")
    split = calibration_mask(fit.items.select("item_id", "item_group"), "item_group", "item_id", seed)
    return fit, held, split.select("item_id", "is_calibration")


def feasible_dimensions(dimensions: Sequence[int], n_items: int, n_models: int) -> list[int]:
    feasible = sorted({int(d) for d in dimensions if 0 < d <= min(n_items, n_models)})
    if not feasible:
        raise ValueError("no candidate dimension is feasible")
    return feasible


def dimension_losses(cells: DataFrame, dimensions: Sequence[int], seed: int, ridge: float = 1.0) -> DataFrame:
    """Per validation model and dimension: mean held-out log loss.

    Coordinates of held-out models are solved on half of the items of each group
    and judged on the rest. The driver sees only K x K and K x (validation models) sums.
    """
    spark = cells.sparkSession
    fit, held, split = nested_design(cells, seed)
    feasible = feasible_dimensions(dimensions, fit.items.count(), fit.n_models)
    top = feasible[-1]
    axes = model_axes(fit.items, fit.n_models, top)
    factors = project(fit.items, axes).select("item_id", "item_group", "p", "scale", "loadings")
    rows = cut(factors.join(held.items.select("item_id", "ys"), "item_id").join(split, "item_id"))
    v = held.n_models

    def normal_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((top, top + v))
        for batch in batches:
            f = np.vstack(batch["loadings"].to_numpy())
            for s in slices(len(batch), v):
                total[:, top:] += f[s].T @ _working(batch.iloc[s], slice(None))
            total[:, :top] += f.T @ f
        yield pd.DataFrame({"k": np.repeat(np.arange(top), top + v), "j": np.tile(np.arange(top + v), top), "x": total.ravel()})

    sums = rows.filter("is_calibration").mapInPandas(normal_sums, "k int, j int, x double").groupBy("k", "j").agg(
        F.sum("x").alias("x")).toPandas()
    dense = np.zeros((top, top + v))
    dense[sums["k"], sums["j"]] = sums["x"]
    coordinates = {d: np.linalg.solve(dense[:d, :d] + ridge * np.eye(d), dense[:d, top:]) for d in feasible}
    shipped = spark.sparkContext.broadcast(coordinates)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f, p = np.vstack(batch["loadings"].to_numpy()), batch["p"].to_numpy()
            for s in slices(len(batch), v):
                y = np.vstack(batch["ys"].iloc[s].to_numpy()).astype(float)
                base = np.log(p[s] / (1 - p[s]))[:, None]
                for d, c in shipped.value.items():
                    z = base + np.clip(f[s, :d] @ c / batch["scale"].to_numpy()[s, None], -MAX_OFFSET, MAX_OFFSET)
                    loss = (np.logaddexp(0.0, z) - y * z).sum(axis=0)
                    yield pd.DataFrame({"dimension": d, "position": np.arange(v), "total": loss, "items": len(y)})

    judged = rows.filter("not is_calibration").mapInPandas(judge, "dimension int, position int, total double, items bigint")
    return judged.groupBy("dimension", "position").agg((F.sum("total") / F.sum("items")).alias("loss"))


def choose_dimension(cells: DataFrame, dimensions: Sequence[int] = CANDIDATE_DIMENSIONS, seed: int = 20260826,
                     ridge: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Loss table per dimension and the one-standard-error choice."""
    table = cut(loss_by_dimension(dimension_losses(cells, dimensions, seed, ridge), []))
    return table, one_se_rule(table.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")
