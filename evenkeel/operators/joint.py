"""Penalised joint logistic factor model, fitted by alternating Newton steps.

Each cycle is one pass over the packed item rows: items are solved given the
model coordinates, and the same pass accumulates the normal equations of the
models, which Spark sums and solves per model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import pick
from ..session import BROADCAST_BYTES, cut
from .dif import slices
from .newton import loss_by_dimension, one_se_rule
from .spectral import MAX_OFFSET, Packed, check_dimension, feasible_dimensions, model_axes, nested_design

# Fixed values of the objective: mean loss + .5 r (mean |theta|^2 + mean |a|^2) + 5e-5 mean b^2.
RIDGE = 0.01
INTERCEPT_RIDGE = 1e-4
PLATEAU = 1e-6


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


def _item_steps(y: np.ndarray, theta: np.ndarray, beta: np.ndarray, steps: int) -> np.ndarray:
    """Ridge logistic fit of rows of `beta` = (b, a) on the design (1, theta)."""
    m, k = theta.shape
    design = np.hstack([np.ones((m, 1)), theta])
    ridge = np.full(k + 1, RIDGE * m)
    ridge[0] = INTERCEPT_RIDGE * m
    for _ in range(steps):
        p = _sigmoid(beta @ design.T)
        gradient = (y - p) @ design - beta * ridge
        w = p * (1 - p)
        hessian = np.einsum("im,mj,mk->ijk", w, design, design, optimize=True) + np.diag(ridge)
        beta = beta + np.clip(np.linalg.solve(hessian, gradient[..., None])[..., 0], -2.0, 2.0)
    return beta


def _model_sums(y: np.ndarray, theta: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Per model: gradient and Hessian of its coordinates, flattened (models x (K + K^2))."""
    a = beta[:, 1:]
    p = _sigmoid(beta[:, :1] + a @ theta.T)
    gradient = (y - p).T @ a
    hessian = np.einsum("im,ij,ik->mjk", p * (1 - p), a, a, optimize=True)
    return np.hstack([gradient, hessian.reshape(len(theta), -1)])


def _loss(y: np.ndarray, theta: np.ndarray, beta: np.ndarray) -> float:
    z = beta[:, :1] + beta[:, 1:] @ theta.T
    return float((np.logaddexp(0.0, z) - y * z).sum() + 0.5 * RIDGE * len(theta) * np.square(beta[:, 1:]).sum()
                 + 0.5 * INTERCEPT_RIDGE * len(theta) * np.square(beta[:, 0]).sum())


def _pass(rows: DataFrame, theta: np.ndarray, item_steps: int) -> DataFrame:
    """One pass: kind 0 = item rows (b, a), kind 1 = partial model sums, kind 2 = partial loss."""
    if theta.nbytes > BROADCAST_BYTES:
        raise ValueError("model coordinates exceed one broadcast; lower the dimension or the owner cap")
    held = rows.sparkSession.sparkContext.broadcast(theta)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = held.value
        sums, loss = np.zeros((len(t), t.shape[1] * (1 + t.shape[1]))), 0.0
        for batch in batches:
            for s in slices(len(batch), len(t) * (1 + t.shape[1])):
                part = batch.iloc[s]
                y = np.vstack(part["ys"].to_numpy()).astype(float)
                beta = np.vstack(part["beta"].to_numpy())
                if item_steps:
                    beta = _item_steps(y, t, beta, item_steps)
                sums += _model_sums(y, t, beta)
                loss += _loss(y, t, beta)
                yield pd.DataFrame({"kind": 0, "id": part["item_id"], "v": list(beta)})
        yield pd.DataFrame({"kind": 1, "id": np.arange(len(t)), "v": list(sums)})
        yield pd.DataFrame({"kind": 2, "id": [0], "v": [np.array([loss])]})

    return cut(rows.mapInPandas(run, "kind int, id bigint, v array<double>"))


def _solve_models(out: DataFrame, theta: np.ndarray, n_items: int) -> np.ndarray:
    """Newton step of every model from its summed equations; solved where the sums land."""
    m, k = theta.shape
    cells = out.filter("kind = 1").select("id", F.posexplode("v").alias("j", "x")).groupBy("id", "j").agg(F.sum("x").alias("x"))
    packed = cells.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("j", "x"))).alias("g")).select(
        "id", F.transform("g", lambda q: q["x"]).alias("x"))
    old = out.sparkSession.sparkContext.broadcast(theta)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, t = np.vstack(batch["x"].to_numpy()), old.value[batch["id"].to_numpy()]
            gradient = x[:, :k] - RIDGE * n_items * t
            hessian = x[:, k:].reshape(-1, k, k) + RIDGE * n_items * np.eye(k)
            move = np.clip(np.linalg.solve(hessian, gradient[..., None])[..., 0], -2.0, 2.0)
            yield pd.DataFrame({"id": batch["id"], "t": list(t + move)})

    rows = packed.mapInPandas(solve, "id bigint, t array<double>").toPandas()  # models x K, as broadcast above
    new = np.zeros((m, k))
    new[rows["id"]] = np.vstack(rows["t"].to_numpy())
    return new


def _starts(packed: Packed, items: DataFrame, k: int, seed: int) -> list[np.ndarray]:
    """Spectral axes on a unit scale, and small keyed draws."""
    spectral = model_axes(items, packed.n_models, k) * np.sqrt(packed.n_models)
    draw = lambda j: (pick(seed, F.lit(2001), "model_id", F.lit(j)) / 1000.0 - 1.0)
    rows = packed.models.select("model_id", F.array(*[draw(j) for j in range(k)]).alias("t")).orderBy("model_id").toPandas()
    return [spectral, np.vstack(rows["t"].to_numpy()) * 0.1 / k ** 0.25]


def fit_joint(packed: Packed, items: DataFrame, k: int, seed: int, cycles: int = 15,
              starts: int = 2) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """Best of the starts: item rows (item_id, beta), model coordinates and the objective history."""
    n_items = items.count()
    best = None
    history: list[dict] = []
    for which, theta in enumerate(_starts(packed, items, k, seed)[:starts]):
        start = F.array(F.log(F.col("p") / (1 - F.col("p"))), *[F.lit(0.0)] * k)
        rows = items.select("item_id", "ys", start.alias("beta"))
        last = np.inf
        for cycle in range(cycles):
            out = _pass(rows, theta, 2)
            fitted = out.filter("kind = 0").select(F.col("id").alias("item_id"), F.col("v").alias("beta"))
            loss = out.filter("kind = 2").agg(F.sum(F.col("v")[0]).alias("l")).first()["l"]
            value = loss / (n_items * packed.n_models) + 0.5 * RIDGE * float(np.square(theta).sum(axis=1).mean())
            history.append({"start": which, "cycle": cycle, "objective": value})
            if best is None or value < best[0]:
                best = (value, fitted, theta)
            if abs(last - value) < PLATEAU:
                break
            last = value
            theta = _solve_models(out, theta, n_items)
            rows = items.select("item_id", "ys").join(fitted, "item_id")
    return best[1], best[2], history


def fit_coordinates(rows: DataFrame, k: int, n_models: int, steps: int = 6) -> np.ndarray:
    """Coordinates of new models with items fixed; `rows` holds (item_id, ys, beta)."""
    n_items = rows.count()
    theta = np.zeros((n_models, k))
    for _ in range(steps):
        theta = _solve_models(_pass(rows, theta, 0), theta, n_items)
    return theta


def joint_dimension(cells: DataFrame, dimensions: Sequence[int], seed: int, cycles: int = 8) -> tuple[DataFrame, DataFrame]:
    """Dimension choice with the joint estimator; same splits and rule as the spectral one."""
    fit, held, split = nested_design(cells, seed)
    parts = []
    for k in feasible_dimensions(dimensions, fit.items.count(), fit.n_models):
        beta, _, _ = fit_joint(fit, fit.items, k, seed, cycles, starts=1)
        rows = cut(held.items.select("item_id", "ys").join(beta, "item_id").join(split, "item_id"))
        theta = fit_coordinates(rows.filter("is_calibration").drop("is_calibration"), k, held.n_models)
        shipped = cells.sparkSession.sparkContext.broadcast(theta)

        def judge(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            for batch in batches:
                y, b = np.vstack(batch["ys"].to_numpy()).astype(float), np.vstack(batch["beta"].to_numpy())
                z = b[:, :1] + b[:, 1:] @ shipped.value.T
                yield pd.DataFrame({"position": np.arange(z.shape[1]), "total": (np.logaddexp(0.0, z) - y * z).sum(axis=0),
                                    "items": len(y)})

        judged = rows.filter("not is_calibration").mapInPandas(judge, "position int, total double, items bigint")
        parts.append(judged.groupBy("position").agg((F.sum("total") / F.sum("items")).alias("loss")).withColumn(
            "dimension", F.lit(k)))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    table = cut(loss_by_dimension(union, []))
    return table, one_se_rule(table.withColumn("_all", F.lit(0)), ["_all"]).drop("_all")


def joint_offsets(packed: Packed, anchors: DataFrame, k: int, seed: int, cycles: int = 8) -> tuple[DataFrame, np.ndarray]:
    """Axes from the anchors, then every item given the centred axes: rows (item_id, beta, offset_range)."""
    chosen = packed.items.join(anchors.filter("selected").select("item_id"), "item_id", "left_semi")
    check_dimension(k, chosen.count(), packed.n_models)
    _, theta, _ = fit_joint(packed, chosen, k, seed, cycles, starts=1)
    theta = theta - theta.mean(axis=0)
    start = F.array(F.log(F.col("p") / (1 - F.col("p"))), *[F.lit(0.0)] * k)
    out = _pass(packed.items.select("item_id", "ys", start.alias("beta")), theta, 8)
    held = packed.items.sparkSession.sparkContext.broadcast(theta)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            z = np.clip(np.vstack(batch["beta"].to_numpy())[:, 1:] @ held.value.T, -MAX_OFFSET, MAX_OFFSET)
            yield batch.assign(offset_sd=z.std(axis=1), offset_max=np.abs(z).max(axis=1))

    rows = out.filter("kind = 0").select(F.col("id").alias("item_id"), F.col("v").alias("beta"))
    return rows.mapInPandas(spread, "item_id bigint, beta array<double>, offset_sd double, offset_max double"), theta


def joint_estimator(seed: int, cycles: int = 8):
    """Adjustment step for `purify_anchors`: joint axes from the anchors, loadings of every item given them."""
    def adjust(packed: Packed, chosen: DataFrame, k: int, turn: int) -> tuple[DataFrame, np.ndarray]:
        rows, theta = joint_offsets(packed, chosen.select("item_id", F.lit(True).alias("selected")), k, seed + turn, cycles)
        a = rows.select("item_id", F.slice("beta", 2, k).alias("loadings"))
        return packed.items.withColumn("scale", F.lit(1.0)).join(a, "item_id"), theta

    return adjust
