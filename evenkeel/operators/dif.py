"""Item-by-family effects: many small penalised logistic fits, one per item.

Spark packs each item's outcomes into one row and spreads the rows; a task fits
its rows in bounded slices. Items do not depend on each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_CELLS = 2_000_000  # cells per dense slice inside a task
TOLERANCE = 1e-8


def _solve_rows(s: np.ndarray, n: np.ndarray, base: np.ndarray, b: np.ndarray, penalty: float) -> np.ndarray:
    """Clipped Newton for one shift per row; sum over columns of n sigmoid(base + b) matches s."""
    total = s.sum(axis=1)
    b = b.copy()
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-(base + b[:, None])))
        info = (n * p * (1.0 - p)).sum(axis=1) + (penalty or 1e-9)
        move = np.clip((total - (n * p).sum(axis=1) - penalty * b) / info, -2.0, 2.0)
        b += move
        if np.abs(move).max() < TOLERANCE:
            break
    return b


def fit_rows(s: np.ndarray, n: np.ndarray, offsets: np.ndarray, codes: np.ndarray, families: int,
             penalty: float, cycles: int, margin: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and sum-zero family effects of a slice of items; the centre moves into the intercept."""
    weight = np.broadcast_to(n, s.shape)
    mean = np.clip(s.sum(axis=1) / weight.sum(axis=1), margin, 1 - margin)
    item = np.log(mean / (1 - mean)) - (offsets * weight).sum(axis=1) / weight.sum(axis=1)
    item = _solve_rows(s, weight, offsets, item, 0.0)
    effects = np.zeros((len(s), families))
    members = [np.flatnonzero(codes == f) for f in range(families)]
    for _ in range(cycles):
        item = _solve_rows(s, weight, offsets + effects[:, codes], item, 0.0)
        before = effects.copy()
        for f, at in enumerate(members):
            effects[:, f] = _solve_rows(s[:, at], weight[:, at], offsets[:, at] + item[:, None], effects[:, f], penalty)
        center = effects.mean(axis=1)
        effects -= center[:, None]
        item = item + center
        if np.abs(effects - before).max() < TOLERANCE:
            break
    return item, effects


def slices(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, SLICE_CELLS // max(1, columns))
    for start in range(0, rows, step):
        yield slice(start, min(rows, start + step))


def fit_family_dif(cells: DataFrame, abilities: DataFrame, keys: Sequence[str], penalty: float = 1.0,
                   cycles: int = 5) -> DataFrame:
    """Effects given scalar abilities: rows (keys, item_id, intercept, family, effect).

    Models that share family and ability are one column with a count, so each item
    is reduced to its (family, ability) grid on the map side. The grid itself is
    one row per distinct (family, ability) and is shipped once.
    """
    keys = list(keys)
    members = cells.select(*keys, "model_id", "family").distinct().join(abilities, [*keys, "model_id"]).withColumn(
        "_a", F.round("ability", 12))
    grid_rows = members.groupBy(*keys, "family", "_a").agg(F.count(F.lit(1)).alias("n")).orderBy(*keys, "family", "_a").collect()
    names = sorted({r["family"] for r in grid_rows})
    grids: dict[tuple, list] = {}
    for r in grid_rows:
        grids.setdefault(tuple(r[k] for k in keys), []).append((names.index(r["family"]), r["_a"], float(r["n"])))
    grids = {k: np.array(v) for k, v in grids.items()}
    packed = (
        cells.join(members.select(*keys, "model_id", "_a"), [*keys, "model_id"])
        .groupBy(*keys, "item_id", "family", "_a").agg(F.sum("y").cast("double").alias("s"))
        .groupBy(*keys, "item_id").agg(F.sort_array(F.collect_list(F.struct("family", "_a", "s"))).alias("g"))
        .select(*keys, "item_id", F.transform("g", lambda x: x["s"]).alias("s")))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in (batch.groupby(keys, sort=False) if keys else [((), batch)]):
                grid = grids[tuple(key)]
                codes = grid[:, 0].astype(int)
                for part in slices(len(rows), len(grid)):
                    some = rows.iloc[part]
                    s = np.vstack(some["s"].to_numpy())
                    offsets = np.broadcast_to(grid[:, 1], s.shape)
                    item, effects = fit_rows(s, grid[:, 2], offsets, codes, len(names), penalty, cycles, 1e-3)
                    out = some[[*keys, "item_id"]].copy()
                    out["intercept"] = item
                    out["effects"] = list(effects)
                    yield out

    types = "".join(f"{k} {cells.schema[k].dataType.simpleString()}, " for k in keys)
    fitted = packed.mapInPandas(fit, f"{types}item_id bigint, intercept double, effects array<double>")
    return spread_effects(fitted, names)


def spread_effects(fitted: DataFrame, families: Sequence[str]) -> DataFrame:
    """Effect arrays, ordered as `families`, to one row per family."""
    rest = [c for c in fitted.columns if c != "effects"]
    names = F.array(*[F.lit(f) for f in families])
    return fitted.select(*rest, F.posexplode("effects").alias("_pos", "effect")).select(
        *rest, F.element_at(names, F.col("_pos") + 1).alias("family"), "effect")
