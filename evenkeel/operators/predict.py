"""Ridge predictions on sparse features and the metrics that judge predictors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bernoulli_loss, ratio, sigmoid
from ..functions.inference import wilcoxon
from ..functions.ranks import spearman

DENSE_FEATURES = 512  # up to here one pass forms the normal equations; beyond, conjugate gradients


def pack_rows(features: DataFrame, targets: DataFrame) -> DataFrame:
    """(item_id, idx, val, y, rest of targets): sparse rows joined with the target arrays."""
    rows = features.groupBy("item_id").agg(
        F.collect_list("index").alias("idx"), F.collect_list("value").alias("val"))
    return targets.join(rows, "item_id", "left").withColumn("idx", F.coalesce("idx", F.array().cast("array<bigint>"))).withColumn(
        "val", F.coalesce("val", F.array().cast("array<double>")))


def _dense(batch: pd.DataFrame, width: int) -> np.ndarray:
    """Rows with a leading one for the intercept."""
    x = np.zeros((len(batch), width + 1))
    x[:, 0] = 1.0
    at = np.repeat(np.arange(len(batch)), batch["idx"].map(len))
    if len(at):
        x[at, np.concatenate(batch["idx"].to_numpy()).astype(int) + 1] = np.concatenate(batch["val"].to_numpy())
    return x


def normal_equations(rows: DataFrame, width: int, n_targets: int) -> dict[int, np.ndarray]:
    """Per fold: (1+P) x (1+P+T) sums. One pass; partial sums are combined by Spark."""
    size = (width + 1, width + 1 + n_targets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, len(batch), 1024):
                for fold, part in batch.iloc[start:start + 1024].groupby("fold"):
                    x = _dense(part, width)
                    both = np.hstack([x, np.vstack(part["y"].to_numpy())])
                    total[fold] = total.get(fold, np.zeros(size)) + x.T @ both
        for fold, t in total.items():
            i, j = np.nonzero(t)
            yield pd.DataFrame({"fold": fold, "i": i, "j": j, "x": t[i, j]})

    sums = rows.mapInPandas(run, "fold bigint, i int, j int, x double").groupBy("fold", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for fold, part in sums.groupby("fold"):
        out[int(fold)] = np.zeros(size)
        out[int(fold)][part["i"], part["j"]] = part["x"]
    return out


def solve_ridge(sums: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients (1+P) x T; the intercept is not penalised."""
    p = len(sums)
    return np.linalg.solve(sums[:, :p] + alpha * np.diag(np.r_[0.0, np.ones(p - 1)]) + 1e-12 * np.eye(p), sums[:, p:])


def ridge_gradients(rows: DataFrame, width: int, n_targets: int, alpha: float, tolerance: float = 1e-6,
                    steps: int = 100) -> np.ndarray:
    """The same fit for wide features by conjugate gradients: one pass per step, vectors of P x T only."""
    sc = rows.sparkSession.sparkContext

    def product(vector: np.ndarray | None) -> np.ndarray:
        held = sc.broadcast(vector)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width + 1, n_targets))
            for batch in batches:
                at = np.repeat(np.arange(len(batch)), batch["idx"].map(len) + 1)
                idx = np.concatenate([np.r_[0, np.asarray(i, dtype=int) + 1] for i in batch["idx"]])
                val = np.concatenate([np.r_[1.0, v] for v in batch["val"]])
                if held.value is None:
                    right = np.vstack(batch["y"].to_numpy())
                else:
                    right = np.zeros((len(batch), n_targets))
                    np.add.at(right, at, val[:, None] * held.value[idx])
                np.add.at(total, idx, val[:, None] * right[at])
            i, j = np.nonzero(total)
            yield pd.DataFrame({"i": i, "j": j, "x": total[i, j]})

        s = rows.mapInPandas(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
        out = np.zeros((width + 1, n_targets))
        out[s["i"], s["j"]] = s["x"]
        return out

    ridge = np.r_[0.0, np.full(width, alpha)][:, None]
    w = np.zeros((width + 1, n_targets))
    r = product(None)
    stop = tolerance * np.sqrt((r * r).sum(axis=0))
    d, rr = r.copy(), (r * r).sum(axis=0)
    for _ in range(steps):
        if (np.sqrt(rr) <= stop).all():
            break
        q = product(d) + ridge * d
        step = rr / np.maximum((d * q).sum(axis=0), 1e-300)
        w, r = w + step * d, r - step * q
        new = (r * r).sum(axis=0)
        d, rr = r + new / np.maximum(rr, 1e-300) * d, new
    return w


def ridge_fit(rows: DataFrame, width: int, n_targets: int, alpha: float) -> np.ndarray:
    if width <= DENSE_FEATURES:
        return solve_ridge(sum(normal_equations(rows, width, n_targets).values()), alpha)
    return ridge_gradients(rows, width, n_targets, alpha)


def predict(rows: DataFrame, models: dict[tuple, np.ndarray], names: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Predictions of every model in `models` (keyed by `names` values) for the rows of its fold.

    A model whose key starts with a fold predicts only that fold's rows.
    """
    held = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, w in held.value.items():
                part = batch[batch["fold"] == key[0]] if names[0] == "fold" else batch
                if not len(part):
                    continue
                at = np.repeat(np.arange(len(part)), part["idx"].map(len))
                p = np.tile(w[0], (len(part), 1))
                if len(at):
                    idx = np.concatenate(part["idx"].to_numpy()).astype(int) + 1
                    np.add.at(p, at, np.concatenate(part["val"].to_numpy())[:, None] * w[idx])
                for t, name in enumerate(targets):
                    out = pd.DataFrame({"item_id": part["item_id"], "target": name, "prediction": p[:, t]})
                    for n, k in zip(names, key):
                        out[n] = k
                    yield out[["item_id", *names, "target", "prediction"]]

    types = "".join(f"{n} {'bigint' if n == 'fold' else 'double'}, " for n in names)
    return rows.mapInPandas(run, f"item_id bigint, {types}target string, prediction double")


def category_shrinkage(items: DataFrame, keys: Sequence[str], category: str, value: str, prior: float) -> DataFrame:
    """Category means shrunk to the overall mean with `prior` items: (sum + prior mean) / (n + prior)."""
    per = items.groupBy(*keys, category).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    overall = per.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    return per.join(overall, list(keys)).select(
        *keys, category, ((F.col("_s") + prior * F.col("_m")) / (F.col("_n") + prior)).alias("shrunk"))


def effect_metrics(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pearson, Spearman, R2, RMSE and sign accuracy per (keys, family), with a MACRO row of means.

    `pairs`: (keys, family, truth, prediction).
    """
    by = [*keys, "family"]
    y, p = F.col("truth"), F.col("prediction")
    base = pairs.groupBy(*by).agg(
        F.when((F.stddev_pop(y) > 1e-12) & (F.stddev_pop(p) > 1e-12), F.corr(y, p)).alias("pearson_r"),
        (1.0 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.avg(((p >= 0) == (y >= 0)).cast("double")).alias("sign_accuracy"), F.count(F.lit(1)).alias("n_items"))
    full = base.join(spearman(pairs, by, "truth", "prediction", "spearman_r").drop("n"), by)
    names = ["pearson_r", "spearman_r", "r2", "rmse", "sign_accuracy"]
    macro = full.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names], F.max("n_items").alias("n_items")).withColumn(
        "family", F.lit("MACRO"))
    return full.select(*by, *names, "n_items").unionByName(macro.select(*by, *names, "n_items"))


def top_items(effects: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The k most and least advantaged items per family (ranks pruned below the shuffle)."""

    by = [*keys, "family"]
    low = Window.partitionBy(*by).orderBy("effect", "item_id")
    high = Window.partitionBy(*by).orderBy(F.col("effect").desc(), "item_id")
    pick = lambda w, d: effects.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn(
        "direction", F.lit(d))
    return pick(low, "disadvantage").unionByName(pick(high, "advantage")).select(*by, "direction", "rank", "item_id", "effect")


def auc(cells: DataFrame, keys: Sequence[str], score: str, y: str = "y") -> DataFrame:
    """Area under the ROC curve per `keys` from average ranks; null for one-class groups."""
    keys = list(keys)
    counts = cells.groupBy(*keys, score).agg(F.sum(y).alias("_p"), F.count(F.lit(1)).alias("_c"))

    below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_r", F.coalesce(F.sum("_c").over(below), F.lit(0)) + (F.col("_c") + 1) / 2.0)
    t = ranked.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_p")).alias("_s"), F.sum("_p").alias("p"), F.sum("_c").alias("n"))
    pos, neg = F.col("p"), F.col("n") - F.col("p")
    return t.select(*keys, F.when((pos > 0) & (neg > 0), (F.col("_s") - pos * (pos + 1) / 2.0) / (pos * neg)).alias("auc"))


def auc_summary(cells: DataFrame, keys: Sequence[str], group: str, score: str) -> DataFrame:
    """Mean and standard error of the AUC within the groups that hold both classes."""
    g = auc(cells, [*keys, group], score)
    return g.groupBy(*keys).agg(
        F.avg("auc").alias(f"within_{group}_auc"),
        (F.stddev_samp("auc") / F.sqrt(F.count("auc"))).alias(f"within_{group}_se"), F.count("auc").alias(f"n_{group}"))


def choose_threshold(cells: DataFrame, keys: Sequence[str], score: str, y: str = "y") -> DataFrame:
    """Threshold with the best balanced accuracy among 99 score quantiles (the lowest on ties).

    Cells are first counted per quantile interval, then the few intervals are
    accumulated, so each cell is read once and not once per candidate.
    """

    keys = list(keys)
    q = cells.groupBy(*keys).agg(F.array_distinct(F.percentile(score, F.array(*[
        F.lit(round(k / 100, 2)) for k in range(1, 100)]))).alias("_q"))
    slot = F.size(F.filter("_q", lambda t: t <= F.col(score)))
    counted = cells.join(q, keys).groupBy(*keys, slot.alias("_slot")).agg(
        F.sum(y).alias("_p"), F.count(F.lit(1)).alias("_c"), F.first("_q").alias("_q"))
    up = Window.partitionBy(*keys).orderBy(F.col("_slot").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    # Candidates in empty intervals tie with the next filled one; the lowest of them is the choice.
    lowest = F.coalesce(F.lag("_slot").over(whole.orderBy("_slot")), F.lit(0)) + 1
    n_pos, n = F.sum("_p").over(whole), F.sum("_c").over(whole)
    t = counted.select(
        *keys, "_slot", "_q", F.greatest(lowest, F.lit(1)).alias("_first"), F.sum("_p").over(up).alias("tp"), F.sum("_c").over(up).alias("hit"), n_pos.alias("pos"), n.alias("n"))
    score_ba = 0.5 * (F.col("tp") / F.col("pos") + 1.0 - (F.col("hit") - F.col("tp")) / (F.col("n") - F.col("pos")))
    scored = t.filter("_slot > 0").select(*keys, F.element_at("_q", F.col("_first")).alias("threshold"), F.round(score_ba, 12).alias("ba"))
    best = F.min_by(F.struct("threshold", "ba"), F.struct(-F.col("ba"), F.col("threshold")))
    return scored.groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.threshold").alias("threshold"), F.col("_b.ba").alias("balanced_accuracy"))


def evaluate(cells: DataFrame, keys: Sequence[str], score: str, threshold: Column, y: str = "y") -> DataFrame:
    """Balanced accuracy, accuracy, log loss, Brier score and counts in one aggregate."""
    z, t = F.col(score), F.col(y)
    hit = (z >= threshold).cast("double")
    pos, neg = F.sum(t), F.sum(1 - t)
    return cells.groupBy(*keys).agg(
        (0.5 * (ratio(F.sum(hit * t), pos) + ratio(F.sum((1 - hit) * (1 - t)), neg))).alias("balanced_accuracy"),
        F.avg((hit == t).cast("double")).alias("accuracy"), F.avg(bernoulli_loss(z, t)).alias("log_loss"),
        F.avg((sigmoid(z) - t) * (sigmoid(z) - t)).alias("brier"), F.count(F.lit(1)).alias("cells"))


def compare_predictors(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Paired differences `delta`: mean, median, standard error, positive share and signed-rank test."""
    keys = list(keys)
    d = F.col("delta")
    base = pairs.filter(d.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_delta"), F.percentile(d, 0.5).alias("median_delta"),
        (F.stddev_samp(d) / F.sqrt(F.count(F.lit(1)))).alias("standard_error"),
        F.avg((d > 0).cast("double")).alias("fraction_positive"))
    test = wilcoxon(pairs.filter(d.isNotNull()), keys, "delta").select(*keys, F.col("statistic").alias("wilcoxon_statistic"),
                                                                      F.col("z").alias("wilcoxon_z"), F.col("p").alias("wilcoxon_p"))
    return base.join(test, keys)


def rate_metrics(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Correlation, R2 and RMSE of predicted item rates (`truth`, `prediction`)."""
    y, p = F.col("truth"), F.col("prediction")
    return items.groupBy(*keys).agg(
        F.corr(y, p).alias("pearson_r"), (1.0 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count(F.lit(1)))).alias("r2"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.count(F.lit(1)).alias("n_items"))
