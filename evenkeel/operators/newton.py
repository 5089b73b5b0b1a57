"""One-dimensional logistic fits as JVM-side expressions over pre-aggregated points.

Cells that share an offset enter a fit only through their count, so facts are
reduced to (offset, count) points before any iteration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bernoulli_loss, clip, clipped_logit, logit, sigmoid
from ..session import cut

ITERATIONS = 30


def newton(points: Column, successes: Column, start: Column, penalty: Column | None = None,
           iterations: int = ITERATIONS) -> Column:
    """Solve sum n sigmoid(b + o) + penalty b = successes for b, by clipped Newton steps.

    `points` is an array of structs (o, n). The step count is fixed, so rows do
    not depend on each other.
    """
    pull, ridge = (F.lit(0.0), F.lit(1e-9)) if penalty is None else (penalty, penalty)

    def step(b: Column, _: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("i"))

        def add(acc: Column, p: Column) -> Column:
            pr = sigmoid(b + p["o"])
            return F.struct((acc["m"] + p["n"] * pr).alias("m"), (acc["i"] + p["n"] * pr * (1.0 - pr)).alias("i"))

        sums = F.array(F.aggregate(points, zero, add))
        return F.transform(sums, lambda a: b + clip(
            (successes - a["m"] - pull * b) / (a["i"] + ridge), -2.0, 2.0))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start.cast("double"), step)


def _points(cells: DataFrame, keys: Sequence[str], offset: str, y: str = "y") -> DataFrame:
    """Per `keys`: points, successes, mean outcome and mean offset. Cells may carry a count `n`."""
    n = F.col("n") if "n" in cells.columns else F.lit(1)
    level = cells.withColumn("_n", n).groupBy(*keys, F.col(offset).alias("_o")).agg(
        F.sum("_n").cast("double").alias("_n"), F.sum(y).cast("double").alias("_s"))
    return level.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_n").alias("n")))).alias("points"),
        F.sum("_s").alias("s"), F.sum("_n").alias("n"), F.sum(F.col("_o") * F.col("_n")).alias("so"))


def fit_item_intercepts(cells: DataFrame, keys: Sequence[str], offset: str = "offset", margin: float = 1e-4) -> DataFrame:
    """Item intercept given fixed offsets: `cells` holds (keys, offset, y)."""
    p = _points(cells, keys, offset)
    start = logit(clip(F.col("s") / F.col("n"), margin, 1 - margin)) - F.col("so") / F.col("n")
    return p.select(*keys, newton(F.col("points"), F.col("s"), start).alias("intercept"))


def fit_general_ability(cells: DataFrame, keys: Sequence[str], item_logit: str = "item_logit") -> DataFrame:
    """Model ability given item logits: the same fit with models as rows and the wider start clip."""
    return fit_item_intercepts(cells, keys, item_logit, 1e-3).withColumnRenamed("intercept", "ability")


def fit_rasch(cells: DataFrame, keys: Sequence[str], cycles: int = 5) -> tuple[DataFrame, DataFrame]:
    """Abilities and item intercepts by alternation, centred on the abilities.

    Totals are sufficient: models with the same total share an ability and items
    with the same total share an intercept. The facts are read once for each
    margin; the iterations run on tables of distinct totals. This holds for complete
    tables; where cells are missing, totals are still compared with all items.
    """
    keys = list(keys)
    model = cut(cells.groupBy(*keys, "model_id").agg(F.sum("y").cast("bigint").alias("t"), F.count(F.lit(1)).alias("of")))
    item = cut(cells.groupBy(*keys, "item_id").agg(F.sum("y").cast("bigint").alias("t"), F.count(F.lit(1)).alias("of")))

    def levels(df: DataFrame) -> DataFrame:
        return df.groupBy(*keys, "t", "of").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "v", clipped_logit(F.col("t") / F.col("of")))

    def solve(side: DataFrame, other: DataFrame) -> DataFrame:
        points = other.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
            F.col("v").alias("o"), F.col("n").cast("double").alias("n")))).alias("_points"))
        solved = newton(F.col("_points"), F.col("t").cast("double"), F.col("v"))
        return side.join(points, keys).withColumn("v", solved).drop("_points")

    a, b = levels(model), levels(item)
    for _ in range(cycles):
        a = cut(solve(a, b))
        center = a.groupBy(*keys).agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("_c"))
        b = cut(solve(b, a).join(center, keys).withColumn("v", F.col("v") + F.col("_c")).drop("_c"))
        a = a.join(center, keys).withColumn("v", F.col("v") - F.col("_c")).drop("_c")
    ability = model.join(a.select(*keys, "t", "of", F.col("v").alias("ability")), [*keys, "t", "of"]).select(*keys, "model_id", "ability")
    intercept = item.join(b.select(*keys, "t", "of", F.col("v").alias("intercept")), [*keys, "t", "of"]).select(*keys, "item_id", "intercept")
    return ability, intercept


def item_parameters(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smoothed success probability and its Bernoulli scale."""
    p = clip((F.sum("y") + 0.5) / (F.count(F.lit(1)) + 1.0), 1e-4, 1 - 1e-4)
    return cells.groupBy(*keys).agg(p.alias("p")).withColumn("scale", F.sqrt(F.col("p") * (1.0 - F.col("p"))))


def working_responses(cells: DataFrame, parameters: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.join(parameters, list(keys)).withColumn("working", (F.col("y") - F.col("p")) / F.col("scale"))


def dif_loss(cells: DataFrame, intercepts: DataFrame, effects: DataFrame, keys: Sequence[str],
             by: Sequence[str], offset: str = "offset") -> DataFrame:
    """Mean log loss of intercept + offset + family effect, per `by`."""
    keys = list(keys)
    z = F.col("intercept") + F.col(offset) + F.col("effect")
    return (
        cells.join(intercepts.select(*keys, "item_id", "intercept"), [*keys, "item_id"])
        .join(effects.select(*keys, "item_id", "family", "effect"), [*keys, "item_id", "family"])
        .groupBy(*by).agg(F.avg(bernoulli_loss(z, F.col("y"))).alias("log_loss"), F.count(F.lit(1)).alias("cells")))


def dif_magnitude(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Range of the family effects and the family with the largest one (first by name on ties)."""
    first = F.min_by("family", F.struct(-F.col("effect"), F.col("family")))
    return effects.groupBy(*keys, "item_id").agg(
        (F.max("effect") - F.min("effect")).alias("magnitude"), first.alias("advantaged_family"))


def dtf_curves(items: DataFrame, effects: DataFrame, keys: Sequence[str],
               thetas: Sequence[float] = (-2.0, -1.0, 0.0, 1.0, 2.0)) -> DataFrame:
    """Family minus reference success probability over ability, plain and weighted, in one pass."""
    keys = list(keys)
    t = items.join(effects.select(*keys, "item_id", "family", "effect"), [*keys, "item_id"]).withColumn(
        "theta", F.explode(F.array(*[F.lit(v) for v in thetas])))
    base = F.col("intercept") + F.col("theta")
    diff = sigmoid(base + F.col("effect")) - sigmoid(base)
    return t.groupBy(*keys, "family", "theta").agg(
        F.avg(diff).alias("full_dtf"), (F.sum(diff * F.col("weight")) / F.sum("weight")).alias("anchor_dtf"))


def one_se_rule(losses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest dimension with loss within one standard error of the best (smallest on ties)."""
    best = losses.groupBy(*keys).agg(F.min_by(
        F.struct("dimension", "mean_log_loss", "se"), F.struct("mean_log_loss", "dimension")).alias("_b"))
    t = losses.join(best, list(keys)).withColumn("threshold", F.col("_b.mean_log_loss") + F.col("_b.se"))
    return t.groupBy(*keys).agg(
        F.first("_b.dimension").alias("best_dimension"), F.first("threshold").alias("one_se_threshold"),
        F.min(F.when(F.col("mean_log_loss") <= F.col("threshold"), F.col("dimension"))).alias("selected_dimension"))


def loss_by_dimension(per_model: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and standard error over models of the per-model losses."""
    return per_model.groupBy(*keys, "dimension").agg(
        F.avg("loss").alias("mean_log_loss"),
        (F.stddev_samp("loss") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.count(F.lit(1)).alias("models"))


# --- model offsets around a general ability ----------------------------------

def fit_factor_offsets(cells: DataFrame, keys: Sequence[str], level: str, penalty: Column | float,
                       offset: str = "offset") -> DataFrame:
    """Penalised offset of each (keys, level) group given fixed offsets.

    `penalty` may be a column of `keys`, so that a grid of penalties is one job.
    """
    p = _points(cells, [*keys, level], offset)
    pen = F.lit(float(penalty)) if not isinstance(penalty, Column) else penalty

    return p.select(*keys, level, newton(F.col("points"), F.col("s"), F.lit(0.0), pen).alias("theta"))


def bifactor_offsets(cells: DataFrame, abilities: DataFrame, keys: Sequence[str], penalty: Column | float,
                     level: str = "category", item_logit: str = "item_logit") -> tuple[DataFrame, DataFrame]:
    """Category offsets around the general ability, centred per model; the centre moves into the ability."""
    keys = list(keys)
    given = cells.join(abilities, [k for k in keys if k in abilities.columns]).withColumn(
        "offset", F.round(F.col(item_logit) + F.col("ability"), 12))
    raw = cut(fit_factor_offsets(given, keys, level, penalty))
    center = raw.groupBy(*keys).agg(F.avg("theta").alias("_c"))
    theta = raw.join(center, keys).withColumn("theta", F.col("theta") - F.col("_c")).drop("_c")
    general = center.join(abilities, [k for k in keys if k in abilities.columns]).select(
        *keys, (F.col("ability") + F.col("_c")).alias("ability"))
    return general, theta


def multilevel_offsets(cells: DataFrame, factors: Sequence[tuple[str, float]], cycles: int = 4,
                       item_logit: str = "item_logit") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Several overlapping model factors by coordinate descent; each step is one grouped fit.

    `cells`: (model_id, item columns, item_logit, y). `factors`: (item column, penalty).
    """
    alpha = cut(fit_general_ability(cells, ["model_id"], item_logit))
    effects: dict[str, DataFrame] = {}

    def offsets(skip: str | None) -> DataFrame:
        out = cells.withColumn("offset", F.col(item_logit).cast("double"))
        if skip != "ability":
            out = out.join(alpha, "model_id").withColumn("offset", F.col("offset") + F.col("ability")).drop("ability")
        for name, effect in effects.items():
            if name != skip:
                out = out.join(effect, ["model_id", name]).withColumn("offset", F.col("offset") + F.col("theta")).drop("theta")
        return out.withColumn("offset", F.round("offset", 12))

    for _ in range(cycles):
        if effects:
            alpha = cut(fit_item_intercepts(offsets("ability"), ["model_id"], "offset", 1e-3).withColumnRenamed("intercept", "ability"))
        for name, penalty in factors:
            raw = cut(fit_factor_offsets(offsets(name), ["model_id"], name, penalty))
            center = raw.groupBy("model_id").agg(F.avg("theta").alias("_c"))
            effects[name] = cut(raw.join(center, "model_id").select("model_id", name, (F.col("theta") - F.col("_c")).alias("theta")))
            alpha = cut(alpha.join(center, "model_id").select("model_id", (F.col("ability") + F.col("_c")).alias("ability")))
    return alpha, effects


def bifactor_penalty_cv(cells: DataFrame, penalties: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Held-out log loss of additive and bifactor predictions over folds x penalties.

    `cells`: (keys, fold, model_id, category, item_logit, y). Folds and penalties
    are key columns of one job, not driver loops: each training cell is copied to
    the folds it trains.
    """
    keys = list(keys)
    folds = [r["fold"] for r in cells.select("fold").distinct().collect()]
    train = cells.withColumn("held", F.explode(F.array(*[F.lit(f) for f in sorted(folds)]))).filter(
        F.col("held") != F.col("fold")).drop("fold")
    alpha = cut(fit_general_ability(train, [*keys, "held", "model_id"]))
    grid = train.withColumn("penalty", F.explode(F.array(*[F.lit(float(p)) for p in penalties])))
    general, theta = bifactor_offsets(grid, alpha, [*keys, "held", "penalty", "model_id"], F.col("penalty"))
    test = cells.withColumnRenamed("fold", "held")
    additive = test.join(alpha, [*keys, "held", "model_id"]).groupBy(*keys, "held").agg(
        F.avg(bernoulli_loss(F.col("item_logit") + F.col("ability"), F.col("y"))).alias("additive_log_loss"))
    z = F.col("item_logit") + F.col("ability") + F.coalesce("theta", F.lit(0.0))
    both = (
        test.join(general, [*keys, "held", "model_id"])
        .join(theta, [*keys, "held", "penalty", "model_id", "category"], "left")
        .groupBy(*keys, "held", "penalty").agg(F.avg(bernoulli_loss(z, F.col("y"))).alias("bifactor_log_loss")))
    return both.join(additive, [*keys, "held"]).withColumn(
        "delta_log_loss", F.col("bifactor_log_loss") - F.col("additive_log_loss"))


def best_penalty(cv: DataFrame, keys: Sequence[str], loss: str = "bifactor_log_loss") -> DataFrame:
    mean = cv.groupBy(*keys, "penalty").agg(F.avg(loss).alias("loss"))
    return mean.groupBy(*keys).agg(
        F.min_by("penalty", F.struct(F.round("loss", 12), F.col("penalty"))).alias("penalty"), F.min("loss").alias("loss"))

