"""Registered queries: text features, item predictions and predictor metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import clip, clipped_logit, draw_key
from ..functions.ranks import hash_row_number
from ..operators import newton, population, predict, text
from ..session import cut
from .estimator_queries import abilities, item_logits
from .fixture import BOOT_SEED, CTES, FOLD, Fixture, md5_sql
from .registry import query, rnd, rounded, shares_sql

MAX_FEATURES = 2000
PRIOR = 5.0

CTES["fx_shrunk"] = f"""SELECT benchmark, half, item_group, (sum(intercept) + {PRIOR} * any_value(m)) / (count(*) + {PRIOR}) AS shrunk FROM (
  SELECT *, avg(intercept) OVER (PARTITION BY benchmark, half) AS m FROM fx_itemfit) GROUP BY benchmark, half, item_group"""
CTES["fx_pred"] = """SELECT r.benchmark, r.half, r.model_id, r.item_id, r.y, round(a.ability + l.item_logit, 9) AS z_item, round(a.ability +
    ln(least(greatest(shrunk, 0.001), 0.999) / (1 - least(greatest(shrunk, 0.001), 0.999))), 9) AS z_cat
  FROM fx_resp r JOIN (SELECT benchmark, half, model_id, round(ln(least(greatest(avg(y), 0.001), 0.999) / (1 - least(greatest(avg(y), 0.001), 0.999))), 12) AS ability FROM fx_resp GROUP BY ALL) a USING (benchmark, half, model_id)
  JOIN (SELECT benchmark, half, item_id, round(ln(least(greatest(avg(y), 0.001), 0.999) / (1 - least(greatest(avg(y), 0.001), 0.999))), 12) AS item_logit FROM fx_resp GROUP BY ALL) l USING (benchmark, half, item_id)
  JOIN fx_shrunk s ON s.benchmark = r.benchmark AND s.half = r.half AND s.item_group = r.item_group"""


def shrunk(fx: Fixture):
    return predict.category_shrinkage(fx.itemfit, FOLD, "item_group", "intercept", PRIOR)


def predictions(fx: Fixture):
    """Cells with two predictor logits: the item's own rate and the shrunk category rate."""
    t = fx.resp.join(abilities(fx), [*FOLD, "model_id"]).join(item_logits(fx), [*FOLD, "item_id"]).join(
        shrunk(fx), [*FOLD, "item_group"])
    return t.withColumn("z_item", F.round(F.col("ability") + F.col("item_logit"), 9)).withColumn(
        "z_cat", F.round(F.col("ability") + clipped_logit(F.col("shrunk")), 9))


# --- features ----------------------------------------------------------------

def documents(fx: Fixture):
    return fx.table("documents").select(F.col("doc_id").alias("item_id"), "text", "lang", "source", "n_chars")


HOT_SQL = f"""(SELECT doc_id AS item_id, rn <= share AS train, unnest(['lang=' || r.lang, 'source=' || source]) AS feature FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {md5_sql(BOOT_SEED, "'item'", 'doc_id')}, doc_id) AS rn FROM documents) r
  JOIN {shares_sql('documents', 'lang', 0.7)} s ON s.lang = r.lang)"""


@query("one_hot_metadata", f"""SELECT h.item_id, h.feature, i.index FROM {HOT_SQL} h JOIN (SELECT feature, row_number() OVER (ORDER BY feature) - 1 AS "index" FROM
  (SELECT DISTINCT feature FROM {HOT_SQL} WHERE train)) i ON i.feature = h.feature""")
def one_hot_metadata(fx):
    split = population.stratified_item_split(documents(fx).drop("text"), "lang", "item_id", 0.7, BOOT_SEED)
    return text.one_hot(split, ["lang", "source"], F.col("part") == "train")


TF_SQL = f"""WITH w AS (SELECT doc_id AS item_id, regexp_extract_all(lower(text), '{text.WORD}') AS w FROM documents),
 g AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
 tf AS (SELECT item_id, term, count(*) AS tf FROM g GROUP BY ALL),
 v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT {MAX_FEATURES}),
 x AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN v USING (term)),
 n AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM x)"""


def document_weights(fx: Fixture):
    return text.term_weights(documents(fx), fx.table("documents").count(), MAX_FEATURES)


@query("tfidf", f"{TF_SQL} SELECT item_id, count(*) AS terms, round(sum(weight), 8) AS total, round(max(weight), 8) AS top FROM n GROUP BY 1")
def tfidf(fx):
    return rounded(document_weights(fx).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("total"), F.max("weight").alias("top")))


def embedded(fx: Fixture):
    return fx.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").cast("bigint").alias("item_group"),
                                         F.col("embedding").cast("array<double>").alias("features"))


def embedded_split(fx: Fixture):
    return cut(population.stratified_item_split(embedded(fx), "item_group", "item_id", 0.7, BOOT_SEED))


@query("truncated_svd")
def truncated_svd(fx):
    """Squared length of each item's rank-8 projection (sign and rotation free)."""
    p = text.low_rank(embedded_split(fx), 8, 64, F.col("part") == "train")
    energy = F.aggregate("projection", F.lit(0.0), lambda s, v: s + v * v)
    return rounded(p.select("item_id", energy.alias("energy")), 6)


def feature_blocks(fx: Fixture):
    """Blocks over documents: one-hot metadata, n-gram weights, and character-class shares as low-rank input."""
    docs = documents(fx)
    split = cut(population.stratified_item_split(docs.drop("text"), "lang", "item_id", 0.7, BOOT_SEED))
    meta = text.one_hot(split, ["lang", "source"], F.col("part") == "train").select("item_id", "feature", F.lit(1.0).alias("value"))
    weights = cut(document_weights(fx)).select("item_id", F.col("term").alias("feature"), F.col("weight").alias("value"))
    letters = text.letter_counts(docs, "abcdefghijklmnop")
    dense = text.low_rank(cut(split.join(letters, "item_id")), 4, 16, F.col("part") == "train")
    svd = dense.select("item_id", F.posexplode("projection").alias("pos", "value")).select(
        "item_id", F.col("pos").cast("string").alias("feature"), "value")
    return split, {"metadata": meta, "tfidf": weights, "svd": svd}


FEATURE_SETS = {  # fixed values: combinations with their ridge grids
    "metadata": (("metadata",), (1.0, 10.0, 100.0)),
    "tfidf_metadata": (("tfidf", "metadata"), (10.0, 100.0, 1000.0)),
    "svd": (("svd",), (1.0, 10.0, 100.0, 1000.0)),
    "svd_metadata": (("svd", "metadata"), (1.0, 10.0, 100.0, 1000.0)),
    "tfidf_svd_metadata": (("tfidf", "svd", "metadata"), (10.0, 100.0, 1000.0)),
}


@query("feature_sets")
def feature_sets(fx):
    """Size of each feature combination: features, non-zero values, grid points."""
    _, blocks = feature_blocks(fx)
    sizes = cut(text.stack_features(list(blocks.items())).groupBy("block").agg(
        F.countDistinct("index").alias("features"), F.count(F.lit(1)).alias("values")))
    member = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(b) for b in bs]).alias("parts"),
                                          F.lit(len(g)).alias("grid")) for n, (bs, g) in FEATURE_SETS.items()]))
    t = sizes.withColumn("_m", member).filter(F.array_contains("_m.parts", F.col("block")))
    return t.groupBy(F.col("_m.name").alias("feature_set"), F.col("_m.grid").alias("grid_points")).agg(
        F.sum("features").alias("features"), F.sum("values").alias("values"))


def effect_targets(fx: Fixture):
    """Items of one benchmark with discovery and validation effects as arrays, metadata and a fold."""
    e = fx.effects.filter("benchmark = 'N'")
    families = [r["family"] for r in e.select("family").distinct().orderBy("family").collect()]
    wide = e.groupBy("item_id", "item_group").pivot("half", ["discovery", "validation"]).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("family", "effect"))), lambda x: x["effect"]))
    folds = population.stratified_kfold(wide, "item_group", "item_id", 4, BOOT_SEED)
    return cut(folds.withColumn("y", F.col("discovery"))), families


def item_features(fx: Fixture):
    """Group, brand mix and price level of each part bucket."""
    part = fx.table("part").select((F.col("p_partkey") % 200).alias("item_id"), "p_brand", "p_type", "p_retailprice", "p_size")
    hot = text.one_hot(part.withColumn("group", F.col("item_id") % 8), ["group", "p_type"], F.lit(True)).groupBy(
        "item_id", "feature").agg((F.count(F.lit(1)) / 1.0).alias("value"))
    level = part.groupBy("item_id").agg(F.lit("price").alias("feature"), (F.avg("p_retailprice") / 1000.0).alias("value"))
    size = part.groupBy("item_id").agg(F.lit("size").alias("feature"), (F.avg("p_size") / 50.0).alias("value"))
    return cut(text.stack_features([("hot", hot), ("level", level.unionByName(size))]))


def ridge_rows(fx: Fixture):
    targets, families = effect_targets(fx)
    features = item_features(fx)
    width = features.agg(F.max("index").alias("m")).first()["m"] + 1
    return cut(predict.pack_rows(features, targets)), families, width


@query("ridge_predict")
def ridge_predict(fx):
    rows, families, width = ridge_rows(fx)
    train = rows.filter("fold > 0")
    models = {(10.0,): predict.ridge_fit(train, width, len(families), 10.0)}
    out = predict.predict(rows.filter("fold = 0"), models, ["penalty"], families)
    return rounded(out.withColumn("prediction", clip(F.col("prediction"), -0.999, 0.999)), 6)


def cv_predictions(fx: Fixture, penalties=(1.0, 10.0, 100.0)):
    """Held-out predictions of every fold and penalty: one pass for all normal equations."""
    rows, families, width = ridge_rows(fx)
    sums = predict.normal_equations(rows, width, len(families))
    total = sum(sums.values())
    models = {(f, p): predict.solve_ridge(total - s, p) for f, s in sums.items() for p in penalties}
    out = predict.predict(rows, models, ["fold", "penalty"], families)
    truth = fx.effects.filter("benchmark = 'N' and half = 'validation'").select(
        "item_id", F.col("family").alias("target"), F.col("effect").alias("truth"))
    return out.join(truth, ["item_id", "target"])


@query("representation_cv")
def representation_cv(fx):
    r = cv_predictions(fx).groupBy("fold", "penalty", "target").agg(F.corr("truth", "prediction").alias("r"))
    per = r.groupBy("fold", "penalty").agg(F.avg("r").alias("macro_pearson"))
    mean = per.groupBy("penalty").agg(F.avg("macro_pearson").alias("macro_pearson")).withColumn("fold", F.lit(-1).cast("bigint"))
    return rounded(per.unionByName(mean.select("fold", "penalty", "macro_pearson")), 6)


PAIR_EFFECTS_SQL = """(SELECT v.benchmark, v.family, v.item_id, v.effect AS y, d.effect AS p FROM fx_effects v JOIN fx_effects d
  ON d.benchmark = v.benchmark AND d.family = v.family AND d.item_id = v.item_id AND d.half = 'discovery' WHERE v.half = 'validation')"""
AVG_RANK = "rank() OVER (PARTITION BY benchmark, family ORDER BY {0}) + (count(*) OVER (PARTITION BY benchmark, family, {0}) - 1) / 2.0"


def effect_pairs(fx: Fixture):
    e = fx.effects
    v = e.filter("half = 'validation'").select("benchmark", "family", "item_id", F.col("effect").alias("truth"))
    d = e.filter("half = 'discovery'").select("benchmark", "family", "item_id", F.col("effect").alias("prediction"))
    return v.join(d, ["benchmark", "family", "item_id"])


@query("effect_prediction_metrics", f"""WITH m AS (SELECT benchmark, family, corr(y, p) AS pearson_r, corr(ry, rp) AS spearman_r,
   1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - p) * (y - p))) AS rmse, avg(((p >= 0) = (y >= 0))::INT) AS sign_accuracy, count(*) AS n_items
   FROM (SELECT *, {AVG_RANK.format('y')} AS ry, {AVG_RANK.format('p')} AS rp FROM {PAIR_EFFECTS_SQL}) GROUP BY ALL)
 SELECT benchmark, family, {rnd('pearson_r', 'spearman_r', 'r2', 'rmse', 'sign_accuracy')}, n_items FROM (SELECT * FROM m UNION ALL
  SELECT benchmark, 'MACRO', avg(pearson_r), avg(spearman_r), avg(r2), avg(rmse), avg(sign_accuracy), max(n_items) FROM m GROUP BY 1)""")
def effect_prediction_metrics(fx):
    return rounded(predict.effect_metrics(effect_pairs(fx), ["benchmark"]))


@query("top_items", """SELECT benchmark, half, family, direction, rank::INTEGER AS rank, item_id, round(effect, 8) AS effect FROM (
  SELECT *, 'disadvantage' AS direction, row_number() OVER (PARTITION BY benchmark, half, family ORDER BY effect, item_id) AS rank FROM fx_effects
  UNION ALL SELECT *, 'advantage', row_number() OVER (PARTITION BY benchmark, half, family ORDER BY effect DESC, item_id) FROM fx_effects) WHERE rank <= 10""")
def top_items(fx):
    return rounded(predict.top_items(fx.effects, FOLD))


# --- predictor metrics -------------------------------------------------------

@query("category_shrinkage", f"SELECT benchmark, half, item_group, {rnd('shrunk')} FROM fx_shrunk")
def category_shrinkage(fx):
    return rounded(shrunk(fx))


def auc_sql(by: str, z: str = "z_item") -> str:
    return f"""(SELECT {by}, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) END AS auc
      FROM (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY {z}) + (count(*) OVER (PARTITION BY {by}, {z}) - 1) / 2.0 AS r FROM fx_pred) GROUP BY {by})"""


@query("auc_pooled_within", f"""SELECT p.benchmark, p.half, round(p.auc, 8) AS pooled_auc, round(avg(m.auc), 8) AS within_model_id_auc,
  round(stddev_samp(m.auc) / sqrt(count(m.auc)), 8) AS within_model_id_se, count(m.auc) AS n_model_id, any_value(i.a) AS within_item_id_auc, any_value(i.se) AS within_item_id_se, any_value(i.n) AS n_item_id
  FROM {auc_sql('benchmark, half')} p JOIN {auc_sql('benchmark, half, model_id')} m ON m.benchmark = p.benchmark AND m.half = p.half
  JOIN (SELECT benchmark, half, round(avg(auc), 8) AS a, round(stddev_samp(auc) / sqrt(count(auc)), 8) AS se, count(auc) AS n FROM {auc_sql('benchmark, half, item_id')} GROUP BY ALL) i
    ON i.benchmark = p.benchmark AND i.half = p.half GROUP BY p.benchmark, p.half, p.auc""")
def auc_pooled_within(fx):
    cells = cut(predictions(fx).select(*FOLD, "model_id", "item_id", "y", "z_item"))
    pooled = predict.auc(cells, FOLD, "z_item").withColumnRenamed("auc", "pooled_auc")
    return rounded(pooled.join(predict.auc_summary(cells, FOLD, "model_id", "z_item"), list(FOLD)).join(
        predict.auc_summary(cells, FOLD, "item_id", "z_item"), list(FOLD)))


THRESHOLD_SQL = f"""(SELECT benchmark, half, t AS threshold, ba FROM (SELECT *, row_number() OVER (PARTITION BY benchmark, half ORDER BY ba DESC, t) AS rn FROM (
  SELECT p.benchmark, p.half, t, round(0.5 * (avg((z_item >= t)::INT) FILTER (y = 1) + avg((z_item < t)::INT) FILTER (y = 0)), 12) AS ba
  FROM fx_pred p JOIN (SELECT DISTINCT benchmark, half, unnest(quantile_cont(z_item, {[round(k / 100, 2) for k in range(1, 100)]})) AS t FROM fx_pred GROUP BY benchmark, half) q
    ON q.benchmark = p.benchmark AND q.half = p.half GROUP BY ALL)) WHERE rn = 1)"""


@query("choose_threshold", f"SELECT benchmark, half, round(threshold, 6) AS threshold, round(ba, 8) AS balanced_accuracy FROM {THRESHOLD_SQL}")
def choose_threshold(fx):
    t = predict.choose_threshold(predictions(fx), FOLD, "z_item")
    return rounded(t.withColumn("threshold", F.round("threshold", 6)))


@query("evaluate_predictor", """SELECT benchmark, half, round(0.5 * (avg((z_item >= -2.5)::INT) FILTER (y = 1) + avg((z_item < -2.5)::INT) FILTER (y = 0)), 8) AS balanced_accuracy,
  round(avg(((z_item >= -2.5) = (y = 1))::INT), 8) AS accuracy, round(avg(ln(1 + exp(-abs(z_item))) + greatest(z_item, 0) - y * z_item), 8) AS log_loss,
  round(avg((1 / (1 + exp(-z_item)) - y) * (1 / (1 + exp(-z_item)) - y)), 8) AS brier, count(*) AS cells FROM fx_pred GROUP BY ALL""")
def evaluate_predictor(fx):
    return rounded(predict.evaluate(predictions(fx), FOLD, "z_item", F.lit(-2.5)))


DELTA_SQL = f"""(SELECT a.benchmark, a.half, round(a.auc - b.auc, 12) AS d FROM {auc_sql('benchmark, half, model_id')} a JOIN {auc_sql('benchmark, half, model_id', 'z_cat')} b
  ON a.benchmark = b.benchmark AND a.half = b.half AND a.model_id = b.model_id WHERE a.auc IS NOT NULL)"""


@query("predictor_comparison", f"""WITH d AS {DELTA_SQL}, nz AS (SELECT * FROM d WHERE d <> 0),
 r AS (SELECT benchmark, half, d, rank() OVER (PARTITION BY benchmark, half ORDER BY abs(d)) + (count(*) OVER (PARTITION BY benchmark, half, abs(d)) - 1) / 2.0 AS r FROM nz),
 s AS (SELECT benchmark, half, count(*)::DOUBLE AS n, coalesce(sum(r) FILTER (d > 0), 0) AS up, coalesce(sum(r) FILTER (d < 0), 0) AS down FROM r GROUP BY ALL),
 t AS (SELECT benchmark, half, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT benchmark, half, abs(d), count(*) AS c FROM nz GROUP BY ALL) GROUP BY ALL)
 SELECT d.benchmark, d.half, count(*) AS n, round(avg(d), 8) AS mean_delta, round(median(d), 8) AS median_delta, round(stddev_samp(d) / sqrt(count(*)), 8) AS standard_error,
  round(avg((d > 0)::INT), 8) AS fraction_positive, round(any_value(least(up, down)), 8) AS wilcoxon_statistic,
  round(any_value((up - s.n * (s.n + 1) / 4) / sqrt(s.n * (s.n + 1) * (2 * s.n + 1) / 24 - ties / 48)), 6) AS wilcoxon_z
 FROM d JOIN s ON s.benchmark = d.benchmark AND s.half = d.half JOIN t ON t.benchmark = d.benchmark AND t.half = d.half GROUP BY d.benchmark, d.half""")
def predictor_comparison(fx):
    cells = cut(predictions(fx).select(*FOLD, "model_id", "y", "z_item", "z_cat"))
    keys = [*FOLD, "model_id"]
    a, b = predict.auc(cells, keys, "z_item"), predict.auc(cells, keys, "z_cat").withColumnRenamed("auc", "other")
    pairs = a.join(b, keys).withColumn("delta", F.round(F.col("auc") - F.col("other"), 12))
    return rounded(predict.compare_predictors(pairs, FOLD).drop("wilcoxon_p").withColumn("wilcoxon_z", F.round("wilcoxon_z", 6)))


@query("item_rate_metrics", """SELECT i.benchmark, i.half, round(corr(intercept, shrunk), 8) AS pearson_r, round(1 - sum((intercept - shrunk) * (intercept - shrunk)) / (var_pop(intercept) * count(*)), 8) AS r2,
  round(sqrt(avg((intercept - shrunk) * (intercept - shrunk))), 8) AS rmse, count(*) AS n_items FROM fx_itemfit i JOIN fx_shrunk s
  ON s.benchmark = i.benchmark AND s.half = i.half AND s.item_group = i.item_group GROUP BY ALL""")
def item_rate_metrics(fx):
    t = fx.itemfit.join(shrunk(fx), [*FOLD, "item_group"]).withColumn("truth", F.col("intercept")).withColumn("prediction", F.col("shrunk"))
    return rounded(predict.rate_metrics(t, FOLD))


@query("theta_table", f"""PIVOT (SELECT benchmark, model_id, 'theta_' || item_group AS c, round(avg(y) - any_value(m), 8) AS v FROM (
  SELECT *, avg(y) OVER (PARTITION BY benchmark, model_id) AS m FROM fx_target) GROUP BY ALL) ON c IN ({', '.join(f"'theta_{k}'" for k in range(8))}) USING any_value(v) GROUP BY benchmark, model_id""")
def theta_table(fx):
    m = fx.target.groupBy("benchmark", "model_id").agg(F.avg("y").alias("_m"))
    per = fx.target.groupBy("benchmark", "model_id", "item_group").agg(F.avg("y").alias("_a")).join(m, ["benchmark", "model_id"])
    named = per.withColumn("c", F.concat(F.lit("theta_"), F.col("item_group").cast("string")))
    return rounded(named.groupBy("benchmark", "model_id").pivot("c", [f"theta_{k}" for k in range(8)]).agg(
        F.first(F.col("_a") - F.col("_m"))))


@query("bifactor_experiment")
def bifactor_experiment(fx):
    """Split items and models, choose the penalty by item folds, fix thresholds out of fold, judge on held-out cells."""
    cells = fx.resp.filter("benchmark = 'N'").drop("benchmark", "half")
    items = cut(population.stratified_item_split(cells.select("item_id", "item_group").distinct(), "item_group", "item_id", 0.7, BOOT_SEED))
    models = cut(population.model_split(cells.select("model_id").distinct(), 0.2, 100, BOOT_SEED))
    easiness = cells.join(models.filter("split = 'population'").select("model_id"), "model_id", "left_semi").groupBy(
        "item_id", "item_group").agg(F.avg("y").alias("rate"))
    train_rate = easiness.join(items.filter("part = 'train'").select("item_id"), "item_id", "left_semi")
    category = shrunk_category(train_rate)
    table = cut(cells.join(items.select("item_id", "part"), "item_id").join(models, "model_id").join(category, "item_group").withColumn(
        "item_logit", F.round(clipped_logit(F.col("shrunk")), 9)).withColumn("category", F.col("item_group")))
    folds = hash_row_number(items.filter("part = 'train'"), ["item_group"], draw_key(BOOT_SEED, "item_id", tag="fold"), "item_id")
    tuning = table.filter("tuning and part = 'train'").join(folds.select("item_id", ((F.col("rn") - 1) % 3).alias("fold")), "item_id")
    cv = newton.bifactor_penalty_cv(tuning, (1.0, 2.0, 4.0, 8.0))
    penalty = newton.best_penalty(cv.withColumn("_k", F.lit(0)), ["_k"]).first()["penalty"]
    fit = table.filter("split = 'evaluation' and part = 'train'")
    alpha = cut(newton.fit_general_ability(fit, ["model_id"]))
    general, theta = newton.bifactor_offsets(fit, alpha, ["model_id"], penalty)
    test = table.filter("split = 'evaluation' and part = 'test'")
    z = (test.join(alpha.withColumnRenamed("ability", "a0"), "model_id").join(general, "model_id").join(theta, ["model_id", "category"], "left")
         .withColumn("additive", F.round(F.col("item_logit") + F.col("a0"), 9))
         .withColumn("bifactor", F.round(F.col("item_logit") + F.col("ability") + F.coalesce("theta", F.lit(0.0)), 9)))
    long = cut(z.select("model_id", "item_id", "y", "additive", "bifactor").unpivot(["model_id", "item_id", "y"], ["additive", "bifactor"], "predictor", "z"))
    limit = predict.choose_threshold(long, ["predictor"], "z").select("predictor", "threshold")
    judged = predict.evaluate(long.join(limit, "predictor"), ["predictor", "threshold"], "z", F.col("threshold"))
    pooled = predict.auc(long, ["predictor"], "z")
    within = predict.auc_summary(long, ["predictor"], "model_id", "z")
    return rounded(judged.join(pooled, "predictor").join(within, "predictor").withColumn("penalty", F.lit(penalty)), 6)


def shrunk_category(rates):
    return predict.category_shrinkage(rates.withColumn("_k", F.lit(0)), ["_k"], "item_group", "rate", PRIOR).drop("_k")
