"""Quality classifier with hierarchical empirical Bayes.

Two verdicts per document, low quality and toxic, each from two levels of evidence:

* The document: a naive Bayes score over hashed words, on the share of each word's presence
  in labelled documents of either class, and a few numbers about the text's shape; a
  logistic fit on the labelled documents calibrates them. The fit uses at most
  `LABELLED` labelled documents and works on class counts and sufficient sums that Spark aggregates.
* The site: `source` is read as host and path. The mean of the documents' probabilities of
  a host is shrunk toward the global mean, and that of a path (with the language) toward
  its host's, with strengths that the method of moments finds from how much sites differ
  beyond chance. Sparse sites so fall back to their host and then to the global prior. The
  site's posterior replaces the global prior in the document's odds.

A document is rejected if either posterior is above `reject`. Null and empty texts have the
prior's odds and null sites are a site of their own; neither crashes nor rejects by itself.
Repeated rows count as often as they occur; labels are averaged over repeated rows of a
doc_id, and null labels are left out. Without labels of both classes, or on empty tables,
nothing is rejected. Columns of `documents` pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .common import best_rows, fresh, give_back, hash_sample
from .shingles import MARKS, SPACE, chunks, text_bytes, words

BUCKETS = 1 << 22  # hashed words
LABELLED = 20_000  # labelled documents that the fit uses at most, those with the smallest hashes
KEPT = 1 << 16  # telling words at most; fixes the size of the model
LEAST, TELLING = 3, 4.0  # labelled documents that a telling word is in, and the root of its likelihood ratio statistic
BEGINNINGS = (4, 5)  # first bytes of words that count like words, so that forms of a word share evidence
ROUNDS = 12  # Newton steps of the calibration
TARGETS = ("low", "toxic")
SHAPE = ("symbols", "capitals", "digits", "word_length", "repeats")
LIMIT = 12.0
PER_TARGET = 3
SHORT = 10.0  # words at which the shape counts half
STRONG = 1.5  # weight from which a word counts on its own
COMPACT = "buckets binary, times binary, shape array<double>, low double, toxic double"


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of each distinct word, and beginning of a word, of each text, with its count; the words of each text."""
    h, counts = words(column, MARKS, BEGINNINGS)
    doc = np.tile(np.repeat(np.arange(len(counts)), counts), len(h))
    key = doc * BUCKETS + (h.ravel() % np.uint64(BUCKETS)).astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    return key // BUCKETS, key % BUCKETS, times, counts


def shape(column: pa.Array) -> np.ndarray:
    """Numbers in about [0, 1]: symbols, capitals and digits per byte, word length, repeated words."""
    raw, at = text_bytes(column)
    n = np.maximum(1, np.diff(at))

    def share(marks: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marks)])
        return (sums[at[1:]] - sums[at[:-1]]) / n
    letter = (raw >= 65) & (raw <= 90) | (raw >= 97) & (raw <= 122) | (raw >= 128)
    digit = (raw >= 48) & (raw <= 57)
    plain = letter | digit | SPACE[raw] | np.isin(raw, np.frombuffer(b".,'-", np.uint8))
    h, counts = words(column, MARKS)
    doc = np.repeat(np.arange(len(counts)), counts)
    kinds = np.bincount(np.unique(doc * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64)) // BUCKETS, minlength=len(counts))
    return np.stack([share(~plain), share((raw >= 65) & (raw <= 90)), share(digit),
                     np.minimum(1, np.diff(at) / np.maximum(1, counts) / 30), 1 - kinds / np.maximum(1, counts)], 1)


def compact(column: pa.Array) -> list[pa.Array]:
    """Per text: distinct word buckets (32 bits), their counts (8 bits, 255 for more) and its shape."""
    doc, bucket, times, counts = distinct_words(column)
    ends = np.cumsum(np.bincount(doc, minlength=len(counts)))
    bucket, times = bucket.astype(np.uint32), np.minimum(times, 255).astype(np.uint8)
    slices = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    return [pa.array([bucket[s:e].tobytes() for s, e in slices], pa.binary()), pa.array([times[s:e].tobytes() for s, e in slices], pa.binary()),
            pa.array(list(shape(column)), pa.list_(pa.float64()))]


class Words:
    """Telling words (ascending buckets) and their weights: target, label left out or not, word."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray):
        self.buckets, self.weights = buckets, weights.astype(np.float32)


def evidence(buckets: pa.Array, times: pa.Array, shapes: pa.Array, known: Words,
             y: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text and target the sum and the largest weight of its telling words and their mean, then its shape; and its words.

    Without labels the weights are those of all labelled documents, with labels those without a document of that label.
    """
    own = [np.frombuffer(x, np.uint32) for x in buckets.to_pylist()]
    n, targets = len(own), len(known.weights)
    sizes = np.array([len(x) for x in own], np.int64)
    doc = np.repeat(np.arange(n), sizes)
    bucket = np.concatenate([*own, np.zeros(0, np.uint32)])
    count = np.frombuffer(b"".join(times.to_pylist()), np.uint8).astype(np.float64)
    total = np.maximum(1, np.bincount(doc, count, n))
    out = np.zeros((n, PER_TARGET * targets + len(SHAPE)))
    if len(known.buckets):
        at = np.minimum(np.searchsorted(known.buckets, bucket), len(known.buckets) - 1)
        hit = known.buckets[at] == bucket
        at, doc, count = at[hit], doc[hit], count[hit]
        for k in range(targets):
            value = known.weights[k, 0, at] if y is None else known.weights[k, 1 + (y[k] > 0.5)[doc], at]
            out[:, PER_TARGET * k] = np.clip(np.bincount(doc, np.where(np.abs(value) > STRONG, value, 0), n), -20, 20) / 5
            np.maximum.at(out[:, PER_TARGET * k + 1], doc, value)
            out[:, PER_TARGET * k + 2] = np.bincount(doc, value * count, n) / total
    out[:, PER_TARGET * targets :] = np.array(shapes.to_pylist(), float).reshape(n, len(SHAPE))
    return np.where((sizes > 0)[:, None], out, 0.0), total / (1 + len(BEGINNINGS))


def standard(x: np.ndarray, n: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised evidence of texts of n words; the shape of a few words says little, so it is shrunk toward the mean; nothing counts beyond 4."""
    x = (x - mean) / scale
    x[:, -len(SHAPE) :] = np.clip(x[:, -len(SHAPE) :], -4, 4) * (n / (n + SHORT))[:, None]
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Word weights and calibrated logits for each target."""

    def __init__(self, weights: Words, mean: np.ndarray, scale: np.ndarray, beta: np.ndarray, prior: np.ndarray):
        self.weights, self.mean, self.scale, self.beta, self.prior = weights, mean, scale, beta, prior

    def logits(self, column: pa.Array) -> np.ndarray:
        x = standard(*evidence(*compact(column), self.weights), self.mean, self.scale)
        z = np.clip(x @ self.beta[1:] + self.beta[0], -LIMIT, LIMIT)
        none = np.diff(text_bytes(column)[1]) == 0
        return np.where(none[:, None], np.log(self.prior / (1 - self.prior)), z)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the labelled documents, at most `LABELLED` of them; None if a class is missing."""
    known = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg((1 - F.avg("quality")).alias("low"), F.avg("toxic").alias("toxic")).where("low IS NOT NULL AND toxic IS NOT NULL"))
    known = hash_sample(cut(known), F.col("doc_id"), LABELLED)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 0):
                yield pa.RecordBatch.from_arrays([*compact(batch.column(0)), batch.column(1), batch.column(2)], ["buckets", "times", "shape", "low", "toxic"])
        give_back()

    # Three numbers for each of at most LABELLED documents, half a megabyte, go to the texts.
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    sample = cut(texts.join(F.broadcast(known), "doc_id").select("text", "low", "toxic").mapInArrow(squeeze, COMPACT))
    totals = sample.agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    if not totals[0] or min(totals[1], totals[2]) <= 0 or max(totals[1], totals[2]) >= totals[0]:
        return None
    prior = np.array(totals[1:], float) / totals[0]

    def parts(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield batch, [batch.column(c).to_numpy(zero_copy_only=False) for c in (3, 4)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, y in parts(batches):
            own = [np.frombuffer(x, np.uint32) for x in batch.column(0).to_pylist()]
            doc = np.repeat(np.arange(len(own)), [len(x) for x in own])
            some, place = np.unique(np.concatenate(own), return_inverse=True)
            seen = [np.bincount(place, v[doc], len(some)) for v in (np.ones(len(own)), *y)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), *map(pa.array, seen)], ["bucket", "n", "low", "toxic"])

    def telling(t: str):
        """Root of the likelihood ratio of the word's documents having the class as often as they do, or as all documents do."""
        share = float(totals[t] / totals["n"])
        yes, no = F.col(t), F.greatest(F.col("n") - F.col(t), F.lit(0.0))

        def term(k, expected):
            return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
        return F.sqrt(F.greatest(2 * (term(yes, F.col("n") * share) + term(no, F.col("n") * (1 - share))), F.lit(0.0)))

    counted = (sample.mapInArrow(count, "bucket long, n double, low double, toxic double").groupBy("bucket")
               .agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)]).where(F.col("n") >= LEAST)
               .withColumn("z", F.greatest(*map(telling, TARGETS))).where(F.col("z") >= TELLING))
    counted = best_rows(cut(counted), "z", KEPT).drop("z").toPandas().sort_values("bucket")  # KEPT rows at most

    def weigh(name: str, label: int | None) -> np.ndarray:
        """Shrunk log ratios; without one document of the class `label`, if given."""
        n, yes, all_n, all_yes = counted["n"].to_numpy(), counted[name].to_numpy(), totals["n"], totals[name]
        if label is not None:
            n, all_n = np.maximum(0, n - 1), all_n - 1
            yes, all_yes = (np.maximum(0, yes - 1), all_yes - 1) if label else (yes, all_yes)
        no = np.maximum(0, n - yes)
        value = np.log((yes + 0.5) / (all_yes + 1)) - np.log((no + 0.5) / (all_n - all_yes + 1))
        return np.clip(value, -6, 6) * (n / (n + 2))

    weights = Words(counted["bucket"].to_numpy().astype(np.uint32),  # a labelled document does not vouch for itself: rows 1 and 2
                    np.array([[weigh(t, None), weigh(t, 0), weigh(t, 1)] for t in TARGETS]).reshape(2, 3, -1))
    features = PER_TARGET * len(TARGETS) + len(SHAPE)
    p = features + 1

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, y in parts(batches):
            x, n = evidence(*(batch.column(c) for c in range(3)), weights, y)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), pa.array(n, pa.float64()), *map(pa.array, y)], ["x", "n", "low", "toxic"])

    # A dozen numbers for each labelled document are all that the passes of the fit read.
    numbers = cut(sample.mapInArrow(describe, "x array<double>, n double, low double, toxic double"))

    def sums(mean: np.ndarray, scale: np.ndarray, beta: np.ndarray | None):
        """Sums over the labelled documents: of features and squares, or gradients and Hessians."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * features if beta is None else 2 * (p + p * p))
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
                if beta is None:
                    total += np.concatenate([x.sum(0), (x * x).sum(0)])
                    continue
                x = np.concatenate([np.ones((len(x), 1)), standard(x, batch.column(1).to_numpy(zero_copy_only=False), mean, scale)], 1)
                found = []
                for k in range(2):
                    q = sigmoid(x @ beta[:, k])
                    found += [x.T @ (batch.column(2 + k).to_numpy(zero_copy_only=False) - q), ((x * (q * (1 - q))[:, None]).T @ x).ravel()]
                total += np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "v"])
        got = numbers.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
        return got["v"].to_numpy()

    moments = sums(np.zeros(features), np.ones(features), None).reshape(2, -1) / totals[0]
    mean = moments[0]
    scale = np.sqrt(np.maximum(moments[1] - mean**2, 1e-6))
    beta = np.zeros((p, 2))
    beta[0] = np.log(prior / (1 - prior))
    for _ in range(ROUNDS):
        got = sums(mean, scale, beta).reshape(2, -1)
        step = np.zeros_like(beta)
        for k in range(2):
            ridge = np.eye(p)
            ridge[0, 0] = 1e-6
            step[:, k] = np.linalg.solve(got[k, p:].reshape(p, p) + ridge, got[k, :p] - ridge @ beta[:, k])
        size = np.abs(step).max()
        beta += step * min(1.0, 4.0 / max(size, 1e-9))
        if size < 1e-4:
            break
    return Model(weights, mean, scale, beta, prior)


def logit(p):
    return F.log(p / (1 - p))


def strength(groups: DataFrame, rate: str, parent: str) -> float:
    """Pseudo-documents of the prior: from the spread of group means around their parents beyond chance."""
    d = F.col(rate) / F.col("n") - F.col(parent)
    got = (groups.where("n > 1").agg(F.sum(F.col("n") * d * d).alias("spread"), F.sum(F.col(parent) * (1 - F.col(parent))).alias("chance"),
                                     F.sum("n").alias("n"), F.count("*").alias("groups")).first())
    if not got["groups"] or got["chance"] <= 0:
        return 100.0
    mean_var = got["chance"] / got["groups"]
    between = max(0.0, (got["spread"] - got["chance"]) / got["n"])
    return float(min(1e6, max(20.0, mean_var / between - 1))) if between > 0 else 1e6


def site(docs: DataFrame, source: str = "source", lang: str = "lang") -> tuple:
    """Host and path of a source; a source without a path has its language as path."""
    plain = F.regexp_replace(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.substring_index(plain, "/", 1))
    first = F.regexp_extract(plain, r"^[^/]*/([^/?#]*)", 1)
    return host, F.concat_ws(" ", first, F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, reject: float = 0.5) -> DataFrame:
    """`docs` (with doc_id, text, source, lang) and p_low, p_toxic, keep; these names get a number if taken."""
    names = [fresh(docs, n) for n in ("p_low", "p_toxic", "keep")]
    model = fit(docs, labels)
    if model is None:
        return docs.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0.0), names[2]: F.lit(True)})

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            batch = pa.RecordBatch.from_arrays([pa.array(s, pa.string(), from_pandas=True)], ["text"])
            parts = [model.logits(part.column(0)) for part in chunks(batch, 0)]
            yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 2)), columns=list(TARGETS))
        give_back()

    # marked so that a filter on the verdict does not make Spark score every text again
    scored = F.pandas_udf(score, T.StructType().add("low", "double").add("toxic", "double")).asNondeterministic()
    host, path = site(docs)
    score_, host_, path_, post_ = (fresh(docs, n) for n in ("_score", "_host", "_path", "_site"))
    rows = docs.withColumn(score_, scored(F.col("text"))).withColumn(host_, host).withColumn(path_, path)

    own = lambda t: F.sum(1 / (1 + F.exp(-F.col(score_)[t])))
    paths = cut(rows.groupBy(F.col(host_).alias("host"), F.col(path_).alias("path")).agg(F.count("*").alias("n"), *[own(t).alias(t) for t in TARGETS]))
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])
    whole = hosts.agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)]).first()
    post = paths
    for t in TARGETS:
        g = min(1 - 1e-6, max(1e-6, (whole[t] or 0) / max(1, whole["n"] or 0)))
        level = hosts.withColumn("g", F.lit(g))
        k = strength(level, t, "g")
        shrunk = level.select("host", ((F.col(t) + k * F.col("g")) / (F.col("n") + k)).alias(f"{t}_host"))
        post = post.join(shrunk, "host")
        k = strength(post, t, f"{t}_host")
        # the site's prior odds over the global ones
        post = post.withColumn(f"{t}_shift", logit((F.col(t) + k * F.col(f"{t}_host")) / (F.col("n") + k)) - float(np.log(g / (1 - g))))
    post = cut(post.select(F.col("host").alias(host_), F.col("path").alias(path_), F.struct(*[F.col(f"{t}_shift").alias(t) for t in TARGETS]).alias(post_)))
    joined = rows.join(post, [host_, path_], "left")
    p = [1 / (1 + F.exp(-(F.col(score_)[t] + F.coalesce(F.col(post_)[t], F.lit(0.0))))) for t in TARGETS]
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], p[0].alias(names[0]), p[1].alias(names[1]),
                         ((p[0] <= reject) & (p[1] <= reject)).alias(names[2]))
