"""Sparse item features: n-gram weights, one-hot metadata, low-rank projections."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import bucketed_row_number
from ..session import cut, small_enough

WORD = r"[\p{L}\p{N}_]{2,}"


def words_of(text: Column) -> Column:
    """Lower-cased words of two or more letters, from the whole text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"))


def grams(text: Column) -> Column:
    """Words and their bigrams."""
    return F.transform(F.array(words_of(text)), lambda w: F.concat(w, F.when(F.size(w) > 1, F.transform(
        F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))))
        .otherwise(F.array().cast("array<string>"))))[0]


def term_counts(items: DataFrame, text: str = "text") -> DataFrame:
    """Terms of each item with their counts. The texts are dealt by item, so that their many terms are counted where they arise."""
    return items.select("item_id", text).repartition("item_id").select("item_id", F.explode(grams(F.col(text))).alias("term")).groupBy("item_id", "term").agg(
        F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_items: int, max_features: int, min_items: int = 2) -> DataFrame:
    """The most frequent terms with their inverse document frequency (smoothed), ties by term."""
    return _best(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")), n_items, max_features, min_items)


def _best(t: DataFrame, n_items: int, max_features: int, min_items: int) -> DataFrame:
    kept = t.filter(F.col("df") >= min_items).orderBy(F.col("total").desc(), "term").limit(max_features)
    return kept.withColumn("idf", F.log((1.0 + n_items) / (1.0 + F.col("df"))) + 1.0)


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sublinear tf times idf, unit length per item. The vocabulary is bounded by its limit and broadcast."""
    raw = counts.join(F.broadcast(vocab.select("term", "idf")), "term").withColumn(
        "_w", (1.0 + F.log("tf")) * F.col("idf"))
    norm = raw.groupBy("item_id").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
    return raw.join(norm, "item_id").select("item_id", "term", (F.col("_w") / F.col("_n")).alias("weight"))


SLICE = 1 << 22  # bytes of text that a task holds as arrays at once, or one text
HEAD_BYTES = 64  # of a frequent word, about


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy())
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _tokens(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each word its row and its place among the distinct ones, and these."""
    lists = pc.split_pattern(words, " ")
    flat = lists.flatten().dictionary_encode()
    return pc.list_parent_indices(lists).to_numpy().astype(np.int64), flat.indices.to_numpy().astype(np.int64), flat.dictionary


def _spread(rows: np.ndarray, kinds: np.ndarray, n: int) -> np.ndarray:
    """In how many rows each kind is found."""
    return np.bincount(np.unique(rows * n + kinds) % n, minlength=n) if len(rows) else np.zeros(n, np.int64)


def _neighbours(rows: np.ndarray, known: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers (first * n + second) of the pairs of words next to each other that are both known (not below 0)."""
    at = np.flatnonzero((known[:-1] >= 0) & (known[1:] >= 0) & (rows[:-1] == rows[1:]))
    return rows[at], known[at] * n + known[at + 1]


COUNTED = "term string, df bigint, total bigint"


def item_words(items: DataFrame, text: str = "text") -> DataFrame:
    """(item_id, words): an item's words with blanks between them; a line end, which is no word, parts its texts."""
    t = items.select("item_id", F.array_join(words_of(F.col(text)), " ").alias("words")).where("words <> ''")
    if items.groupBy("item_id").count().where("count > 1").take(1):
        t = t.groupBy("item_id").agg(F.array_join(F.collect_list("words"), " \n ").alias("words"))
    return t


def word_counts(words: DataFrame) -> DataFrame:
    """Items and occurrences of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "words"):
            rows, codes, names = _tokens(part.column("words"))
            found = pa.RecordBatch.from_arrays([names, pa.array(_spread(rows, codes, len(names))), pa.array(np.bincount(codes, minlength=len(names)))], ["term", "df", "total"])
            yield found.filter(pc.not_equal(names, "\n"))

    return words.select("words").mapInArrow(run, COUNTED).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def bigram_counts(words: DataFrame, heads: pa.Array) -> DataFrame:
    """Items and occurrences of every bigram of two words of `heads`."""
    held, n = words.sparkSession.sparkContext.broadcast(heads), len(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "words"):
            rows, codes, names = _tokens(part.column("words"))
            rows, pairs = _neighbours(rows, pc.index_in(names, held.value).fill_null(-1).to_numpy().astype(np.int64)[codes], n)
            pairs, kinds, total = np.unique(pairs, return_inverse=True, return_counts=True)
            first, second = (held.value.take(pa.array(k)) for k in np.divmod(pairs, n))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, second, " "), pa.array(_spread(rows, kinds, len(pairs))), pa.array(total)], ["term", "df", "total"])

    return words.select("words").mapInArrow(run, COUNTED).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def term_weights(items: DataFrame, n_items: int, max_features: int, min_items: int = 2) -> DataFrame:
    """`tfidf` of the `vocabulary` of all words and bigrams of the items.

    A bigram is no more frequent than its words. So bigrams are counted only where both words are as
    frequent as the `max_features`-th word (`min_items` allowing): the others can't be among the best.
    Where ties make these words too many for a broadcast, all terms of all items are counted.
    """
    words = cut(item_words(items))
    counted = cut(word_counts(words))
    usable = counted.where(F.col("df") >= min_items)
    best = usable.orderBy(F.col("total").desc()).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least")).first()
    heads = usable.where(F.col("total") >= (best["least"] if best["n"] == max_features else 1))
    if not small_enough(heads.count(), HEAD_BYTES):
        counts = cut(term_counts(items))
        return tfidf(counts, cut(vocabulary(counts, n_items, max_features, min_items)))
    pairs = bigram_counts(words, heads.select("term").toArrow().column("term").combine_chunks())
    return _weights(words, _best(heads.unionByName(pairs), n_items, max_features, min_items))


def _weights(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """As `tfidf`; a task counts an item's terms of the vocabulary, which is bounded by its limit and broadcast."""
    chosen = vocab.select("term", "idf").toArrow()
    terms, idf = chosen.column("term").combine_chunks(), chosen.column("idf").to_numpy()
    split = [t.split(" ") for t in terms.to_pylist()]
    known = sorted({w for t in split for w in t})
    place, m = {w: k for k, w in enumerate(known)}, len(split)
    single = np.full(len(known) + 1, -1)  # the last for words that are not known
    for k, t in enumerate(split):
        if len(t) == 1:
            single[place[t[0]]] = k
    double = sorted((place[t[0]] * len(known) + place[t[1]], k) for k, t in enumerate(split) if len(t) == 2)
    keys, of = (np.array([*(d[c] for d in double), -1], np.int64) for c in (0, 1))
    keys[-1] = np.iinfo(np.int64).max
    held = words.sparkSession.sparkContext.broadcast((terms, idf, pa.array(known, terms.type), single, keys, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, known, single, keys, of = held.value
        for part in _slices(batches, "words"):
            rows, codes, names = _tokens(part.column("words"))
            found = pc.index_in(names, known).fill_null(-1).to_numpy().astype(np.int64)[codes]
            one = single[found]
            near, pairs = _neighbours(rows, found, len(known))
            at = np.searchsorted(keys, pairs)
            two = np.where(keys[at] == pairs, of[at], -1)
            cells, tf = np.unique(np.concatenate([(rows * m + one)[one >= 0], (near * m + two)[two >= 0]]), return_counts=True)
            row, term = np.divmod(cells, max(m, 1))
            raw = (1.0 + np.log(tf)) * idf[term]
            norm = np.sqrt(np.bincount(row, raw * raw, minlength=part.num_rows))
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(row)), terms.take(pa.array(term)), pa.array(raw / norm[row])], ["item_id", "term", "weight"])

    return words.select("item_id", "words").mapInArrow(run, f"item_id {words.schema['item_id'].dataType.simpleString()}, term string, weight double")


def letter_counts(items: DataFrame, letters: str) -> DataFrame:
    """(item_id, features): how often each of the (ASCII) letters is found in the text, counted on its bytes."""
    n = len(letters)
    code = np.full(256, n)
    code[list(letters.encode("ascii"))] = np.arange(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, "text"):
            text = part.column("text").fill_null("")
            data = np.frombuffer(b"".join(text.cast(pa.large_binary()).to_pylist()), np.uint8)
            rows = np.repeat(np.arange(len(text)) * (n + 1), pc.binary_length(text).to_numpy())
            counts = np.bincount(rows + code[data], minlength=len(text) * (n + 1)).reshape(-1, n + 1)[:, :n].astype(float)
            yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * n, pa.int32()), pa.array(counts.ravel()))], ["item_id", "features"])

    return items.select("item_id", "text").mapInArrow(run, f"item_id {items.schema['item_id'].dataType.simpleString()}, features array<double>")


def one_hot(items: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """(item_id, feature, index) of `name=value` features; values unseen in training are left out."""
    pairs = F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in columns])
    long = items.select("item_id", train.alias("_t"), F.explode(pairs).alias("feature"))
    seen = long.filter("_t").select("feature").distinct().withColumn("_all", F.lit(0))
    index = bucketed_row_number(seen, ["_all"], [F.col("feature")], F.substring("feature", 1, 3))
    return long.join(index.select("feature", (F.col("rn") - 1).alias("index")), "feature").select("item_id", "feature", "index")


def low_rank(items: DataFrame, rank: int, width: int, train: Column) -> DataFrame:
    """Project log1p features on the top right singular vectors of the training rows."""
    x = items.withColumn("_x", F.transform("features", lambda v: F.log1p(F.greatest(v, F.lit(0.0)).cast("double"))))
    vectors = MLUtils.convertVectorColumnsFromML(x.filter(train).select(array_to_vector("_x").alias("v")), "v")
    axes = RowMatrix(vectors, numCols=width).computeSVD(rank).V.toArray()
    dots = [F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(a)) for a in axes[:, k]]), lambda p, q: p * q), F.lit(0.0),
                        lambda s, v: s + v) for k in range(rank)]
    return x.select("item_id", F.array(*dots).alias("projection"))


def stack_features(blocks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Named blocks of (item_id, feature, value) as one long table with a dense feature index."""
    out = None
    for name, block in blocks:
        part = block.select("item_id", F.lit(name).alias("block"), F.concat(F.lit(f"{name}:"), F.col("feature")).alias("feature"), "value")
        out = part if out is None else out.unionByName(part)
    names = out.select("feature").distinct().withColumn("_all", F.lit(0))
    index = bucketed_row_number(names, ["_all"], [F.col("feature")], F.substring("feature", 1, 8))
    return out.join(index.select("feature", (F.col("rn") - 1).alias("index")), "feature")
