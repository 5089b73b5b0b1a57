"""Weights of terms by tasks over whole items, against counting every term of every item."""

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import text

TEXTS = [(1, "Aa bb aa bb cc"), (2, "bb cc. bb"), (1, "cc aa"), (3, None), (4, ""), (5, "ab ΣΑΣ İx ab\nΣΑΣ aa  bb"), (6, "dd ee ff dd ee ff"), (7, "ee ff gg dd"),
         (8, "a b c"), (9, "hh ii hh ii"), (9, "hh ii"), (10, "ii hh 12 ab_c é1"), (11, "É1 ab_c 12 zz")]


def rows(df):
    return sorted((r["item_id"], r["term"], round(r["weight"], 12)) for r in df.collect())


@pytest.mark.parametrize("features", [1, 3, 5, 8, 13, 1000])
def test_weights_equal_those_of_all_terms(spark, monkeypatch, features):
    monkeypatch.setattr(text, "SLICE", 16)
    items = spark.createDataFrame(TEXTS, "item_id long, text string").repartition(3)
    counts = text.term_counts(items)
    want = rows(text.tfidf(counts, text.vocabulary(counts, 13, features)))
    assert rows(text.term_weights(items, 13, features)) == want and want
    monkeypatch.setattr(text, "HEAD_BYTES", 1 << 40)
    assert rows(text.term_weights(items, 13, features)) == want


def test_only_bigrams_of_frequent_words_are_counted(spark, monkeypatch):
    seen = []
    count = text.bigram_counts
    monkeypatch.setattr(text, "bigram_counts", lambda words, heads: seen.append(heads.to_pylist()) or count(words, heads))
    items = spark.createDataFrame([(k, f"the of w{k} w{k + 1} the of the x{k}") for k in range(50)], "item_id long, text string")
    got = text.term_weights(items, 50, 3)
    assert sorted(seen[0]) == ["of", "the", *sorted(f"w{k}" for k in range(1, 50))]
    assert {r["term"] for r in got.select("term").distinct().collect()} == {"the", "of", "the of"}


def test_no_terms_no_weights(spark):
    assert text.term_weights(spark.createDataFrame([(1, None), (2, "a")], "item_id long, text string"), 2, 5).count() == 0


def test_letters_are_counted_on_bytes(spark, monkeypatch):
    monkeypatch.setattr(text, "SLICE", 8)
    items = spark.createDataFrame([(1, "abca éa\U0001f600b"), (2, None), (3, ""), (4, "A ccc")], "item_id long, text string").coalesce(1)
    got = {r["item_id"]: r["features"] for r in text.letter_counts(items, "abc").collect()}
    assert got == {1: [3.0, 2.0, 1.0], 2: [0.0] * 3, 3: [0.0] * 3, 4: [0.0, 0.0, 3.0]}


def test_texts_are_read_into_features_by_tasks(spark):
    from evenkeel.plans import prediction_queries
    from evenkeel.plans.fixture import fixture

    _, blocks = prediction_queries.feature_blocks(fixture(spark, "/root/testdata/sf0.001"))
    plans = [b._jdf.queryExecution().optimizedPlan().toString() for b in blocks.values()]
    # terms and letters were counted again wherever a block was read
    assert not any("text#" in p or "regexp_extract_all" in p for p in plans)
    assert blocks["svd"].agg(F.countDistinct("feature")).first()[0] == 4
