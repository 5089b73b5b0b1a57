"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it kept; all but
the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import jaccard, packing, pii, quality
from evenkeel.llm.common import fresh, table, without
from evenkeel.session import cut

WORDS, PERCENT = 5, 80  # shingles and similarity of near-duplicates


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    keep = fresh(docs, "keep")
    return quality.classify(docs, table(spark, sf_dir, "labels")).where(F.col(keep)).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest (doc_id, text) of each group of near-duplicates, a null doc_id being the largest.

    Rows are told apart by doc_id, or, if that repeats or is null anywhere, by a number written once.
    """
    key = fresh(docs, "_row")
    ids = docs.groupBy("doc_id").count().agg(F.count_if((F.col("count") > 1) | F.col("doc_id").isNull())).first()[0]
    rows = docs.withColumn(key, F.col("doc_id")) if not ids else cut(docs.withColumn(key, F.monotonically_increasing_id()))
    groups = cut(jaccard.jaccard_groups(rows, WORDS, PERCENT, doc_id=key).select(F.col("doc_id").alias(key), "component_id"))
    if not ids:
        others = groups.where(F.col(key) != F.col("component_id"))
    else:
        first = rows.join(groups, key).groupBy("component_id").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text", key)).getField(key).alias(key))
        others = groups.join(first, key, "left_anti")
    return without(rows, cut(others.select(key)), key).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced and n_chars brought up to date."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its sequence and its place there."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("pii", without_personal_data),
    ("best-fit packing", packed),
]

# No stage can be said in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
