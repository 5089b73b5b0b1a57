"""The family permutation test: enough draws for a signal, drawn in tasks from packed items."""

import hashlib

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import draws
from evenkeel.operators import annotation
from evenkeel.plans import annotation_queries as queries
from evenkeel.plans.fixture import Fixture
from evenkeel.session import cut


@pytest.fixture(scope="module")
def rows(spark):
    """Labels of two annotators in which one of ten binary axes follows the family."""
    items = spark.range(240).select(
        F.col("id").alias("blinded_id"), F.concat(F.lit("B"), (F.floor(F.col("id") / 2) % 2).cast("string")).alias("benchmark"), F.lit("en").alias("cell"),
        F.floor(F.col("id") / 2).cast("string").alias("pair_id"), F.when(F.col("id") % 2 == 1, annotation.GROUPS[0]).otherwise(annotation.GROUPS[1]).alias("grp"),
        F.element_at(F.array(*[F.lit(f) for f in queries.FAMILIES]), (F.floor(F.col("id") / 4) % 5 + 1).cast("int")).alias("disc_family"))
    axis = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.lit("binary" if a in queries.BINARY else "ordinal").alias("kind")) for a in queries.LETTERS]))
    drawn = F.pmod(F.xxhash64("axis", "blinded_id"), F.when(F.col("kind") == "binary", 2).otherwise(4))
    value = F.when(F.col("axis") == queries.BOOSTED, (F.col("disc_family") < "mistral").cast("long")).otherwise(drawn).cast("int")
    long = items.withColumn("val_family", F.col("disc_family")).withColumn("_x", axis).select("*", "_x.*").drop("_x").withColumn("value", value)
    return cut(long.withColumn("annotator", F.explode(F.array(*[F.lit(n) for n in queries.NAMES]))))


def test_one_axis_alone_can_give_a_signal(spark, rows):
    got = annotation.family_direction(rows, queries.PERMUTATIONS, queries.SEED).collect()
    assert {r["axis"] for r in got if r["dual_annotator_signal"]} == {queries.BOOSTED}
    assert min(r["permutation_p"] for r in got) == pytest.approx(1 / 10_001)


def test_replay_counts_the_signal(spark, rows, monkeypatch):
    monkeypatch.setattr(queries, "labels", lambda fx: rows)
    got = {r["metric"]: r["value"] for r in queries.content_replay(Fixture(spark, "/root/testdata/sf0.001")).collect()}
    assert got["dual_signal_axes"] == 1.0 and got["unique_items"] == 240.0


def test_packed_items_are_drawn_as_joined_ones(spark, rows, monkeypatch):
    at = F.col("blinded_id")
    odd = rows.where("NOT (blinded_id % 5 = 0 AND axis = 'formal_rule_reasoning')").withColumn("value", F.when(at % 7 != 0, F.col("value")))
    odd = odd.unionByName(odd.where(at % 9 == 0)).withColumn("benchmark", F.when(at % 13 != 0, F.col("benchmark")))
    odd = cut(odd.unionByName(odd.where(at == 3).withColumn("blinded_id", F.lit(None).cast("long"))))
    way = lambda: sorted(tuple(r) for r in annotation.family_direction(odd, 100, 7).select("annotator", "axis", F.round("statistic", 9), "permutation_p", "bh_q").collect())
    packed = way()
    monkeypatch.setattr(annotation, "PACKED_PERMUTATIONS", 101)
    assert packed == way() and len(packed) == 20
    monkeypatch.setattr(annotation, "PACKED_PERMUTATIONS", 100)
    monkeypatch.setattr(annotation, "PACKED_BYTES", 1 << 40)
    assert packed == way()


def test_order_is_that_of_the_keyed_hashes(monkeypatch):
    monkeypatch.setattr(draws, "CHUNK", 64)
    for tails in ([], [b""], [f"|{k}".encode() for k in range(1, 2000, 7)], [b"|" + b"x" * (k % 60) + b"%d" % k for k in range(300)], [b"|a", b"|b", b"|a"],
                  [f"|é{k}".encode() for k in range(100)]):
        order = draws.KeyedOrder(tails)
        for head in ("", "7", "31|home|annotator_a|B3", "31|annotator_b|B4|10000", "31|é|1"):
            keys = [(hashlib.md5(head.encode() + t).hexdigest(), k) for k, t in enumerate(tails)]
            assert order(head).tolist() == [k for _, k in sorted(keys)]
