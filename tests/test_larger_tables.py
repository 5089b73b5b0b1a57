"""Steps that once failed or grew on larger tables."""

import re

from pyspark.sql import functions as F

from evenkeel.session import cut


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def label_rows(spark):
    return cut(spark.range(200).select(
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("annotator"), F.col("id").alias("blinded_id"), F.lit("B1").alias("benchmark"), F.lit("x").alias("axis"),
        F.lit("binary").alias("kind"), F.lit("stable_high_dif").alias("grp"), F.lit("phi").alias("disc_family"), F.lit("phi").alias("val_family"),
        (F.col("id") % 2).cast("int").alias("value")))


def test_labels_of_two_annotators_are_not_broadcast(spark):
    from evenkeel.operators import annotation

    kappa = annotation.kappa_table(label_rows(spark), ("a", "b"))
    assert "BroadcastExchange" not in planned(kappa)
    assert [tuple(r) for r in kappa.collect()] == [("x", 1.0)]


def test_payload_batches_are_not_broadcast(spark):
    from evenkeel.plans import annotation_queries
    from evenkeel.plans.fixture import fixture

    batches, _ = annotation_queries.payloads(fixture(spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin [blinded_id" in planned(batches)


def test_values_of_permuted_items_are_not_broadcast(spark):
    from evenkeel.operators import annotation

    joins = [line for line in planned(annotation.family_direction(label_rows(spark), 3, 1)).splitlines() if "Join [" in line]
    assert [line for line in joins if "_k#" in line or "blinded_id#" in line]
    assert not [line for line in joins if "Broadcast" in line and ("_k#" in line or "blinded_id#" in line)]


def test_items_are_trimmed_as_by_sql(spark):
    from evenkeel.operators import prepare

    t = spark.createDataFrame([("\u00a0q ", ["\u3000a\u2003", " \u00a0", "b\n"]), (" q", None)], "q string, o array<string>")
    assert [r[0] for r in t.select(prepare.item_text(F.col("q"), F.col("o"))).collect()] == ["q\na\nb\n", "q"]
    assert t.select(prepare.source_family(F.lit("\u00a0ORI x"))).first()[0] == "ori"


def test_contract_counts_cells_in_blocks_of_items(spark):
    from evenkeel.sources import contracts

    models = spark.createDataFrame([(1, "f", "o")], "model_id long, family string, owner string")
    items = spark.createDataFrame([(1, "g")], "item_id long, item_group string")

    def found(rows):
        cells = spark.createDataFrame(rows, "benchmark string, item_id long, model_id long, y int")
        got = contracts.validate_responses(cells, models, items, ["benchmark"])
        rules = {r["rule"]: r["violations"] for r in got.collect()}
        return planned(got), [rules[k] for k in ("not_binary", "repeated_cell", "missing_cell")]

    whole = [(b, i, m, 0) for b in "ab" for i in (-1, 0, 63, 64, 200) for m in (1, 2)]
    plan, counts = found(whole)
    assert counts == [0, 0, 0] and not re.search(r"keys=\[benchmark#\d+, item_id", plan)
    assert found(whole[1:] + [("a", 64, 1, 0)] * 2 + [("b", None, 2, None), ("b", None, 2, 3), (None, 5, 1, 1), (None, 5, 1, 1)])[1] == [2, 3, 3]


def test_orders_are_not_broadcast(spark):
    from evenkeel.plans.fixture import fixture

    plan = planned(fixture(spark, "/root/testdata/sf0.001").hits)
    assert "SortMergeJoin [l_orderkey" in plan and "Broadcast" not in plan


def test_terms_are_counted_where_texts_lie(spark):
    from evenkeel.operators import text

    t = spark.createDataFrame([(1, "aa bb aa bb"), (2, "bb"), (1, "bb"), (3, None)], "item_id long, text string")
    counts = text.term_counts(t)
    assert planned(counts).count("Exchange") == 1
    assert sorted(tuple(r) for r in counts.collect()) == [
        (1, "aa", 2), (1, "aa bb", 2), (1, "bb", 3), (1, "bb aa", 1), (2, "bb", 1)]


def test_near_items_meet_in_blocks(spark, monkeypatch):
    from evenkeel.operators import matching

    monkeypatch.setattr(matching, "BLOCK", 3)
    monkeypatch.setattr(matching, "CHUNK_PAIRS", 4)
    rows = [(k, "ab"[k % 7 == 0] if k % 11 else None, k % 2 == 0, None if k == 8 else (k * 37 % 60 - 30) / 20,
             [k * 13 % 10 / 10] if k % 9 == 0 else [k * 13 % 10 / 10, None if k == 21 else float(k % 3)]) for k in range(120)]
    items = spark.createDataFrame(rows, "item_id long, cell string, selected boolean, intercept double, profile array<double>")
    got = matching.pair_candidates(items, [], 0.5)
    assert "FlatMapGroupsInArrow" in planned(got)
    want = []
    for a in rows:
        for b in rows:
            if a[2] and not b[2] and a[1] is not None and a[1] == b[1] and None not in (a[3], b[3], *a[4], *b[4]) and len(a[4]) == len(b[4]):
                gap, cost = (a[3] - b[3]) ** 2, sum((x - y) ** 2 for x, y in zip(a[4], b[4]))
                if gap <= 0.25 + 1e-12 and cost <= 0.25 + 1e-12:
                    want.append((a[1], a[0], b[0], cost, gap))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 100


def test_blocks_are_reported_by_bits(spark):
    from evenkeel.sources import tables

    def report(cells):
        layout = spark.createDataFrame([("a", 0, 70), ("b", 70, 100)], "dataset string, start long, stop long")
        index = spark.createDataFrame([("m", 0), ("n", 1)], "name string, model_index long")
        got = tables.assembly_report(spark.createDataFrame(cells, "dataset string, local_item long, name string, y int"), layout, index)
        plan = planned(got)
        return plan, {r["dataset"]: tuple(r)[1:] for r in got.collect()}

    whole = [("a", i, m, i % 2) for i in range(70) for m in "mn"] + [("b", 3, "m", 1)]
    plan, counts = report(whole)
    assert counts == {"a": (140, 70, 0, 0, 0), "b": (1, 1, 0, 0, 0)} and not re.search(r"keys=\[[^\]]*item", plan)
    more = [("a", 5, "m", 1), ("a", 5, "m", 0), ("a", 63, "n", 1), ("a", 70, "m", 1), ("a", -1, "m", 0), ("a", 1, "x", 1), ("a", 1, "y", 1), ("a", 2, "x", 0),
            ("b", None, "n", None), ("b", None, "n", 1), ("c", 1, "m", 1)]
    assert report(whole + more)[1] == {"a": (148, 75, 2, 2, 3), "b": (3, 2, 0, 0, 1)}


def test_successes_are_counted_as_bits(spark):
    from evenkeel.plans.fixture import Fixture

    fx = Fixture(spark, "/root/testdata/sf0.001")
    t = spark.createDataFrame([("A", 1, 0), ("A", 1, 0), ("A", 1, 63), ("A", 1, 199), ("A", 1, -1), ("A", 1, -1), ("A", 1, None), ("A", 1, None), (None, 1, 64), ("N", 2, 128), ("N", None, 1)],
                              "benchmark string, model_id long, item_id long")
    fx.__dict__["bought"] = t
    assert sorted((str(r["benchmark"]), str(r["model_id"]), r["s"]) for r in fx.hit_bits.collect()) == [("A", "1", 5), ("N", "2", 1), ("N", "None", 1), ("None", "1", 1)]
    got = fx.dense(spark.createDataFrame([(1,), (2,), (3,)], "model_id long"))
    assert "collect_set" not in planned(got) and got.count() == 1800
    assert sorted((r["model_id"], r["benchmark"], r["item_id"]) for r in got.where("y = 1").collect()) == [(1, "A", 0), (1, "A", 63), (1, "A", 199), (2, "N", 128)]
