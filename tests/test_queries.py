"""A cross-section of the registered queries against DuckDB on the smallest data."""

import pytest

from oracle_check import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = ["owner_cap", "owner_balanced_split", "population_variants", "anchor_select", "pairwise_reversals", "kendall_tau_b", "gap_curve",
         "reversal_summary", "control_summary", "composition_bootstrap", "validate_responses", "merge_sources", "item_runs",
         "content_match_status", "sensitive_scan", "fit_item_intercepts", "dtf_curves", "tfidf", "choose_threshold", "weighted_alpha",
         "pair_candidates", "source_extremes", "paired_binary", "family_direction", "exact_common_models"]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    from evenkeel.plans.catalogue import ORACLES, QUERIES

    assert compare(QUERIES[name](spark, FOLDER).toPandas(), con.execute(ORACLES[name]).df()) == "ok"


def test_contract_names_the_broken_rule(spark):
    from evenkeel.sources import contracts

    cells = spark.createDataFrame([(1, 1, 0), (1, 2, 2)], "item_id long, model_id long, y int")
    models = spark.createDataFrame([(1, "f", "o"), (2, " ", "o")], "model_id long, family string, owner string")
    items = spark.createDataFrame([(1, "g")], "item_id long, item_group string")
    with pytest.raises(ValueError, match="not_binary"):
        contracts.require_valid(contracts.validate_responses(cells, models, items))


def test_results_are_not_overwritten(spark, tmp_path):
    from evenkeel.sources import tables

    df = spark.createDataFrame([(1, float("nan"))], "id long, v double")
    tables.write_results({"t": df}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "t")).first()["v"] is None
    with pytest.raises(Exception):
        tables.write_results({"t": df}, str(tmp_path / "out"))
