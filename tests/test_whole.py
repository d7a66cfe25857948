"""Queries that cover their whole input."""

import os

import pytest

from riacho.operators import statements
from riacho.plans import ORACLES, QUERIES
from tests.compare import FOLDER, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_stability_covers_every_pair(spark):
    pairs = {(r.i, r.j) for r in QUERIES["spearman_pairs"](spark, FOLDER).collect()}
    assert {(r.i, r.j) for r in QUERIES["bootstrap_stability_all"](spark, FOLDER).collect()} == pairs
    assert QUERIES["stability_verdict_all"](spark, FOLDER).first().n_pairs == len(pairs)


def test_scores_and_quarters_come_from_all_rows(spark):
    assert "row_id % 2" not in ORACLES["label_join_all"] and "ascii" not in ORACLES["statement_fallback_all"]
    assert not [r for r in QUERIES["label_join_all"](spark, FOLDER).collect() if r.reason == "keep" and r.quality is None]
    quarters = connect().execute(ORACLES["statement_fallback_all"]).fetchall()
    assert len({c for c, _, q in quarters if q is not None}) > len({c for c, _, q in connect().execute(ORACLES["statement_fallback"]).fetchall() if q is not None})


def test_companies_without_quarters_fall_back_to_years(spark):
    quarterly = spark.createDataFrame([("1", 2020, 1), ("1", 2020, 2)], "cnpj string, year int, quarter int")
    annual = spark.createDataFrame([("1", 2020), ("2", 2020)], "cnpj string, year int")
    got = {(r.cnpj, r.year, r.quarter) for r in statements.with_annual(quarterly, annual, "cnpj").collect()}
    assert got == {("1", 2020, 1), ("1", 2020, 2), ("2", 2020, None)}


def test_portfolios_are_drawn_as_often_as_in_the_reference(spark):
    assert QUERIES["random_portfolios_all"](spark, FOLDER).select("draw").distinct().count() == 10_000
    assert "range(10000)" in ORACLES["portfolio_outcomes_all"] and "range(10000)" in ORACLES["frontier_choice_all"]
