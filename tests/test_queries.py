"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as driver
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# The composite jobs are run, and looked into, by test_jobs.
COMPOSITE = {"feature_report", "run_summary", "reward_baseline_scores"}

# Fits that SQL cannot state. The operators are compared with numpy or brute force where named.
FITS = {
    "generated_descriptions": "test_jobs: prompts and answers by hand",
    "fitted_encoder_activity": "test_models: gradients, planted directions, independence of tasks",
    "delta_probe": "test_models: Newton's method",
    "controlled_lasso_selection": "test_models: optimality conditions",
    "plain_lasso_selection": "test_models: optimality conditions",
    "selection_sweep": "test_models: optimality conditions and probes",
}


def own_queries():
    return sorted(n for n in driver.queries() if not n.startswith("op") and n != "pipeline")


@pytest.mark.parametrize("name", sorted(set(own_queries()) & set(driver.oracle_sql())))
def test_query_agrees_with_sql(spark, con, name):
    verdict, n, _ = compare(spark, con, name, SF)
    assert verdict in ("exact", "close"), verdict
    assert n > 0


def test_queries_without_sql_are_tested_otherwise():
    assert set(own_queries()) - set(driver.oracle_sql()) == COMPOSITE | set(FITS)


def test_entry_returns_rows(spark):
    assert driver.entry(spark).count() == 2


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_descriptions_are_generated_with_the_defaults(monkeypatch):
    from pairlens.operators.interpret import InterpretConfig
    from pairlens.queries import models

    seen = []
    monkeypatch.setattr(models.derived, "preferences", lambda *a: None)
    monkeypatch.setattr(models, "acts", lambda *a: None)
    monkeypatch.setattr(models, "interpret", lambda acts, texts, cfg, completer: seen.append(cfg))
    models.generated_descriptions(None, None)
    assert seen == [InterpretConfig()]
