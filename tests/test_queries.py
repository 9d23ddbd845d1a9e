"""Every registered query that has SQL gives the same rows as that SQL."""

import pytest

from checks import oracle_sql, queries
from checks.compare import connect, difference


# Fits with default rounds and trees, or several of them: minutes each, at any scale. The models
# and jobs behind them have tests of their own; ``python -m checks.compare`` runs these queries.
LONG = {
    "gbt_classifier", "gbt_classifier_joint", "gbt_regressor", "xgb_classifier", "xgb_regressor", "lgbm_classifier",
    "lgbm_regressor", "random_forest_classifier", "random_forest_regressor", "linear_svc", "run_experiments",
    "run_ablation", "run_large_table",
}


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - LONG))
def test_agrees_with_sql(spark, connection, folder, name):
    _, problem = difference(spark, connection, folder, name)
    assert problem is None
