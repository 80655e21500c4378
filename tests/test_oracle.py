"""Every query against its SQL at the smallest scale."""

import pytest

from checks.compare import differences, oracle
from checks.queries import QUERIES, SQL
from tests.conftest import DATA

# Model queries without SQL have their own tests; here they and the one that fits all models would only cost time.
SLOW = {"train_compare", "importance", "predict", "score_scenarios", "cross_validate", "model_facts"}


@pytest.fixture(scope="module")
def connection():
    return oracle(DATA)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query_agrees_with_sql(spark, connection, name):
    assert differences(spark, connection, DATA, name) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
