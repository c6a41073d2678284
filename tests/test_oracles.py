"""Every registered query against its SQL twin."""

import pytest

from compare import compare, connect
from conftest import SMALL
from liftlake.plans import oracles, registry

SQL = oracles.all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_a_twin():
    assert set(SQL) == set(registry.QUERIES)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    assert compare(registry.run(name, spark, SMALL), con, SQL[name]) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("missing", ["liftlake.llm.registry", "corpus_pipeline"])
def test_entry_points_without_training_data_operators(monkeypatch, missing):
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, missing, None)  # as if it, or something it imports, were not installed
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.queries()) == set(registry.QUERIES)
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.oracle_sql()) == set(SQL)
