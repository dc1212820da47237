"""Every evidence-synthesis query against its SQL, and the registry's contract."""

import pytest

from metasift.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
