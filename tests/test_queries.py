"""Every query against its SQL, or at least run, on the small tables."""

import pytest

from grainmill.plans.oracles import oracle_sql
from grainmill.plans.queries import ALL
from tests.conftest import DATA

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, same):
    same(ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(name, spark):
    assert ALL[name](spark, DATA).columns


def test_every_sql_has_a_query():
    assert set(SQL) <= set(ALL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
