import pytest
from checks import same
from conftest import SMALL

import __spark_entry__ as entry
from factloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLES[name], SMALL)


def test_entry_has_a_result(spark):
    assert entry.entry(spark).columns == ["id", "source_path", "degree"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
