import pytest

import __spark_entry__ as entry
from tests.compare import same
from tests.conftest import SF
from tidemark.plans import catalog


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, name):
    if name not in catalog.SQL:
        assert catalog.QUERIES[name](spark, SF).count() > 0
        return
    ok, said = same(spark, name, catalog.QUERIES[name], catalog.SQL[name], SF)
    assert ok, said


def test_plans(spark):
    plan = lambda df: df._jdf.queryExecution().toString()
    log = catalog.log(spark, SF)
    scan = plan(catalog.reconcile.scan(log, b"3", b"6"))
    assert "WindowGroupLimit" in scan
    assert "Exchange hashpartitioning" not in plan(catalog.reconcile.get(log, b"7"))
