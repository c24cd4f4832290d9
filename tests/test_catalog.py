import pytest

from tests.oracle import assert_same, views
from tidegauge import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], con)


def test_entry_has_rows_and_no_missing_status(spark):
    rows = catalog.flagship(spark, SF).collect()
    assert rows and all(r.status for r in rows)
    assert {r.adjust for r in rows if r.status == "ok"} <= set(range(9))
