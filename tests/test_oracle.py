import pytest

from oracle import connect, duck_rows, spark_rows
from tessella.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    names, rows = spark_rows(QUERIES[name](spark, SF))
    want_names, want = duck_rows(con, ORACLE_SQL[name])
    assert names == want_names
    assert len(rows) == len(want)
    for a, b in zip(rows, want, strict=True):
        assert a == pytest.approx(b, abs=2e-4) if all(isinstance(x, (int, float)) for x in a + b) else a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
