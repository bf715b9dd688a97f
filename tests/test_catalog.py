import pytest

from compare import difference, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def names():
    import __spark_entry__ as entry

    return sorted(entry.queries())


def pytest_generate_tests(metafunc):
    if "query" in metafunc.fixturenames:
        metafunc.parametrize("query", names())


def test_query(spark, con, sf_dir, query):
    import __spark_entry__ as entry

    got = entry.queries()[query](spark, sf_dir).toArrow()
    sql = entry.oracle_sql().get(query)
    assert got.num_rows > 0
    if sql is not None:
        assert difference(got, con.execute(sql).to_arrow_table()) is None


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
