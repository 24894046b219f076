"""The registered queries agree with their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module

pytestmark = pytest.mark.integration
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_query_equals_sql(spark, duck, tiny, name):
    df = entry_module.queries()[name](spark, tiny)
    sql = entry_module.oracle_sql().get(name)
    got = df.collect()
    assert got
    if sql is None:
        return
    result = duck.execute(sql)
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(got, df.columns) == canonical(result.fetchall(), columns)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns[2:] == ["Metric", "File1", "File2", "Value"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
