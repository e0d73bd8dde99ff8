"""Every query against its SQL in DuckDB."""

import pytest

from ledgerflow import queries


def spelled(value):
    if value is None or value != value:
        return None
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def frame(df, columns):
    return sorted((tuple(map(spelled, r)) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_gives_the_rows_of_its_sql(name, spark, sf_dir, duck):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert frame(got, columns) == frame(want, columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_gives_rows(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
