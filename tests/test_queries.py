"""Every registered query of the library against its SQL, on the smallest tables."""

import datetime
import math
import os

import pytest

from tapewright.plans import catalogue


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int | float) or type(value).__name__ == "Decimal":
        return "nan" if isinstance(value, float) and math.isnan(value) else float(f"{float(value):.9g}") + 0.0
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    return str(value)


@pytest.fixture(scope="module")
def db(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    out = duckdb.connect()
    out.execute("set TimeZone = 'UTC'")
    for file in os.listdir(sf_dir):
        out.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{file}')")
    return out


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_agrees_with_sql(spark, sf_dir, db, name):
    found = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    cursor = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in found.collect()) == sorted(repr([plain(r[k]) for k in at]) for r in cursor.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, sf_dir, name):
    catalogue.queries()[name](spark, sf_dir).collect()
