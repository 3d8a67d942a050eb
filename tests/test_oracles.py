"""Every registered query of the reference's own operators against its SQL, run by DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from stackloom.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, list | tuple):
        return tuple(_plain(v) for v in value)
    return value


def _sorted_rows(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(_plain(row[i]) for i in order)) for row in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF_DIR)
    if name not in catalogue.ORACLE_SQL:
        assert ours.count() >= 0
        return
    theirs = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert _sorted_rows(ours.columns, [tuple(r) for r in ours.collect()]) == _sorted_rows(columns, theirs.fetchall())


def test_every_sql_belongs_to_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
