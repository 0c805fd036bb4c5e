"""Every registered query of the factor engine against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from barloom import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v if v is None else str(v)


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", [*queries.oracle_sql()])
def test_query_equals_sql(spark, tables, name):
    found = queries.queries()[name](spark, str(DATA))
    names = sorted(found.columns)
    answer = tables.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    want = sorted(str([shown(row[i]) for i in at]) for row in answer.fetchall())
    assert sorted(str([shown(row[n]) for n in names]) for row in found.collect()) == want


def test_every_query_has_sql_or_a_test():
    assert {*queries.queries()} == {*queries.oracle_sql()}
