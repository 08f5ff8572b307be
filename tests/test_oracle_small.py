"""Spark vs the DuckDB oracle at sf0.001 for the cheap SQL-checked queries."""
import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from revguard.sources.tables import TABLES
from tests.conftest import SF0001

SKIP_PREFIX = ("l", "x1", "t2b")


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, (float, Decimal)):
        return "0" if float(v) == 0 else f"{float(v):.6g}"
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


NAMES = [n for n in entry.oracle_sql() if n.startswith(("r", "a", "m", "d", "q", "t", "e2", "v7"))
         and not n.startswith(SKIP_PREFIX)]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF0001)
    s = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    o = _rows([d[0] for d in cur.description], cur.fetchall())
    assert s == o
