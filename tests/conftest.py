import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("QUERN_DRIVER_MEMORY", "3g")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quern.session import local_session

    session = local_session(4, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{name}") else "")
        con.execute(f"create view {name.split('.')[0]} as select * from '{path}'")
    return con


def plain(x):
    """A value as text, so that both engines' rows can be compared."""
    if x is None:
        return ""
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return "" if x != x else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def rows_of(rows, columns):
    return sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


@pytest.fixture(scope="session")
def agree(spark, sf_dir, duck):
    """Asserts that a query and its SQL give the same rows."""

    def run(query, sql):
        got = query(spark, sf_dir)
        want = duck.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)

    return run
