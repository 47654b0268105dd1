"""Every registered query against its SQL on the smallest tables.

Running all takes a quarter of an hour, so by default a query is planned and its columns are held against those of its
SQL, and of those that build the whole chain only the SQL is bound; with VIGIL_ALL_QUERIES set all run and rows are compared.
"""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__  # noqa: F401  registers all
from vigil.queries import ORACLE, QUERIES

EVERY = bool(os.environ.get("VIGIL_ALL_QUERIES"))
SF = "/root/testdata/sf0.001"
WHOLE = sorted(n for n in QUERIES if "personal" in ORACLE.get(n, "personal") or n.startswith(("e0", "a21", "t09_resumed", "t10")))
QUICK = sorted(set(QUERIES) - set(WHOLE))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def held(spark, db, name):
    df = QUERIES[name](spark, SF)
    if not EVERY and name in ORACLE:
        assert sorted(df.columns) == sorted(r[0] for r in db.execute(f"DESCRIBE {ORACLE[name]}").fetchall())
        return
    if name not in ORACLE:
        assert df.count() >= 0
        return
    got, found = rows_of(df.columns, df.collect()), db.execute(ORACLE[name])
    assert got == rows_of([d[0] for d in found.description], found.fetchall())


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, db, name):
    held(spark, db, name)


@pytest.mark.parametrize("name", WHOLE)
def test_query_of_the_whole_chain(spark, db, name):
    if EVERY:
        held(spark, db, name)
    elif name in ORACLE:
        assert db.execute(f"DESCRIBE {ORACLE[name]}").fetchall()
