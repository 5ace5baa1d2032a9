"""Driver contract: entry() smoke run; every SQL-twinned query equals DuckDB at sf0.001."""

import datetime as dt
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from retailops.workloads import load_all

SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["o_orderkey", "o_custkey", "c_name", "n_name", "r_name", "o_orderdate",
                          "o_totalprice", "o_orderstatus"]


def test_every_query_has_sql():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    own = load_all()[0]
    assert set(own) <= set(s)  # only operators of the training-data subpackage may lack a twin


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 4) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_duckdb(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cur = duck.execute(E.oracle_sql()[name])
    got = _canon(df.columns, [tuple(r) for r in df.collect()])
    want = _canon([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    # column types agree too (Spark simple type -> DuckDB type name)
    duck_types = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {E.oracle_sql()[name]}").fetchall()}
    for f in df.schema.fields:
        st = f.dataType.simpleString()
        assert SPARK_TO_DUCK.get(st, st.upper()) == duck_types[f.name], (f.name, st, duck_types[f.name])


def test_sample_and_backups_repeat(spark, duck):
    q = E.queries()
    # 50 distinct real line items, the same rows on a second run
    rows = {tuple(r) for r in q["a14_seeded_sample"](spark, SF_SMALL).collect()}
    real = set(duck.execute("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem").fetchall())
    assert len(rows) == 50 and rows <= real
    assert rows == {tuple(r) for r in q["a14_seeded_sample"](spark, SF_SMALL).collect()}
