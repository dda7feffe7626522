"""Every registered query against its SQL oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from linearspark.registry import SMALL_ORACLE

SQL = E.oracle_sql() | SMALL_ORACLE
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple("~" if v is None else (round(v, 6) + 0.0 if isinstance(v, float) else str(v)) for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = _norm(sdf.select(*cols).collect())
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    drows = res.fetchall()
    order = [dcols.index(c) for c in cols]
    assert srows == _norm([tuple(r[i] for i in order) for r in drows])


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["k", "w"]
