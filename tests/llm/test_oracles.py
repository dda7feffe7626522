import duckdb
import pytest

from linearspark.llm.queries import ORACLE, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda frame: sorted(map(repr, frame[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
