"""Centroid clustering against its SQL, on odd tables and wide values."""

import duckdb
import numpy as np
import pytest

from linearspark.llm import centroids as C

from .conftest import assert_same_rows

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance string"


@pytest.mark.parametrize("n", [0, 5, 300])
def test_odd_tables_match_sql(spark, tmp_path, n):
    dice = np.random.default_rng(n)
    rows = [(i, dice.normal(0, 2, 64).tolist()) for i in range(n)]
    rows += rows[:7] + [(None, [0.5] * 64), (None, [0.25] * 64)] * bool(n)
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [float("nan")] * 64),
             (905, [float("-inf")] + [0.0] * 63), (906, [None] + [0.0] * 63)]
    rows += [(1000 + i, [-0.001] * 64) for i in range(n // 3)]        # copies
    vectors = spark.createDataFrame([(i, x, 1, "c", "d") for i, x in rows], SCHEMA)
    vectors.write.parquet(str(tmp_path / "v"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/v/*.parquet')")
    assert_same_rows(C.cluster(vectors), con, C.OP12_SQL)


def test_distances_by_code_are_exact():
    dice = np.random.default_rng(1)
    x = dice.integers(-C.MAX_COMPONENT, C.MAX_COMPONENT, (200, 7))
    x[50:100] = x[:50]
    centroids = np.vstack([x[:3], x[:2]])                             # ties: the smaller number
    codes, entries = C.encode(x, 3)
    assert [len(e) for e in entries] == [150, 150, 150]
    best, distance = C.nearest(codes, entries, centroids)
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centroids] for v in x]
    assert best.tolist() == [w.index(min(w)) for w in want]
    assert distance.tolist() == [min(w) for w in want]


def test_too_large_component_is_an_error(spark):
    vectors = spark.createDataFrame([(1, [1e12] * 64, 1, "c", "d")], SCHEMA)
    with pytest.raises(Exception, match="may not fit a long"):
        C.cluster(vectors).count()
