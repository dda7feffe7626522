"""Queries do their whole job on tables of any size; every test builds its own rows."""

import time

import pytest

from linearspark.operators import features as FT
from linearspark.registry import ORACLE, QUERIES
from linearspark.registry import data as DATA
from linearspark.registry import training as TRAINING
from linearspark.registry.data import _dense_facts
from linearspark.session import scratch_path
from linearspark.sources import tables as T


def order_tables(spark, orders):
    """A folder with ``orders`` orders of two lines each."""
    root = scratch_path(spark, "tables")
    ids = spark.range(orders)
    ids.selectExpr("id AS o_orderkey", "if(id % 3 = 0, 'F', 'O') AS o_orderstatus").write.parquet(f"{root}/orders.parquet")
    ids.selectExpr("id AS l_orderkey", "explode(array(id % 7, 7 + id % 5)) AS l_suppkey",
                   "CAST(1 + id % 50 AS DOUBLE) AS l_quantity").write.parquet(f"{root}/lineitem.parquet")
    return root


@pytest.mark.parametrize("orders, batch", [(2000, 1500), (300, 270)])
def test_early_stop_draws_its_whole_batch(spark, monkeypatch, orders, batch):
    drawn = []

    def train(ex, feats, dim, steps, n, **kw):
        from linearspark.plans.batches import draw
        drawn.append((steps, draw(ex, n, kw["seed"], 1).count()))
        return None, [(0, 1.0, 0.5)]

    monkeypatch.setattr(TRAINING.VZ, "train_hinge", train)
    TRAINING.train_early_stop(spark, order_tables(spark, orders))
    assert drawn == [(30, batch)]
    assert ORACLE["train_early_stop"].count("LIMIT 1500)") == 30


def _rows(df):
    return sorted((r["id"], list(r["x"])) for r in df.collect())


def test_dense_rows(spark):
    packed = spark.createDataFrame(
        [(1, [0, 3], [1.0, 2.5]), (2, [], []), (3, [4, 0], [None, -1.0]), (4, [-1, 2, 9], [7.0, 8.0, 9.0]), (5, None, None)],
        "id long, idx array<long>, val array<double>")
    want = [(1, [1.0, 0.0, 0.0, 2.5, 0.0]), (2, [0.0] * 5), (3, [-1.0, 0.0, 0.0, 0.0, 0.0]), (4, [0.0, 0.0, 8.0, 0.0, 0.0]), (5, [0.0] * 5)]
    assert _rows(FT.densify(packed, 5)) == want
    facts = FT.densify(packed, 5, measure=lambda x: [x.sum(axis=1)], fields="s double")
    assert sorted(map(tuple, facts.collect())) == [(i, sum(x)) for i, x in want]
    for keys in ([1, 1], [1, None]):
        with pytest.raises(Exception):
            FT.densify(spark.createDataFrame([(1, keys, [1.0, 2.0])], packed.schema), 5).collect()


def test_dense_rows_of_many_blocks(spark):
    n, dim = 3000, 20_001                       # 60 million numbers in one task
    packed = spark.range(n, numPartitions=1).selectExpr("id", "array(0L, 1 + id) AS idx", "array(1D, CAST(2 + id AS DOUBLE)) AS val")
    facts = FT.densify(packed, dim, measure=_dense_facts, fields="n int, pos_sum double, nnz long")
    started = time.monotonic()
    assert sorted(map(tuple, facts.collect())) == [(i, dim, 1.0 + (i + 2) ** 2, 2) for i in range(n)]
    assert time.monotonic() - started < 30      # 2.4 us a number (sf0.1, 8 cores) when every number was looked up in a map
    assert _rows(FT.densify(packed.limit(70), 20_001))[69][1][:72] == [1.0] + [0.0] * 69 + [71.0, 0.0]


@pytest.mark.parametrize("rows, dim", [(37, 360_001), (150, 2 * FT.DENSE_COLUMNS), (3, 5), (1, 1)])
def test_dense_rows_by_column_ranges(spark, rows, dim):
    keys = {i: sorted({0, (i * 7919) % dim, FT.DENSE_COLUMNS - 1, FT.DENSE_COLUMNS, dim - 1, dim + 3}) for i in range(rows)}
    packed = spark.createDataFrame([(i, ks, [None if k % 5 == 4 else 0.5 + i + k for k in ks]) for i, ks in keys.items()]
                                   + [(-1, [], []), (-2, None, None)], "id long, idx array<long>, val array<double>").coalesce(1)

    def facts(x, first):
        assert x.size <= FT.DENSE_BLOCK         # before, a block was a whole row at least
        return _dense_facts(x, first)

    found = FT.densify(packed, dim, measure=facts, fields="n int, pos_sum double, nnz long", by_columns=True).collect()
    inside = {i: [(k, 0.5 + i + k) for k in ks if k < dim and k % 5 != 4] for i, ks in keys.items()} | {-1: [], -2: []}
    assert {r["id"]: (r["n"], r["pos_sum"], r["nnz"]) for r in found} == {
        i: (dim, pytest.approx(sum(v * (k + 1) for k, v in kv)), len(kv)) for i, kv in inside.items()}
    with pytest.raises(Exception, match="comes twice"):
        twice = spark.createDataFrame([(1, [0, 0], [1.0, 2.0])], packed.schema)
        FT.densify(twice, dim, measure=facts, fields="n int, pos_sum double, nnz long", by_columns=True).collect()


@pytest.mark.parametrize("task, least", [(1 << 32, 1), (100, 16)])
def test_densify_deals_its_work_over_the_cores(spark, monkeypatch, task, least):
    monkeypatch.setattr(DATA, "DENSE_TASK", task)
    found = QUERIES["densify"](spark, order_tables(spark, 2000))
    cores = spark.sparkContext.defaultParallelism
    # 1 task before, however large rows x dim was
    assert found.rdd.getNumPartitions() >= cores * least if least > 1 else found.rdd.getNumPartitions() <= cores
    keys = {i: sorted({1 + i % 7, 8 + i % 5}) for i in range(2000)}
    v = {i: (1 + i % 50) / 50.0 for i in range(2000)}
    assert sorted(map(tuple, found.collect())) == [
        (i, 13, pytest.approx(1.0 + v[i] * sum(k + 1 for k in ks), abs=2e-6), 3) for i, ks in keys.items()]


def test_keys_of_order_features(spark):
    root = order_tables(spark, 300)
    want = T.feat_orders(spark, root).select("k").distinct()
    keys = T.feat_orders_keys(spark, root)
    assert keys.schema["k"].dataType == want.schema["k"].dataType and keys.count() == 900
    assert sorted(keys.distinct().collect()) == sorted(want.collect())
