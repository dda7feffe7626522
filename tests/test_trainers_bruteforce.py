"""Rows-only trainers against brute force on the small fixture (sf0.001)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from linearspark.operators import features as FT
from linearspark.operators import gradients as G
from linearspark.operators import losses as L
from linearspark.plans import local_sgd as LS
from linearspark.plans import steps as ST
from linearspark.plans import vectorized as VZ
from linearspark.session import scratch_path
from linearspark.sources import tables as T
from linearspark.streaming import jobs as SJ

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def data(spark):
    ex, feats = T.ex_orders(spark, SF_SMALL), T.feat_orders(spark, SF_SMALL)
    dim = int(FT.feature_dim(feats).first()["dim"])
    return ex, feats, dim


def _row_loss(w, keys, values, y, lam):
    margin = sum(v * w[k] for k, v in zip(keys, values))
    return max(0.0, 1 - y * margin) + lam * sum(w[k] * w[k] for k in keys) / len(keys)


def _replay(w, rows, lr, lam):
    """The documented row rule in plain Python; returns weights and summed moves."""
    moves = {}
    for keys, values, y in rows:
        inside = y * sum(v * w[k] for k, v in zip(keys, values)) < 1
        g = 2 * lam * sum(w[k] for k in keys) / len(keys)
        for k, v in zip(keys, values):
            d = y * v - g if inside else g
            moves[k] = moves.get(k, 0.0) + d
            w[k] += lr * d
    return w, moves


def test_local_sgd_round_equals_python_replay(spark, data):
    ex, feats, dim = data
    packed = LS.packed_examples(ex, feats)
    w0 = np.linspace(-0.2, 0.2, dim)
    got = {(r["worker"], r["k"]): r["d"] for r in LS.local_sgd_round(packed, w0, 3, 40, 2, 0, 0.01, 1e-5).collect()}
    rows = LS.shard_samples(packed, 3, 40, 2, 0).collect()
    expect = {}
    for worker in range(3):
        mine = sorted((r for r in rows if r["worker"] == worker), key=lambda r: (r["_h"], r["id"]))
        _, total = _replay(dict(enumerate(w0)), [(r["idx"], r["val"], r["y"]) for r in mine], 0.01, 1e-5)
        expect.update({(worker, k): d for k, d in total.items()})
    assert got.keys() == expect.keys()
    assert max(abs(got[k] - expect[k]) for k in got) < 1e-12


def test_vectorized_trainer_equals_relational_steps(spark, data):
    ex, feats, dim = data
    w_vec, _ = VZ.train_hinge(ex, feats, dim, steps=2, batch=200, seed=1, lr=0.01, reg=1e-4)
    rel = {r["k"]: r["w"] for r in ST.hinge_steps(ex, feats, steps=2, batch=200, seed=1, lr=0.01, reg=1e-4).collect()}
    for k in range(dim):
        assert abs(w_vec[k] - rel.get(k, 0.0)) < 1e-9


def test_online_sgd_single_batch_is_full_gradient_step(spark, data):
    ex, feats, dim = data
    schema = T.table(spark, SF_SMALL, "orders").schema
    o = SJ.file_stream(spark, f"{SF_SMALL}/orders.parquet", schema)
    stream_ex = o.select(F.col("o_orderkey").alias("id"),
                         F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).cast("int").alias("y"))
    w = {r["k"]: r["w"] for r in SJ.run_online_sgd(spark, stream_ex, feats, scratch_path(spark, "osgd"),
                                                   0.002, 1e-6, dim).collect()}
    w0 = spark.createDataFrame([], "k long, w double")
    g = {r["k"]: r["g"] for r in G.hinge_sq_gradient(L.feature_rows(ex, feats, w0, n_weights=0), 0.002, 1e-6).collect()}
    assert w.keys() == g.keys()
    assert max(abs(w[k] + g[k]) for k in g) < 1e-12


def test_independent_workers_equal_python_replay(spark, data):
    from linearspark.operators import sampling as SP
    ex, feats, dim = data
    packed = LS.packed_examples(ex, feats)
    val = packed.join(F.broadcast(SP.sample_exact(ex.select("id"), 30, seed=11)), "id", "left_semi")
    workers, epochs, subset, p = 2, 8, 20, 2
    out = LS.train_independent(packed, dim, workers, epochs, subset, seed=5, lr=0.05, lam=1e-5,
                               persistence=p, val=val)
    got_w = {r["k"]: r["w"] for r in LS.combine_independent(out).collect()}
    got_losses = {(r["worker"], r["epoch"]): r["val_loss"] for r in out.filter("kind = 'loss'").collect()}
    budget = epochs // workers
    pool = LS.shard_samples(packed, workers, budget * subset, 5, 0).collect()
    vrows = [(list(r["idx"]), list(r["val"]), r["y"]) for r in sorted(val.collect(), key=lambda r: r["id"])]
    expect_w = np.zeros(dim)
    expect_losses = {}
    for wk in range(workers):
        mine = sorted((r for r in pool if r["worker"] == wk), key=lambda r: (r["_h"], r["id"]))
        rows = [(list(r["idx"]), list(r["val"]), r["y"]) for r in mine]
        w, losses = dict.fromkeys(range(dim), 0.0), []
        for e in range(budget):
            _replay(w, rows[e * subset:(e + 1) * subset], 0.05, 1e-5)
            losses.append(sum(_row_loss(w, *r, 1e-5) for r in vrows) / len(vrows))
            expect_losses[(wk, e)] = losses[-1]
            if any(all(x > old for x in losses[-p:]) for old in losses[:-p]):
                break
        expect_w += np.array([w[k] for k in range(dim)])
    assert got_losses.keys() == expect_losses.keys()
    assert max(abs(got_losses[k] - expect_losses[k]) for k in got_losses) < 1e-12
    assert max(abs(got_w.get(k, 0.0) - expect_w[k]) for k in range(dim)) < 1e-12
