import numpy as np
import pytest
from pyspark.sql import functions as F

from linearspark.operators import features as FT
from linearspark.operators import gradients as G
from linearspark.operators import losses as L
from linearspark.plans import vectorized as VZ
from linearspark.plans.local_sgd import packed_examples
from linearspark.sources import tables as T

from conftest import SF_SMALL


def test_vectorized_equals_relational(spark):
    ex, feats = T.ex_orders(spark, SF_SMALL), T.feat_orders(spark, SF_SMALL)
    w = FT.fixed_weights(feats)
    dim = FT.feature_dim(feats).first()["dim"]
    wn = np.zeros(dim)
    for r in w.collect():
        wn[r["k"]] = r["w"]
    rel = {r["id"]: r["m"] for r in FT.labelled_margins(ex, feats, w).collect()}
    vec = {r["id"]: r["m"] for r in VZ.vector_margins(packed_examples(ex, feats), wn).collect()}
    assert rel.keys() == vec.keys()
    assert max(abs(rel[i] - vec[i]) for i in rel) < 1e-9
    grel = {r["k"]: r["g"] for r in G.hinge_sq_gradient(L.feature_rows(ex, feats, w), 0.002, 1e-6).collect()}
    gvec = {r["k"]: r["g"] for r in VZ.vector_hinge_gradient(packed_examples(ex, feats), wn, 0.002, 1e-6).collect() if r["k"] >= 0}
    assert grel.keys() == gvec.keys()
    assert max(abs(grel[k] - gvec[k]) for k in grel) < 1e-9


def test_training_lowers_objective(spark):
    ex, feats = T.ex_orders(spark, SF_SMALL), T.feat_orders(spark, SF_SMALL)
    dim = FT.feature_dim(feats).first()["dim"]
    w, hist = VZ.train_hinge(ex, feats, dim, steps=5, batch=200, seed=1, lr=0.01, reg=1e-6, val=ex)
    assert hist[-1][1] < 1.0 and len(hist) == 5
    assert F is not None and pytest is not None


def test_delta_merge_order_free(spark):
    d = spark.createDataFrame([(w, k, float(k * w) / 7) for w in range(3) for k in range(20)], "worker int, k long, d double")
    a = {r["k"]: r["d"] for r in G.merge_deltas(d).collect()}
    b = {r["k"]: r["d"] for r in G.merge_deltas(d.orderBy(F.rand(3)).repartition(5)).collect()}
    assert a == pytest.approx(b)


def test_margin_udf_equals_map_form(spark):
    ex, feats = T.ex_orders(spark, SF_SMALL), T.feat_orders(spark, SF_SMALL)
    dim = FT.feature_dim(feats).first()["dim"]
    wn = np.linspace(-1, 1, dim)
    packed = packed_examples(ex, feats)
    udf = VZ.margin_udf(spark, wn)
    a = {r["id"]: r["m"] for r in packed.select("id", udf("idx", "val").alias("m")).collect()}
    b = {r["id"]: r["m"] for r in VZ.vector_margins(packed, wn).collect()}
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-12
