"""Golden cases of the SVM rule (4 rows, lr 1, lambda 1e-5, dim 9, no bias)."""

import numpy as np
import pytest

from linearspark.operators import gradients as G
from linearspark.operators import losses as L
from linearspark.plans.local_sgd import mean_loss, sequential_pass

ROWS = [([1, 2], [0.1, 0.2], 1), ([1, 4], [0.2, 0.9], -1), ([3, 8], [0.9, 1.0], 1), ([4, 5], [0.4, 0.7], -1)]
SEQ = {1: -0.100001, 2: 0.2, 3: 0.9, 4: -1.29999199999, 5: -0.6999909999899999, 8: 1.0}
FROZEN = {1: -0.1, 2: 0.2, 3: 0.9, 4: -1.3, 5: -0.7, 8: 1.0}


def test_sequential_fit_and_predict():
    w = np.zeros(9)
    rows = [(np.array(k), np.array(v), y) for k, v, y in ROWS]
    delta, loss = sequential_pass(w, rows, 1.0, 1e-5)
    assert delta == pytest.approx([SEQ.get(k, 0.0) for k in range(9)], abs=1e-12)
    assert mean_loss(np.zeros(9), rows, 1e-5) == 1.0
    assert loss == pytest.approx(0.91500597496075, abs=1e-12)
    m = 0.8 * w[2] + 0.9 * w[3]
    assert np.sign(m) == 1                                  # predicts 1 for 2:0.8 3:0.9


def test_frozen_delta_in_spark(spark):
    ex = spark.createDataFrame([(i, y) for i, (_, _, y) in enumerate(ROWS)], "id long, y int")
    feats = spark.createDataFrame([(i, k, v) for i, (ks, vs, _) in enumerate(ROWS) for k, v in zip(ks, vs)],
                                  "id long, k long, v double")
    w0 = spark.createDataFrame([], "k long, w double")
    fr = L.feature_rows(ex, feats, w0, n_weights=0)
    got = {r["k"]: r["d"] for r in G.svm_mean_delta(fr, 1e-5).collect()}
    assert got == pytest.approx(FROZEN, abs=1e-12)
    loss = L.svm_loss(L.example_stats(ex, feats, w0, n_weights=0), 1e-5).collect()[0]["loss"]
    assert loss == pytest.approx(1.0)
