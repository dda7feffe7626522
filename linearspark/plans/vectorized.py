"""Vectorized form: packed examples scored against a broadcast NumPy weight
vector inside Arrow batches (``mapInPandas``).

The margin needs no shuffle; a gradient step emits one partial vector per
task (non-zero keys only) and shuffles at most ``dim`` rows per task before
the final sum.  Only the ``dim``-sized gradient reaches the driver.  The
weight vector is broadcast once per step (and unpersisted afterwards); its
size is checked against ``BROADCAST_MAX_KEYS``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.functions.stopping import has_risen
from linearspark.operators import features as FT
from linearspark.operators.features import check_dense
from linearspark.plans.batches import draw, of_step, write_batches
from linearspark.plans.local_sgd import packed_examples
from linearspark.session import materialize

LITERAL_MAX = 10_000    # weight vectors up to this size may travel inside a plan (one-off scoring)
MARGIN_SCHEMA = "id long, y int, m double"
GRAD_SCHEMA = "k long, g double"
BATCH_SCHEMA = "id long, y int, idx array<long>, val array<double>"


def _flat(pdf: pd.DataFrame):
    lens = pdf["idx"].map(len).to_numpy()
    n = len(pdf)
    if n == 0 or lens.sum() == 0:
        return lens, np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
    ks = np.concatenate(pdf["idx"].to_numpy()).astype(np.int64)
    vs = np.concatenate(pdf["val"].to_numpy()).astype(float)
    rows = np.repeat(np.arange(n), lens)
    return lens, ks, vs, rows


def _lookup(w: np.ndarray, ks: np.ndarray) -> np.ndarray:
    """w[k], 0 for keys outside the vector (unseen features)."""
    inside = ks < len(w)
    out = np.zeros(len(ks))
    out[inside] = w[ks[inside]]
    return out


def _margins(pdf: pd.DataFrame, w: np.ndarray) -> np.ndarray:
    lens, ks, vs, rows = _flat(pdf)
    return np.bincount(rows, weights=vs * _lookup(w, ks), minlength=len(pdf))


def vector_margins(packed: DataFrame, w: np.ndarray, bw=None) -> DataFrame:
    """(id, y, m) for packed examples against a dense weight vector (``bw``: an
    existing broadcast of it, which the caller releases)."""
    check_dense(len(w))
    if bw is None:
        bw = packed.sparkSession.sparkContext.broadcast(np.asarray(w, dtype=float))

    def fn(it):
        wv = bw.value
        for pdf in it:
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "m": _margins(pdf, wv)})

    return packed.select("id", "y", "idx", "val").mapInPandas(fn, MARGIN_SCHEMA)


def margin_udf(spark, w: np.ndarray):
    """Scalar pandas UDF (idx, val) -> margin against broadcast weights: the
    column-level form of ``vector_margins`` for use inside any select."""
    from pyspark.sql.functions import pandas_udf

    check_dense(len(w))
    bw = spark.sparkContext.broadcast(np.asarray(w, dtype=float))

    @pandas_udf("double")
    def margin(idx: pd.Series, val: pd.Series) -> pd.Series:
        return pd.Series(_margins(pd.DataFrame({"idx": idx, "val": val}), bw.value))

    return margin


def vector_hinge_gradient(batch: DataFrame, w: np.ndarray, lr: float, reg: float, bw=None,
                          digits: int | None = None) -> DataFrame:
    """(k, g): hinge_sq rule summed over ``batch`` (one partial vector per
    task); the extra row k = -1 carries the number of batch rows.  ``bw`` is
    an existing broadcast of ``w`` (the caller then releases it)."""
    check_dense(len(w))
    if bw is None:
        bw = batch.sparkSession.sparkContext.broadcast(np.asarray(w, dtype=float))

    def fn(it):
        wv = bw.value
        acc = {}
        seen = 0
        for pdf in it:
            seen += len(pdf)
            lens, ks, vs, rows = _flat(pdf)
            if len(ks) == 0:
                continue
            wk = _lookup(wv, ks)
            m = np.bincount(rows, weights=vs * wk, minlength=len(pdf))
            m = m if digits is None else np.round(m, digits)
            y = pdf["y"].to_numpy().astype(float)
            supp = (y * m < 1)[rows]
            contrib = lr * np.where(supp, -vs * y[rows], 0.0) + wk * wk * reg
            uk, inv = np.unique(ks, return_inverse=True)
            part = np.bincount(inv, weights=contrib)
            for k, g in zip(uk.tolist(), part.tolist()):
                acc[k] = acc.get(k, 0.0) + g
        acc[-1] = acc.get(-1, 0.0) + seen          # row count of the batch, key -1
        yield pd.DataFrame({"k": np.fromiter(acc.keys(), dtype=np.int64, count=len(acc)),
                            "g": np.fromiter(acc.values(), dtype=float, count=len(acc))})

    return batch.select("id", "y", "idx", "val").mapInPandas(fn, GRAD_SCHEMA).groupBy("k").agg(F.sum("g").alias("g"))


def _wlit(w: np.ndarray):
    return F.array(*[F.lit(float(x)) for x in w])


def _wk(wl, k):
    """w[k] from a literal vector, 0 outside it (unseen feature)."""
    return F.coalesce(F.try_element_at(wl, (k + 1).cast("int")), F.lit(0.0))


def jvm_margins(packed: DataFrame, w: np.ndarray) -> DataFrame:
    """(id, y, m) with the weights as a literal array: JVM-side, no Python
    worker (small ``dim`` only)."""
    wl = _wlit(w)
    m = F.aggregate(F.zip_with("idx", "val", lambda k, v: v * _wk(wl, k)), F.lit(0.0), lambda a, b: a + b)
    return packed.select("id", "y", m.alias("m"))


def hinge_loss_stats(packed: DataFrame, w: np.ndarray, reg: float) -> tuple[float, float]:
    """(objective, accuracy) over ``packed``: mean hinge + reg/2*||w||^2 and
    the threshold-rule accuracy, in one job."""
    m = jvm_margins(packed, w) if len(w) <= LITERAL_MAX else vector_margins(packed, w)
    z = F.lit(1.0) - F.col("y") * F.col("m")
    r = m.agg(F.avg(F.greatest(z, F.lit(0.0))).alias("h"),
              F.avg(F.when(F.col("y") == F.when(F.col("m") > 0, 1).otherwise(-1), 1.0).otherwise(0.0)).alias("a")).first()
    return float(r["h"]) + reg / 2.0 * float(np.dot(w, w)), float(r["a"])


STAT_H, STAT_OK, STAT_N = -2, -3, -4      # keys of the statistics rows


def _stats_rows(packed: DataFrame, w: np.ndarray, bw=None) -> DataFrame:
    """Hinge sum, right predictions and rows over ``packed`` as (k, g) rows.

    The weights travel as a broadcast, not as plan literals: literals would
    change the generated code every step and force a recompile."""
    m = vector_margins(packed, w, bw)
    z = F.lit(1.0) - F.col("y") * F.col("m")
    a = m.agg(F.sum(F.greatest(z, F.lit(0.0))).alias("h"),
              F.sum(F.when(F.col("y") == F.when(F.col("m") > 0, 1).otherwise(-1), 1.0).otherwise(0.0)).alias("ok"),
              F.count(F.lit(1)).cast("double").alias("n"))
    return a.select(F.explode(F.array(
        F.struct(F.lit(STAT_H).cast("long").alias("k"), F.col("h").alias("g")),
        F.struct(F.lit(STAT_OK).cast("long").alias("k"), F.col("ok").alias("g")),
        F.struct(F.lit(STAT_N).cast("long").alias("k"), F.col("n").alias("g")))).alias("s")).select("s.k", "s.g")


def train_hinge(ex: DataFrame, feats: DataFrame, dim: int, steps: int, batch: int, seed: int, lr: float,
                reg: float, val: DataFrame | None = None, persistence: int | None = None, digits: int | None = None):
    """M1 / M7 driver loop in vectorized form, for weights that fit a broadcast
    (``plans.trainer`` has no such bound).

    All batches are drawn and packed once; a step reads its own rows.  Returns
    (w, history) where history has one (step, objective, accuracy) entry per
    step when ``val`` is given; with ``persistence`` the loop stops by the
    early-stopping rule on the validation objective."""
    check_dense(dim)
    spark = ex.sparkSession
    path = write_batches(draw(ex, batch, seed, steps), feats, steps * batch, FT.pack)
    vpacked = materialize(packed_examples(val, feats), "val") if val is not None else None
    w = np.zeros(dim)
    hist = []
    # one job per step: validation statistics of w_s (the previous step's
    # result) and the gradient at w_s are collected together
    for s in range(steps + 1):
        jobs = []
        bw = spark.sparkContext.broadcast(np.asarray(w, dtype=float))
        if s < steps:
            rows = of_step(spark, path, s, BATCH_SCHEMA)
            jobs.append(vector_hinge_gradient(rows, w, lr, reg, bw=bw, digits=digits))
        if vpacked is not None and s > 0:
            jobs.append(_stats_rows(vpacked, w, bw))
        got = {}
        if jobs:
            u = jobs[0] if len(jobs) == 1 else jobs[0].unionByName(jobs[1])
            got = {int(r["k"]): r["g"] for r in u.collect()}          # <= dim + 4 rows
        bw.destroy()                                                  # one weight copy per step
        if vpacked is not None and s > 0:
            n = got.pop(STAT_N)
            obj = got.pop(STAT_H) / n + reg / 2.0 * float(np.dot(w, w))
            hist.append((s - 1, obj, got.pop(STAT_OK) / n))
            if persistence and has_risen([h[1] for h in hist], persistence):
                break
        got.pop(-1, None)
        for k, gv in got.items():
            w[k] -= gv
    return w, hist
