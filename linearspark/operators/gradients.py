"""Update rules (frozen weights within a batch) and delta merging.

Rules, as the reference computes them (see README "decided semantics"):

``hinge_sq``  (RDD trainer)   g_k = lr * (support ? -v*y : 0) + reg * w_k^2,
                              summed over the batch; then  w_k <- w_k - g_k
``svm_mean``  (SVM workers)   r = 2*lam*sum(w_i, i in x)/len(x);
                              d_k = support ? v*y - r : r, summed;
                              then  w_k <- w_k + lr * d_k
``dense_l2``  (dense SGD)     g_i = N*(support ? -x_i*y : 0) + lam*w_i (every i)
``logistic``                  g_i = ((1/(1+exp(-y*m)) - 1) * y) * x_i

Gradients are sums by key: a partial (map-side) aggregate in every task, then
one shuffle of at most ``dim`` rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.functions import is_support, logistic_factor, stable_margin
from linearspark.operators.features import dense_dot


def hinge_sq_gradient(frows: DataFrame, lr: float, reg: float, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups..., k, g) from ``feature_rows`` output."""
    supp = is_support("y", "m")
    g = F.lit(lr) * F.when(supp, -F.col("v") * F.col("y")).otherwise(F.lit(0.0)) + F.col("w") * F.col("w") * F.lit(reg)
    return frows.groupBy(*groups, "k").agg(F.sum(g).alias("g"))


def svm_mean_delta(frows: DataFrame, lam: float, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups..., k, d) from ``feature_rows`` output."""
    r = F.lit(2.0 * lam) * F.col("sw") / F.col("nnz")
    d = F.when(is_support("y", "m"), F.col("v") * F.col("y") - r).otherwise(r)
    return frows.groupBy(*groups, "k").agg(F.sum(d).alias("d"))


def dense_rows(points: DataFrame, w: list[float], digits: int | None = None) -> DataFrame:
    """(id, y, x, m) for dense points against constant weights."""
    return points.withColumn("m", stable_margin(dense_dot("x", w), digits))


def dense_l2_gradient(drows: DataFrame, w: list[float], lam: float, n_examples: float = 1.0) -> DataFrame:
    """(i, g): Q8 rule summed over rows, per coordinate (posexplode + sum)."""
    e = drows.select("y", "m", F.posexplode("x").alias("i", "xi"))
    wv = F.array(*[F.lit(float(v)) for v in w])
    wi = F.element_at(wv, F.col("i") + 1)
    g = F.lit(float(n_examples)) * F.when(is_support("y", "m"), -F.col("xi") * F.col("y")).otherwise(F.lit(0.0)) + F.lit(lam) * wi
    return e.groupBy("i").agg(F.sum(g).alias("g"), F.count(F.lit(1)).alias("n"))


def logistic_gradient(drows: DataFrame) -> DataFrame:
    """(i, g): sum over rows of the logistic factor times x_i."""
    e = drows.select(logistic_factor("y", "m").alias("f"), F.posexplode("x").alias("i", "xi"))
    return e.groupBy("i").agg(F.sum(F.col("f") * F.col("xi")).alias("g"))


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """(k, d, n_workers, n_updates): deltas of all workers summed by key."""
    return deltas.groupBy("k").agg(
        F.sum("d").alias("d"),
        F.countDistinct("worker").cast("long").alias("n_workers"),
        F.count(F.lit(1)).alias("n_updates"),
    )


def apply_delta(weights: DataFrame, delta: DataFrame, scale: float, value: str = "d") -> DataFrame:
    """w_k <- w_k + scale * delta_k over the union of keys (absent = 0).

    Union + one aggregation by key: a single shuffle, no outer join."""
    a = weights.select("k", F.col("w").alias("_x"))
    b = delta.select("k", (F.lit(float(scale)) * F.col(value)).alias("_x"))
    return a.unionByName(b).groupBy("k").agg(F.sum("_x").alias("w"))
