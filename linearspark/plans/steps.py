"""Training steps expressed as DataFrame plans (M1, M2, M5, M6).

Sparse steps run over batches that are drawn and packed once for all steps
(``plans.batches``) with weights that stay a table (``plans.trainer``).  Dense
steps are: exact sample -> margins at frozen weights -> gradient per coordinate;
dense weights (``dim`` numbers) pass through the driver between steps, which is
the only data that does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.functions import uniform
from linearspark.operators import gradients as G
from linearspark.operators import sampling as SP
from linearspark.plans.batches import draw, write_batches
from linearspark.plans.trainer import HingeSq, Run, SvmMean, train
from linearspark.session import scratch_path


def hinge_steps(ex: DataFrame, feats: DataFrame, steps: int, batch: int, seed: int, lr: float, reg: float,
                weights: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """M1: ``steps`` mini-batch steps of the hinge_sq rule.  The base tables are read
    once for all batches; a step reads its own rows and the weights."""
    run = Run(ex.sparkSession, scratch_path(ex.sparkSession, "hinge-run"), weights)
    batches = write_batches(draw(ex, batch, seed, steps), feats, rows=steps * batch)
    return run.weights(train(run, batches, steps, HingeSq(lr, reg), digits=digits))


def svm_sync_steps(ex: DataFrame, feats: DataFrame, steps: int, workers: int, subset: int, seed: int,
                   lr: float, lam: float, weights: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """M2: synchronous SVM rounds: each worker draws its own exact sample,
    computes the svm_mean delta at the round's weights, deltas are summed
    and applied with ``lr``."""
    run = Run(ex.sparkSession, scratch_path(ex.sparkSession, "svm-run"), weights)
    batches = write_batches(draw(ex, subset, seed, steps, workers), feats, rows=steps * workers * subset)
    return run.weights(train(run, batches, steps, SvmMean(lr, lam), digits=digits))


def _final(g: DataFrame, w: list[float], lr: float, scale: float) -> DataFrame:
    wv = F.array(*[F.lit(float(v)) for v in w])
    return g.select("i", (F.element_at(wv, F.col("i") + 1) - F.lit(lr) * F.col("g") / F.lit(scale)).alias("w"))


def dense_steps(points: DataFrame, dim: int, steps: int, batch: int, seed: int, lr: float, lam: float,
                w0: list[float] | None = None, digits: int | None = None) -> DataFrame:
    """M5: mini-batch SGD with the dense_l2 rule; w <- w - lr * sum(g)/batch."""
    w = list(w0) if w0 is not None else [0.0] * dim
    n_rows = points.count()
    for s in range(steps):
        b = SP.sample_exact(points, batch, seed, s, n_rows=n_rows)
        g = G.dense_l2_gradient(G.dense_rows(b, w, digits=digits), w, lam)
        if s == steps - 1:
            return _final(g, w, lr, batch)
        got = {r["i"]: r["g"] for r in g.collect()}          # dim numbers
        w = [w[i] - lr * got.get(i, 0.0) / batch for i in range(dim)]
    raise ValueError("steps must be >= 1")


def random_start(spark, dim: int, seed: int) -> list[float]:
    """``dim`` start weights, uniform in [-1, 1), repeatable for ``seed``."""
    rows = spark.range(dim).select("id", (F.lit(2.0) * uniform(seed, "id") - F.lit(1.0)).alias("w")).collect()     # dim numbers
    return [r["w"] for r in sorted(rows)]


def logistic_steps(points: DataFrame, w0: list[float], steps: int, digits: int | None = None) -> DataFrame:
    """M6: full-batch logistic regression, step size 1: w <- w - sum(g)."""
    w = list(w0)
    for s in range(steps):
        g = G.logistic_gradient(G.dense_rows(points, w, digits=digits))
        if s == steps - 1:
            return _final(g, w, 1.0, 1.0)
        got = {r["i"]: r["g"] for r in g.collect()}
        w = [w[i] - 1.0 * got.get(i, 0.0) / 1.0 for i in range(len(w))]
    raise ValueError("steps must be >= 1")
