"""Per-row statistics, losses and accuracies over labelled margins.

Inputs are either a margins table ``(id, y, m)`` or long features with the
label ``(id, y, k, v)``.  Per-row statistics over the features of one example
come from one aggregation by the example, which carries its features along as
an array (bounded by the row width): one shuffle, no sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.functions import hinge, is_support, predict_sign, predict_threshold, stable_margin
from linearspark.operators.features import BROADCAST_MAX_KEYS, with_weights


def feature_rows(ex: DataFrame, feats: DataFrame, weights: DataFrame, n_weights: int | None = None,
                 keys: tuple[str, ...] = ("id",), n_examples: int | None = None,
                 digits: int | None = None) -> DataFrame:
    """(keys..., y, k, v, w, m, sw, sw2, nnz): every feature row of a labelled
    example with its weight and the example's margin and weight sums.

    ``keys`` identify an example occurrence, e.g. ("worker", "id") when the
    same example is drawn by several workers.  ``m`` is raw unless ``digits``
    asks for rounding (``stable_margin``).

    With ``n_examples`` (a known bound on the rows of ``ex``, e.g. a
    mini-batch) the examples are broadcast and the features are first
    semi-joined on their ids; the optimizer pushes that filter below the
    aggregation that builds the features, down to the scan."""
    exs = ex.select(*keys, "y")
    if n_examples is not None and n_examples <= BROADCAST_MAX_KEYS:
        feats = feats.join(F.broadcast(ex.select("id")), "id", "left_semi")
        exs = F.broadcast(exs)
    j = with_weights(feats.join(exs, "id", "inner"), weights, n_weights)
    per = j.groupBy(*keys, "y").agg(
        F.sum(F.col("v") * F.col("w")).alias("dot"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sw2"),
        F.count(F.lit(1)).alias("nnz"), F.collect_list(F.struct("k", "v", "w")).alias("kvw"))
    return per.select(*keys, "y", stable_margin("dot", digits).alias("m"), "sw", "sw2", "nnz", F.explode("kvw").alias("e")).select(
        *keys, "y", "e.k", "e.v", "e.w", "m", "sw", "sw2", "nnz")


def example_stats(ex: DataFrame, feats: DataFrame, weights: DataFrame, n_weights: int | None = None,
                  digits: int | None = None) -> DataFrame:
    """(id, y, ex columns..., m, sw, sw2, nnz) with one aggregation by id."""
    j = with_weights(feats, weights, n_weights)
    g = j.groupBy("id").agg(
        F.sum(F.col("v") * F.col("w")).alias("m"),
        F.sum("w").alias("sw"),
        F.sum(F.col("w") * F.col("w")).alias("sw2"),
        F.count(F.lit(1)).alias("nnz"),
    )
    extra = [c for c in ex.columns if c not in ("id", "y")]
    return ex.join(g, "id", "inner").select("id", "y", *extra, stable_margin("m", digits).alias("m"), "sw", "sw2", "nnz")


def support_rows(margins: DataFrame) -> DataFrame:
    """Rows that violate the margin (y*m < 1)."""
    return margins.filter(is_support("y", "m"))


def hinge_rows(margins: DataFrame) -> DataFrame:
    return margins.select("id", "y", "m", hinge("y", "m").alias("hinge"))


def score(margins: DataFrame) -> DataFrame:
    return margins.select(
        "id", "y", "m",
        predict_sign("m").alias("pred_sign"),
        predict_threshold("m").alias("pred_threshold"),
    )


def svm_loss(stats: DataFrame, lam: float) -> DataFrame:
    """mean(hinge + lam * sum(w_i^2, i in x) / len(x)) -- one row ``loss``."""
    per_row = hinge("y", "m") + F.lit(lam) * F.col("sw2") / F.col("nnz")
    return stats.agg(F.avg(per_row).alias("loss"))


def primal_objective(margins: DataFrame, weights: DataFrame, reg: float) -> DataFrame:
    """mean hinge + reg/2 * ||w||^2 over all weights -- one row ``objective``.

    The two scalars come from two tables; they are combined through a union
    and one global aggregate (no cross join)."""
    a = margins.select(hinge("y", "m").alias("_h"), F.lit(1).alias("_n"), F.lit(0.0).alias("_w2"))
    b = weights.select(F.lit(0.0).alias("_h"), F.lit(0).alias("_n"), (F.col("w") * F.col("w")).alias("_w2"))
    u = a.unionByName(b).agg(F.sum("_h").alias("_sh"), F.sum("_n").alias("_sn"), F.sum("_w2").alias("_sw2"))
    return u.select((F.col("_sh") / F.col("_sn") + F.lit(reg / 2.0) * F.col("_sw2")).alias("objective"))


def accuracy(margins: DataFrame, rule: str = "threshold") -> DataFrame:
    """Share of rows predicted right -- one row ``accuracy``."""
    p = predict_threshold("m") if rule == "threshold" else predict_sign("m")
    return margins.agg(F.avg(F.when(F.col("y") == p, 1.0).otherwise(0.0)).alias("accuracy"))


def class_accuracy_cols(y="y", p=None):
    """Aggregate columns: recall of +1, recall of -1, overall accuracy.
    An empty class gives null (the reference divides by zero)."""
    p = predict_sign("m") if p is None else p
    y = F.col(y)
    pos = F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0))
    npos = F.sum(F.when(y == 1, 1).otherwise(0))
    neg = F.sum(F.when((y == -1) & (p == -1), 1).otherwise(0))
    nneg = F.sum(F.when(y == -1, 1).otherwise(0))
    tot = F.avg(F.when(y == p, 1.0).otherwise(0.0))
    return [
        (pos / F.when(npos > 0, npos)).alias("acc_pos"),
        (neg / F.when(nneg > 0, nneg)).alias("acc_neg"),
        tot.alias("acc_tot"),
    ]


def class_accuracy(margins: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    return margins.groupBy(*groups).agg(*class_accuracy_cols())
