"""Scoring and evaluation jobs (M8 batch scoring, M9 report, M10 step metrics)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.functions import hinge, predict_threshold, stable_margin
from linearspark.operators import features as FT
from linearspark.operators import losses as L
from linearspark.operators import sampling as SP
from linearspark.session import materialize


def score_all(ex: DataFrame, feats: DataFrame, weights: DataFrame, n_weights: int | None = None,
              digits: int | None = None) -> DataFrame:
    """(id, y, m, pred_sign, pred_threshold) for every example."""
    m = FT.labelled_margins(ex, feats, weights, n_weights).select("id", "y", stable_margin("m", digits).alias("m"))
    return L.score(m)


def tag_splits(ex: DataFrame, ratio: float = 0.9, seed: int = 1, holdout: float = 0.1,
               holdout_seed: int = 7) -> DataFrame:
    """(id, y, split): 'test' = rows after the ratio cut; 'val' = exact holdout
    of the train part; 'train' = the rest.  Flags only -- no join."""
    # the second cutoff runs over the first one's output: cut lineage between them
    parts = materialize(SP.ratio_split(ex, ratio, seed=seed, label="_part"))
    train = SP.with_hash(parts.filter(F.col("_part") == "train"), holdout_seed, None)
    flagged = SP.flag_first_n(train, F.floor(F.lit(float(holdout)) * F.col("_tot")))
    tr = flagged.select(*ex.columns, F.when(F.col("_in"), "val").otherwise("train").alias("split"))
    te = parts.filter(F.col("_part") == "test").select(*ex.columns, F.lit("test").alias("split"))
    return tr.unionByName(te)


def evaluation_report(tagged: DataFrame, feats: DataFrame, weights: DataFrame, lam: float,
                      n_weights: int | None = None, digits: int | None = None) -> DataFrame:
    """Per split: recall of +1 and -1, accuracy (sign rule), SVM loss, rows.
    One aggregation grouped by split instead of three loads."""
    st = L.example_stats(tagged, feats, weights, n_weights, digits)
    loss = hinge("y", "m") + F.lit(lam) * F.col("sw2") / F.col("nnz")
    return st.groupBy("split").agg(*L.class_accuracy_cols(), F.avg(loss).alias("loss"),
                                   F.count(F.lit(1)).alias("n"))


def step_metrics(parts: DataFrame, feats: DataFrame, weights: DataFrame, steps: int, batch: int,
                 seed: int, reg: float, n_weights: int | None = None, digits: int | None = None) -> DataFrame:
    """Per step: validation objective, train and validation batch accuracy.

    Batches of all steps are drawn in one job (grouped exact samples); only
    the features of sampled rows are scored (semi join on a bounded id set:
    steps x batch x 2 rows)."""
    tr = SP.step_samples(parts.filter(F.col("part") == "train").select("id", "y"), batch, seed, steps)
    va = SP.step_samples(parts.filter(F.col("part") == "test").select("id", "y"), batch, seed + 1, steps)
    both = tr.withColumn("set", F.lit("train")).unionByName(va.withColumn("set", F.lit("val")))
    ids = both.select("id").distinct()
    f = feats.join(FT.bounded_broadcast(ids, 2 * steps * batch), "id", "left_semi")
    m = FT.margins(f, weights, n_weights).select("id", stable_margin("m", digits).alias("m"))
    j = both.join(m, "id", "inner")
    w2 = weights.agg(F.sum(F.col("w") * F.col("w"))).scalar()
    right = F.when(F.col("y") == predict_threshold("m"), 1.0).otherwise(0.0)
    is_val = F.col("set") == "val"
    return j.groupBy("step").agg(
        (F.avg(F.when(is_val, hinge("y", "m"))) + F.lit(reg / 2.0) * w2).alias("val_objective"),
        F.avg(F.when(~is_val, right)).alias("train_acc"),
        F.avg(F.when(is_val, right)).alias("val_acc"),
    )
