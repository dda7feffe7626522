"""Sequential (per-row) SVM updates inside shards: M3 local SGD and M4
independent workers.

The reference's asynchronous / lock-free runs let every worker move its own
copy of the weights row by row and exchange deltas.  On Spark this becomes
*local SGD*: in a round, each shard runs the sequential rule over its own
exact sample starting from the round's weights (broadcast once), and the
shards' total deltas are summed by key (partial + final aggregate) and
applied at the round end.  Each shard's group holds only its sample (a
parameter-sized set), never a data-sized partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.functions.stopping import has_risen
from linearspark.operators import features as FT
from linearspark.operators import sampling as SP

DELTA_SCHEMA = "worker int, k long, d double"


def sequential_pass(w: np.ndarray, rows: list[tuple], lr: float, lam: float) -> tuple[np.ndarray, float]:
    """Apply the svm_mean rule to ``rows (idx, val, y)`` one after the other.

    With m = x.w, g = 2 lam mean(w) over the row's keys and d = y x - g where
    y m < 1 (else d = g), w moves by lr d.  ``w`` changes in place; the summed d
    and the mean of hinge(m) + lam mean(w^2), taken after the move, are returned.
    """
    moved, loss = np.zeros_like(w), 0.0
    for idx, val, y in rows:
        margin = y * float(val @ w[idx])
        pull = 2 * lam * w[idx].mean()
        step = y * val - pull if margin < 1 else np.full(len(idx), pull)
        w[idx] += lr * step
        moved[idx] += step
        loss += max(1 - margin, 0.0) + lam * float(np.square(w[idx]).mean())
    return moved, loss / max(len(rows), 1)


def mean_loss(w: np.ndarray, rows: list[tuple], lam: float) -> float:
    """Mean of hinge + lam mean(w^2) over ``rows`` for fixed weights, in one pass."""
    if not rows:
        return 0.0
    size = np.array([len(r[0]) for r in rows])
    start = np.cumsum(size) - size
    mine = w[np.concatenate([r[0] for r in rows])]
    margins = np.add.reduceat(np.concatenate([r[1] for r in rows]) * mine, start)
    hinge = np.maximum(1 - np.array([r[2] for r in rows]) * margins, 0)
    return float((hinge + lam * np.add.reduceat(mine ** 2, start) / size).mean())


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    return [(np.asarray(i, dtype=np.int64), np.asarray(v, dtype=float), int(y))
            for i, v, y in zip(pdf["idx"], pdf["val"], pdf["y"])]


def shard_samples(packed: DataFrame, shards: int, n: int, seed: int, round_: int,
                  n_rows: int | None = None) -> DataFrame:
    """(worker, id, y, idx, val, _h): an exact sample of n examples per shard.

    Only (id, y) are sampled; the packed rows are joined afterwards against a
    broadcast of the sample (shards * n rows, a parameter)."""
    ids = packed.select("id", "y")
    s = SP.group_samples(ids, n, seed, shards, group_col="worker", step=round_, n_rows=n_rows)
    s = SP.with_hash(s, seed, round_, group="worker")
    return packed.select("id", "idx", "val").join(FT.bounded_broadcast(s, shards * n), "id")


def local_sgd_round(packed: DataFrame, w: np.ndarray, shards: int, n: int, seed: int, round_: int,
                    lr: float, lam: float, n_rows: int | None = None) -> DataFrame:
    """(worker, k, d): every shard's total delta for one round."""
    FT.check_dense(len(w))
    bw = packed.sparkSession.sparkContext.broadcast(np.asarray(w, dtype=float))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "id"], kind="mergesort")
        rows = _rows(pdf)
        moved, _ = sequential_pass(np.array(bw.value), rows, lr, lam)
        keys = np.unique(np.concatenate([r[0] for r in rows]))
        worker = int(pdf["worker"].iloc[0])
        return pd.DataFrame({"worker": np.full(len(keys), worker, dtype="int32"), "k": keys, "d": moved[keys]})

    return shard_samples(packed, shards, n, seed, round_, n_rows).groupBy("worker").applyInPandas(fn, DELTA_SCHEMA)


def train_local_sgd(packed: DataFrame, dim: int, rounds: int, shards: int, n: int, seed: int, lr: float,
                    lam: float, n_rows: int | None = None) -> np.ndarray:
    """M3: ``rounds`` of local SGD; returns the dense weights (dim numbers)."""
    w = np.zeros(dim)
    n_rows = n_rows if n_rows is not None else packed.count()
    for r in range(rounds):
        deltas = local_sgd_round(packed, w, shards, n, seed, r, lr, lam, n_rows)
        merged = deltas.groupBy("k").agg(F.sum("d").alias("d")).collect()   # <= dim rows
        for row in merged:
            w[int(row["k"])] += lr * row["d"]
    return w



# ---------------------------------------------------------------- M4

INDEP_SCHEMA = "worker int, kind string, k long, d double, epoch long, val_loss double"


def train_independent(packed: DataFrame, dim: int, workers: int, epochs: int, subset: int, seed: int,
                      lr: float, lam: float, persistence: int, val: DataFrame,
                      n_rows: int | None = None) -> DataFrame:
    """M4: every worker trains alone for ``epochs // workers`` epochs of
    ``subset`` rows with its own early stop on a bounded validation sample
    ``val`` (same packed schema).  Output rows: kind='w' (k, d = the worker's
    weight change) and kind='loss' (epoch, val_loss).

    A worker's pool is an exact sample of budget*subset rows (a parameter),
    consumed ``subset`` rows per epoch in hash order."""
    budget = max(epochs // workers, 1)
    pool = shard_samples(packed, workers, budget * subset, seed, 0, n_rows)
    pool = pool.select("worker", "id", "y", "idx", "val", "_h", F.lit("train").alias("set"))
    vrows = val.select("id", "y", "idx", "val").withColumn(
        "worker", F.explode(F.sequence(F.lit(0), F.lit(workers - 1)))).select(
        "worker", "id", "y", "idx", "val", F.lit("").alias("_h"), F.lit("val").alias("set"))
    FT.check_dense(dim)
    spark = packed.sparkSession
    w0 = spark.sparkContext.broadcast(np.zeros(dim))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        worker = int(pdf["worker"].iloc[0])
        tr = pdf[pdf["set"] == "train"].sort_values(["_h", "id"], kind="mergesort")
        va = _rows(pdf[pdf["set"] == "val"].sort_values("id"))
        w = np.array(w0.value, dtype=float)
        rows = _rows(tr)
        losses: list[float] = []
        while len(losses) < budget and not has_risen(losses, persistence):
            at = len(losses) * subset
            sequential_pass(w, rows[at:at + subset], lr, lam)
            losses.append(mean_loss(w, va, lam))
        dw = w - w0.value
        nz = np.nonzero(dw)[0]
        wpart = pd.DataFrame({"worker": worker, "kind": "w", "k": nz.astype("int64"), "d": dw[nz],
                              "epoch": pd.array([None] * len(nz), dtype="Int64"), "val_loss": np.nan})
        lpart = pd.DataFrame({"worker": worker, "kind": "loss", "k": pd.array([None] * len(losses), dtype="Int64"),
                              "d": np.nan, "epoch": np.arange(len(losses), dtype="int64"), "val_loss": losses})
        return pd.concat([wpart, lpart], ignore_index=True)

    return pool.unionByName(vrows).groupBy("worker").applyInPandas(fn, INDEP_SCHEMA)


def combine_independent(out: DataFrame) -> DataFrame:
    """Final weights: the sum of every worker's weight change, by key."""
    return out.filter(F.col("kind") == "w").groupBy("k").agg(F.sum("d").alias("w"))


def packed_examples(ex: DataFrame, feats: DataFrame) -> DataFrame:
    """(id, y, idx, val): one row per labelled example."""
    return FT.pack(feats).join(ex, "id")
