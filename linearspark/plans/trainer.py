"""Training over drawn batches, for any number of keys (M1, M2, M7, M10, M9 + K3).

The weights are a table ``(k, w)`` from the first step to the last.  A step joins
the batch's features with it, sums the rule's changes by key, and writes them as
``deltas/step=s``: together these are the versioned weight table, from which any
step's weights, or those of all steps at once, can be read.  Every
``SNAPSHOT_STEPS`` steps the sums are written as a snapshot, so a step reads one
snapshot and a bounded number of deltas.  Nothing of the number of keys reaches
the driver or is broadcast by force.

A step's last write is its row in ``history`` (loss and accuracy on the validation
rows).  A run that starts again on the same folder goes on after the last row
there, and the stop rule sees the whole history.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linearspark.functions import hinge, is_support, predict_sign, predict_threshold, stable_margin
from linearspark.functions.stopping import has_risen
from linearspark.operators.features import BIAS_KEY
from linearspark.plans.batches import draw, of_step, pack_with_bias, write_batches
from linearspark.session import materialize
from linearspark.sources.runlog import ACCURACY_FIELDS, RUN_LOG_SCHEMA, write_run_logs

SNAPSHOT_STEPS = 8
HISTORY = "step int, loss double, accuracy double, rows long, time string"


@dataclass(frozen=True)
class HingeSq:
    """``w -= lr (support ? -v y : 0) + reg w^2``, summed over the batch; the loss is
    the mean hinge plus ``reg / 2`` times the squared norm of all weights."""
    lr: float
    reg: float

    def change(self) -> Column:
        push = F.when(is_support("y", "m"), F.col("v") * F.col("y")).otherwise(F.lit(0.0))
        return F.lit(self.lr) * push - F.lit(self.reg) * F.col("w") * F.col("w")

    def loss(self) -> Column:
        return hinge("y", "m")

    def penalty(self, weights: DataFrame) -> float:
        return self.reg / 2 * float(weights.agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0)

    def right(self) -> Column:
        return F.col("y") == predict_threshold("m")


@dataclass(frozen=True)
class SvmMean:
    """``w += lr (support ? v y - r : r)`` with ``r = 2 lam mean(w)`` over the row's
    keys; a row's loss is hinge plus ``lam mean(w^2)``."""
    lr: float
    lam: float

    def change(self) -> Column:
        r = F.lit(2.0 * self.lam) * F.col("sw") / F.col("nnz")
        return F.lit(self.lr) * F.when(is_support("y", "m"), F.col("v") * F.col("y") - r).otherwise(r)

    def loss(self) -> Column:
        return hinge("y", "m") + F.lit(self.lam) * F.col("sw2") / F.col("nnz")

    def penalty(self, weights: DataFrame) -> float:
        return 0.0

    def right(self) -> Column:
        return F.col("y") == predict_sign("m")


def margins(packed: DataFrame, weights: DataFrame, keys: tuple[str, ...] = ("id",), digits: int | None = None) -> DataFrame:
    """``(keys, y, bias, w0, m, sw, sw2, nnz, kvw)`` of packed rows ``(keys, y, bias,
    kv)``; ``kvw`` has the features with their weights.  The join on ``k`` has no
    hint (adaptive execution measures the weights) and no bias rows."""
    w0 = weights.filter(F.col("k") == BIAS_KEY).agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w0"))
    others = weights.filter(F.col("k") != BIAS_KEY)
    long = packed.select(*keys, "y", "bias", F.explode_outer("kv").alias("e")).select(
        *keys, "y", "bias", F.col("e.k").alias("k"), F.col("e.v").alias("v"))
    joined = long.join(others, "k", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    some = F.col("k").isNotNull()
    sums = joined.groupBy(*keys, "y", "bias").agg(
        F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("dot"), F.sum("w").alias("s1"),
        F.sum(F.col("w") * F.col("w")).alias("s2"), F.count("k").alias("c"),
        F.collect_list(F.when(some, F.struct("k", "v", "w"))).alias("kvw"))     # one example's features
    at0 = sums.withColumn("w0", w0.scalar())
    return at0.select(*keys, "y", "bias", "w0", stable_margin(F.col("dot") + F.col("bias") * F.col("w0"), digits).alias("m"),
                      (F.col("s1") + F.col("w0")).alias("sw"), (F.col("s2") + F.col("w0") * F.col("w0")).alias("sw2"),
                      (F.col("c") + 1).alias("nnz"), "kvw")


def step_change(batch: DataFrame, weights: DataFrame, rule, digits: int | None = None) -> DataFrame:
    """``(k, d)``: what one batch changes in the weights, summed by key (a partial
    sum in every task, so the bias row is no hot key)."""
    rows = margins(batch, weights, ("worker", "id"), digits)
    every = F.concat(F.array(F.struct(F.lit(BIAS_KEY).cast("long").alias("k"), F.col("bias").alias("v"), F.col("w0").alias("w"))),
                     F.col("kvw"))
    long = rows.select("y", "m", "sw", "nnz", F.explode(every).alias("e")).select(
        "y", "m", "sw", "nnz", F.col("e.k").alias("k"), F.col("e.v").alias("v"), F.col("e.w").alias("w"))
    return long.groupBy("k").agg(F.sum(rule.change()).alias("d"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


class Run:
    """A training run's folder: deltas, snapshots and history, by step."""

    def __init__(self, spark: SparkSession, root: str, start: DataFrame | None = None):
        self.spark, self.root, self.begins = spark, root, start is not None
        if start is not None:
            self._put(start.select("k", "w"), "snapshots", 0)

    def deltas(self) -> DataFrame:
        """``(step, k, d)`` of all steps: the versioned weight table."""
        return self.spark.read.parquet(f"{self.root}/deltas")

    def history(self) -> list[tuple]:
        """``(step, loss, accuracy, rows, time)``, a row a finished step (step order)."""
        h = _read(self.spark, f"{self.root}/history")
        return [] if h is None else sorted(tuple(r[c] for c in ("step", "loss", "accuracy", "rows", "time")) for r in h.collect())

    def weights(self, step: int) -> DataFrame:
        """``(k, w)`` before step ``step`` (so after ``step - 1``)."""
        base = step // SNAPSHOT_STEPS * SNAPSHOT_STEPS
        parts = [self.spark.read.parquet(f"{self.root}/snapshots/step={base}").select("k", F.col("w").alias("d"))] if base or self.begins else []
        parts += [self.spark.read.parquet(f"{self.root}/deltas/step={s}").select("k", "d") for s in range(base, step)]
        if not parts:
            return self.spark.createDataFrame([], "k long, w double")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("k").agg(F.sum("d").alias("w"))

    def _put(self, df: DataFrame, kind: str, step: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{kind}/step={step}")


def train(run: Run, batches: str, steps: int, rule, val: DataFrame | None = None, persistence: int | None = None,
          digits: int | None = None, stop_after: Callable[[int], bool] | None = None) -> int:
    """Up to ``steps`` steps of ``rule`` over the written ``batches``; with
    ``persistence``, until the early-stopping rule holds for the loss on ``val``
    (packed rows).  Goes on where the folder's history ends.  Returns the number
    of steps that the folder then has.  ``stop_after`` ends the call early (tests)."""
    spark = run.spark
    history = run.history()
    while len(history) < steps and not (persistence and has_risen([h[1] for h in history], persistence)):
        s = len(history)
        before = run.weights(s)
        run._put(step_change(of_step(spark, batches, s), before, rule, digits), "deltas", s)
        if (s + 1) % SNAPSHOT_STEPS == 0:
            every = before.select("k", F.col("w").alias("d")).unionByName(spark.read.parquet(f"{run.root}/deltas/step={s}"))
            run._put(every.groupBy("k").agg(F.sum("d").alias("w")), "snapshots", s + 1)
        row = (s, None, None, 0, now_text())
        if val is not None:
            after = run.weights(s + 1)
            m = margins(val, after, digits=digits).agg(
                F.avg(rule.loss()).alias("loss"), F.avg(F.when(rule.right(), 1.0).otherwise(0.0)).alias("accuracy"),
                F.count(F.lit(1)).alias("rows")).first()
            row = (s, float(m["loss"]) + rule.penalty(after), float(m["accuracy"]), m["rows"], now_text())
        run._put(spark.createDataFrame([row], HISTORY).drop("step").coalesce(1), "history", s)
        history.append(row)
        if stop_after is not None and stop_after(s):
            break
    return len(history)


# ------------------------------------------------------------------ many versions at once

def version_table(deltas: DataFrame, steps: int) -> DataFrame:
    """``(k, ws)``: a key's weight after each of ``steps`` steps, as one array."""
    zero = F.array_repeat(F.lit(0.0), steps)
    own = F.collect_list(F.struct("step", "d"))         # at most one delta a step
    put = F.aggregate(own, zero, lambda ws, e: F.zip_with(
        ws, F.sequence(F.lit(0), F.lit(steps - 1)), lambda w, i: F.when(i >= e["step"], w + e["d"]).otherwise(w)))
    return deltas.filter(F.col("step") < steps).groupBy("k").agg(put.alias("ws"))


def at_versions(rows: DataFrame, versions: DataFrame, keys: tuple[str, ...], shift: int = 0,
                digits: int | None = None) -> DataFrame:
    """``(keys, step, y, m, sw2, nnz)`` of packed rows ``(keys, step, y, bias, kv)``, each
    scored with the weights after its own step (``shift`` -1: before it).

    One pass for all steps: a row picks its step's weight out of a key's array of
    versions, so the join is on ``k`` alone and the bias is no hot key."""
    keys = [*keys, "step", "y"]
    at = F.col("step") + F.lit(shift)
    pick = lambda ws: F.coalesce(F.when(at >= 0, F.get(ws, at)), F.lit(0.0))
    bias = versions.filter(F.col("k") == BIAS_KEY).agg(F.first("ws"))
    long = rows.select(*keys, "bias", F.explode_outer("kv").alias("e")).select(
        *keys, "bias", F.col("e.k").alias("k"), F.col("e.v").alias("v"))
    sums = long.join(versions.filter(F.col("k") != BIAS_KEY), "k", "left").withColumn("w", pick(F.col("ws"))).groupBy(
        *keys, "bias").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("dot"),
                           F.sum(F.col("w") * F.col("w")).alias("s2"), F.count("k").alias("c"))
    return sums.withColumn("b", bias.scalar()).withColumn("w0", pick(F.col("b"))).select(
        *keys, stable_margin(F.col("dot") + F.col("bias") * F.col("w0"), digits).alias("m"),
        (F.col("s2") + F.col("w0") * F.col("w0")).alias("sw2"), (F.col("c") + 1).alias("nnz"))


def live_metrics(run: Run, steps: int, batches: dict[str, str], reg: float, digits: int | None = None) -> DataFrame:
    """``(step, val_objective, train_acc, val_acc)``: each step's 'train' and 'val'
    batches (written folders) at the weights that this step left."""
    versions = version_table(run.deltas(), steps)
    both = None
    for name, path in batches.items():
        part = run.spark.read.parquet(path).filter(F.col("step") < steps).withColumn("set", F.lit(name))
        both = part if both is None else both.unionByName(part)
    m = at_versions(both, versions, ("set", "id"), digits=digits)
    squares = versions.select(F.posexplode("ws").alias("step", "w")).groupBy("step").agg(F.sum(F.col("w") * F.col("w")).alias("w2"))
    right = F.when(F.col("y") == predict_threshold("m"), 1.0).otherwise(0.0)
    is_val = F.col("set") == "val"
    per = m.groupBy("step").agg(F.avg(F.when(is_val, hinge("y", "m"))).alias("h"), F.avg(F.when(~is_val, right)).alias("train_acc"),
                                F.avg(F.when(is_val, right)).alias("val_acc"))
    return per.join(squares, "step", "left").select(
        "step", (F.col("h") + F.lit(reg / 2) * F.coalesce("w2", F.lit(0.0))).alias("val_objective"), "train_acc", "val_acc")


def worker_losses(run: Run, steps: int, batches: str, lam: float, digits: int | None = None) -> DataFrame:
    """``(step, worker, loss_train)``: every worker's mean SVM loss on its own batch, at
    the weights that the step started from."""
    rows = run.spark.read.parquet(batches).filter(F.col("step") < steps)
    m = at_versions(rows, version_table(run.deltas(), steps), ("worker", "id"), shift=-1, digits=digits)
    return m.groupBy("step", "worker").agg(F.avg(hinge("y", "m") + F.lit(lam) * F.col("sw2") / F.col("nnz")).alias("loss_train"))


# ------------------------------------------------------------------ train, evaluate, log

SPLITS = ("train", "val", "test")


def write_scored(packed: DataFrame, weights: DataFrame, lam: float, path: str, digits: int | None = None) -> dict:
    """Score packed rows ``(id, y, split, bias, kv)`` into a table ``(id, split, y, m,
    loss)`` and return the nine accuracies and the mean losses of its splits: they
    are observed while the rows are written, so there is no second pass."""
    rows = margins(packed, weights, ("id", "split"), digits)
    scored = rows.select("id", "split", "y", "m", (hinge("y", "m") + F.lit(lam) * F.col("sw2") / F.col("nnz")).alias("loss"))
    right = F.col("y") == predict_sign("m")
    seen, sums = Observation(), []
    for split in SPLITS:
        own = F.col("split") == split
        sums += [F.count_if(own).alias(f"n_{split}"), F.sum(F.when(own, F.col("loss"))).alias(f"loss_{split}")]
        for name, y in (("1", 1), ("-1", -1)):
            sums += [F.count_if(own & (F.col("y") == y)).alias(f"n{name}_{split}"),
                     F.count_if(own & (F.col("y") == y) & right).alias(f"r{name}_{split}")]
    scored.observe(seen, *sums).write.mode("overwrite").parquet(path)
    s, out = seen.get, {}
    share = lambda a, b: a / b if b else None
    for split in SPLITS:
        out[f"accuracy_{split}"] = share(s[f"r1_{split}"] + s[f"r-1_{split}"], s[f"n_{split}"])
        out[f"accuracy_1_{split}"] = share(s[f"r1_{split}"], s[f"n1_{split}"])
        out[f"accuracy_-1_{split}"] = share(s[f"r-1_{split}"], s[f"n-1_{split}"])
        out[f"loss_{split}"] = share(s[f"loss_{split}"] or 0.0, s[f"n_{split}"])
    return out


def now_text() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


def train_evaluate_log(run: Run, tagged: DataFrame, feats: DataFrame, path: str, steps: int, workers: int, subset: int,
                       seed: int, lr: float, lam: float, persistence: int | None = None, run_id: int = 0,
                       digits: int | None = None) -> dict:
    """M9 + K3: train the synchronous SVM on the 'train' rows of ``tagged (id, y,
    split)`` with the loss of the 'val' rows after every epoch, evaluate all splits,
    and write one run record to ``path``: times, mode, workers, epochs, the nine
    accuracies, the validation losses and every worker's training losses.

    The record is the job's last write; its lists have ``epochs`` and ``epochs *
    workers`` entries."""
    spark, began = run.spark, time.time()
    start = now_text()
    train_ex = tagged.filter(F.col("split") == "train").select("id", "y")
    batches = write_batches(draw(train_ex, subset, seed, steps, workers), feats, rows=steps * workers * subset)
    packed = materialize(pack_with_bias(feats).join(tagged, "id"), "packed")
    val = packed.filter(F.col("split") == "val").select("id", "y", "bias", "kv")
    epochs = train(run, batches, steps, SvmMean(lr, lam), val, persistence, digits)
    facts = write_scored(packed, run.weights(epochs), lam, f"{run.root}/scored", digits)
    history = run.history()[:epochs]
    each = worker_losses(run, epochs, batches, lam, digits).orderBy("step", "worker").collect()     # epochs x workers rows
    record = {"run_id": run_id, "start_time": start, "end_time": now_text(), "running_time": time.time() - began,
              "n_workers": str(workers), "running_mode": "synchronous", "sync_epochs": epochs,
              "losses_val": [{"time": h[4], "loss_val": h[1]} for h in history],
              "losses_train": [{"worker_idx": r["worker"], "loss_train": r["loss_train"], "time": history[r["step"]][4]} for r in each]}
    record |= {k: facts[k] for k in ACCURACY_FIELDS}
    write_run_logs(spark.createDataFrame([record], RUN_LOG_SCHEMA).coalesce(1), path)
    return record | facts
