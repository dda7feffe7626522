"""Sinks (K1-K4) and their read-back.

* weights        parquet ``(k, w)``                                   (K1)
* metrics        parquet partitioned by ``run_id``/``series``          (K2)
* run log        JSON: one record per run + a child table of losses,
                 partitioned by run (a run's loss list is never
                 collected into one row)                               (K3)
* worker logs    JSON partitioned by ``worker`` (``time``, ``loss_val``) (K4)
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linearspark.functions import ts_text
from linearspark.functions.columns import micros_between


def write_weights(weights: DataFrame, path: str) -> None:
    weights.select("k", "w").write.mode("overwrite").parquet(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("k LONG, w DOUBLE").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """(run_id, series, step, ts, value) -> one folder per run and series."""
    metrics.write.mode("overwrite").partitionBy("run_id", "series").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.parquet(path)
    return m.withColumn("run_id", F.col("run_id").cast("long"))


def write_run_log(events: DataFrame, path: str, run_col: str = "run_id", ts: str = "ts",
                  loss: str = "loss") -> None:
    """Run records (start, end, running time, epochs) and the loss list as a
    child table keyed by run."""
    runs = events.groupBy(F.col(run_col).cast("long").alias("run_id")).agg(
        F.min(ts).alias("_s"), F.max(ts).alias("_e"), F.count(F.lit(1)).alias("epochs"))
    runs = runs.select(
        "run_id", ts_text("_s").alias("start_time"), ts_text("_e").alias("end_time"),
        (micros_between("_s", "_e") / 1e6).alias("running_time"), "epochs")
    runs.write.mode("overwrite").json(os.path.join(path, "runs"))
    losses = events.select(F.col(run_col).cast("long").alias("run_id"), ts_text(ts).alias("time"),
                           F.col(loss).alias("loss_val"))
    losses.write.mode("overwrite").partitionBy("run_id").json(os.path.join(path, "losses_val"))


def read_run_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    runs = spark.read.schema(
        "run_id LONG, start_time STRING, end_time STRING, running_time DOUBLE, epochs LONG").json(
        os.path.join(path, "runs"))
    losses = spark.read.json(os.path.join(path, "losses_val")).withColumn("run_id", F.col("run_id").cast("long"))
    return runs, losses


def write_worker_loss_log(events: DataFrame, path: str, worker: str = "worker_idx", ts: str = "ts",
                          loss: str = "loss") -> None:
    e = events.select(F.col(worker).alias("worker"), ts_text(ts).alias("time"), F.col(loss).alias("loss_val"))
    e.write.mode("overwrite").partitionBy("worker").json(path)


def read_worker_loss_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("time STRING, loss_val DOUBLE, worker INT").json(path)
