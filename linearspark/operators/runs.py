"""Run-log analysis.

A run log row is the flattened D13 record: run_id, running_mode,
n_workers, accuracies, start/end time, running_time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linearspark.functions import out, pct_text, secs_text
from linearspark.functions.columns import micros_between
from linearspark.sources.runlog import TIME_FORMAT

# Fixed values of the reference's run analysis.
PERFORMANCE_THRESHOLD = 0.85
WORKER_COUNTS = (1, 2, 5, 10, 15)


def with_running_time(runs: DataFrame) -> DataFrame:
    """running_time = end_time - start_time in seconds (microsecond exact)."""
    secs = micros_between("start_time", "end_time") / 1e6
    return runs.withColumn("running_time", secs)


def above_threshold(runs: DataFrame, threshold: float = PERFORMANCE_THRESHOLD) -> DataFrame:
    """Keep runs with accuracy_test > threshold (a null accuracy is dropped)."""
    return runs.filter(F.col("accuracy_test") > threshold)


def by_mode(runs: DataFrame, mode: str, n_workers: Sequence[int] = WORKER_COUNTS) -> DataFrame:
    """Runs of one mode with the given worker counts, sorted by n_workers."""
    r = runs.withColumn("n_workers", F.col("n_workers").cast("int"))
    return r.filter((F.col("running_mode") == mode) & F.col("n_workers").isin(list(n_workers))).orderBy(
        "n_workers", "run_id")


def group_size(runs: DataFrame) -> DataFrame:
    return runs.groupBy("running_mode", "n_workers").agg(F.count(F.lit(1)).alias("n_runs"))


def comparison(runs: DataFrame, threshold: float = PERFORMANCE_THRESHOLD) -> DataFrame:
    """Mean time and accuracy by mode and worker count over good runs."""
    good = above_threshold(runs, threshold)
    return good.groupBy("running_mode", "n_workers").agg(
        F.avg("running_time").alias("avg_time"),
        F.avg("accuracy_test").alias("avg_accuracy_test"),
        F.count(F.lit(1)).alias("n_runs"),
    )


def report_text(runs: DataFrame) -> DataFrame:
    return runs.select("run_id", pct_text("accuracy_test").alias("accuracy_text"),
                       secs_text("running_time").alias("time_text"))


def timing(runs: DataFrame) -> DataFrame:
    return runs.groupBy("running_mode").agg(
        F.sum("running_time").alias("total_time"),
        F.avg("running_time").alias("avg_time"),
        F.max("running_time").alias("max_time"),
        F.count(F.lit(1)).alias("n_runs"),
    )


def weight_extremes(weights: DataFrame) -> DataFrame:
    """min and max weight and the smallest key holding each (struct order)."""
    g = weights.agg(
        F.min(F.struct("w", "k")).alias("lo"),
        F.max(F.struct("w", (-F.col("k")).alias("nk"))).alias("hi"),
        F.count(F.lit(1)).alias("n_keys"),
    )
    return g.select(out("lo.w").alias("min_w"), out("hi.w").alias("max_w"), F.col("lo.k").alias("k_min"),
                    (-F.col("hi.nk")).alias("k_max"), "n_keys")


def log_curves(logs: DataFrame) -> DataFrame:
    """``(run_id, series, worker, step, micros, value)``: the loss lists of run logs,
    one row a loss, with the microseconds since the run's start.  Series 'val' has
    no worker; 'train' has one curve a worker; ``step`` is the place in the list."""
    at = lambda text: F.to_timestamp_ntz(text, F.lit(TIME_FORMAT))
    val = logs.select("run_id", "start_time", F.lit("val").alias("series"), F.posexplode("losses_val").alias("step", "e")).select(
        "run_id", "start_time", "series", F.lit(None).cast("int").alias("worker"), "step", "e.time", F.col("e.loss_val").alias("value"))
    train = logs.select("run_id", "start_time", F.lit("train").alias("series"), F.posexplode("losses_train").alias("step", "e")).select(
        "run_id", "start_time", "series", F.col("e.worker_idx").alias("worker"), "step", "e.time", F.col("e.loss_train").alias("value"))
    return val.unionByName(train).select("run_id", "series", "worker", "step",
                                         micros_between(at("start_time"), at("time")).alias("micros"), "value")


def on_time_grid(curves: DataFrame, every_s: int) -> DataFrame:
    """``(run_id, series, worker, seconds, value)``: each curve at the multiples of
    ``every_s`` from its first loss on, with the last value at or before each, so
    that curves of runs with different steps can be compared.

    A loss belongs to the first grid point that is not before it; the last one
    there counts, and holds until the next point that has one of its own."""
    e, key = every_s * 1_000_000, ["run_id", "series", "worker"]
    cell = F.expr(f"(micros + {e - 1}) div {e}")
    last = curves.groupBy(*key, cell.alias("cell")).agg(F.max_by("value", F.struct("micros", "step")).alias("value"))
    after = F.lead("cell").over(Window.partitionBy(*key).orderBy("cell"))
    return last.withColumn("upto", F.coalesce(after - 1, F.col("cell"))).select(
        *key, F.explode(F.sequence("cell", "upto")).alias("c"), "value").select(
        *key, (F.col("c") * every_s).alias("seconds"), "value")
