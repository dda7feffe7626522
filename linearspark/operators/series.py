"""Metric series: step numbers, elapsed time and the early-stopping rule
(W1-W3, P16).

A series is identified by ``key`` (worker, run) and ordered by ``order``
columns; ties are broken by the order columns, which must be unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linearspark.functions import ts_text
from linearspark.functions.columns import micros_between
from linearspark.session import materialize

PERSISTENCE = 15   # the reference's early-stopping window
BLOCK = 65_536     # rows per block of a series in the early-stopping scan


def loss_curve(events: DataFrame, key: str = "worker_idx", order: Sequence[str] = ("ts", "event_id"),
               value: str = "loss", parts: int | None = None) -> DataFrame:
    """(key, step, value, order...): 0-based position in the series.

    Skew-safe: no task holds a whole series.  Rows are range-partitioned on
    (key, order...), so a large series spans many partitions; rows are
    numbered inside each (key, partition) group (a window over at most one
    partition's rows), and each group's offset is the count of the same
    key's rows in earlier partitions -- a small table (one row per key and
    partition).

    Range bounds come from a random sample and differ between jobs, so the
    partition assignment is written once (a reliable checkpoint in the shared
    folder) and both the counts and the rows read that same copy -- also
    after an executor is lost."""
    spark = events.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = events.select(key, value, *order).repartitionByRange(n, key, *order).withColumn(
        "_pid", F.spark_partition_id())
    r = materialize(r)
    local = Window.partitionBy(key, "_pid").orderBy(*order)
    r = r.withColumn("_i", F.row_number().over(local) - 1)
    summary = r.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    j = r.join(summary, [key, "_pid"])
    return j.select(key, (F.col("_off") + F.col("_i")).cast("long").alias("step"), value, *order)


def stop_flags(curve: DataFrame, p: int = PERSISTENCE, key: str = "worker_idx", value: str = "loss",
               block: int = BLOCK) -> DataFrame:
    """Add ``stop``: the early-stopping rule fires at this step.

    Rule (equivalent to the reference's stateful class up to its first stop):
    the minimum of the last ``p`` values (current included) is larger than the
    minimum of every value before them.

    Skew-safe: a series is cut into blocks of ``block`` steps (>= p - 1).
    The last p - 1 rows of every block are copied into the next block, so
    the sliding minimum is a window inside one block; the minimum of all
    earlier blocks comes from a per-block summary (steps / block rows per
    series).  A window partition holds at most block + p - 1 rows."""
    b = max(block, p - 1, 1)
    c = curve.withColumn("_blk", F.floor(F.col("step") / b).cast("long"))
    halo = c.filter(F.pmod(F.col("step"), F.lit(b)) >= b - (p - 1)).withColumn("_blk", F.col("_blk") + 1)
    both = c.withColumn("_own", F.lit(True)).unionByName(halo.withColumn("_own", F.lit(False)))
    ordered = Window.partitionBy(key, "_blk").orderBy("step")
    both = both.withColumn("_wmin", F.min(value).over(ordered.rowsBetween(-(p - 1), Window.currentRow))).withColumn(
        "_run", F.min(value).over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    bmin = c.groupBy(key, "_blk").agg(F.min(value).alias("_bm"))
    prev = Window.partitionBy(key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bmin = bmin.withColumn("_pm", F.min("_bm").over(prev)).drop("_bm")
    j = both.filter("_own").join(bmin, [key, "_blk"])
    best = F.least(F.col("_pm"), F.col("_run"))          # least() skips nulls
    return j.withColumn("stop", F.coalesce(F.col("_wmin") > best, F.lit(False))).select(*curve.columns, "stop")


def early_stop_step(curve: DataFrame, p: int = PERSISTENCE, key: str = "worker_idx",
                    value: str = "loss") -> DataFrame:
    """(key, stop_step, n_steps, best_loss): first step where the rule fires
    (null if never), series length and best value."""
    f = stop_flags(curve, p, key, value)
    return f.groupBy(key).agg(
        F.min(F.when(F.col("stop"), F.col("step"))).alias("stop_step"),
        F.count(F.lit(1)).alias("n_steps"),
        F.min(value).alias("best_loss"),
    )


def elapsed_seconds(events: DataFrame, key: str = "worker_idx", ts: str = "ts") -> DataFrame:
    """Add ``seconds`` since the series' first timestamp and ``time`` text.

    The first timestamp comes from a (partial) aggregate joined back on the
    key -- not a window -- so no task holds a whole series; AQE broadcasts the
    small per-key table at run time when it is small."""
    first = events.groupBy(key).agg(F.min(ts).alias("_t0"))
    j = events.join(first, key)
    return j.withColumn("seconds", micros_between("_t0", ts) / 1e6).withColumn(
        "time", ts_text(ts)).drop("_t0")
