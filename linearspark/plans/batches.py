"""Batches of many training steps, drawn in one scan and written once (M1, M2, M7).

Every (step, worker) needs the ``n`` examples with the smallest
``(md5(seed:step[:worker]:id), id)``.  One scan computes a row's hashes for all
of them and emits only the pairs below a threshold that keeps about
``n + 8 sqrt(n)`` rows each; the few that a pair has too many are cut by rank.
The examples' features are then packed in one pass and the batches written as
one folder a step, so a training step reads its own rows and nothing else: the
base tables are read the same number of times whatever the number of steps.

The bias, which every example has, is a column of its own (``bias``): joins on
the feature key never see its hot key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.operators.features import BIAS_KEY, BROADCAST_MAX_KEYS
from linearspark.operators.sampling import slot_samples
from linearspark.session import materialize, scratch_path



def draw(ex: DataFrame, n: int, seed: int, steps: int, workers: int | None = None,
         n_rows: int | None = None) -> DataFrame:
    """``(step, worker, id, y)``: the batches of all steps and workers, in one scan."""
    return slot_samples(ex.select("id", "y"), n, seed, steps, workers, n_rows=n_rows)


def pack_with_bias(feats: DataFrame) -> DataFrame:
    """``(id, bias, kv)``: the bias value, and the other features by key."""
    kv = F.struct("k", "v")
    return feats.groupBy("id").agg(
        F.coalesce(F.sum(F.when(F.col("k") == BIAS_KEY, F.col("v"))), F.lit(0.0)).alias("bias"),
        F.array_sort(F.collect_list(F.when(F.col("k") != BIAS_KEY, kv))).alias("kv"))


def write_batches(drawn: DataFrame, feats: DataFrame, rows: int | None = None,
                  pack: Callable[[DataFrame], DataFrame] = pack_with_bias) -> str:
    """The drawn rows with their features (as ``pack`` has them), one folder a step;
    returns the path.  ``rows`` (a bound on the drawn rows) lets their ids travel
    as a broadcast."""
    spark = drawn.sparkSession
    drawn = materialize(drawn, "drawn-rows")
    ids = drawn.select("id").distinct()
    ids = F.broadcast(ids) if rows is not None and rows <= BROADCAST_MAX_KEYS else ids
    packed = pack(feats.join(ids, "id", "left_semi"))
    path = scratch_path(spark, "batches")
    drawn.join(packed, "id").repartition("step").write.partitionBy("step").parquet(path)
    return path


def of_step(spark, path: str, step: int, schema=None) -> DataFrame:
    """The rows of one step's batch: the other folders are not listed or read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/step={step}")
