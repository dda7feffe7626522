"""Run logs (D13): JSON writer and reader.

The reference writes one JSON *array holding one object* per run
(``log.json``), with fields that differ between program versions.  The reader
takes a folder, keeps files whose name contains ``log`` and reads them with
one explicit schema (fields absent in a version come back null), in one
distributed scan.  Our writer emits JSON lines; the reader reads both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linearspark.functions import ts_text

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

ACCURACY_FIELDS = [f"accuracy{c}_{s}" for s in ("train", "val", "test") for c in ("", "_1", "_-1")]

RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("end_time", T.StringType()),
        T.StructField("running_time", T.DoubleType()),
        T.StructField("n_workers", T.StringType()),       # a string or a number, by version
        T.StructField("running_mode", T.StringType()),
        T.StructField("sync_epochs", T.LongType()),
    ]
    + [T.StructField(a, T.DoubleType()) for a in ACCURACY_FIELDS]
    + [
        T.StructField("losses_val", T.ArrayType(T.StructType([
            T.StructField("time", T.StringType()), T.StructField("loss_val", T.DoubleType())]))),
        T.StructField("losses_train", T.ArrayType(T.StructType([
            T.StructField("worker_idx", T.IntegerType()), T.StructField("loss_train", T.DoubleType()),
            T.StructField("time", T.StringType())]))),
    ]
)


def read_run_logs(spark: SparkSession, path: str, multi_line: bool = True, glob: str = "*log*") -> DataFrame:
    """All run logs below ``path`` whose file name matches ``glob``."""
    r = (spark.read.schema(RUN_LOG_SCHEMA).option("multiLine", multi_line)
         .option("pathGlobFilter", glob).option("recursiveFileLookup", True).json(path))
    return r.withColumn("log_file", F.input_file_name())


def flatten_run_logs(logs: DataFrame) -> DataFrame:
    """Flat view: n_workers as INT, times parsed to wall-clock timestamps
    (TIMESTAMP_NTZ: no session time-zone shift)."""
    return logs.withColumn("n_workers", F.col("n_workers").cast("int")).withColumn(
        "start_ts", F.to_timestamp_ntz("start_time", F.lit(TIME_FORMAT))).withColumn(
        "end_ts", F.to_timestamp_ntz("end_time", F.lit(TIME_FORMAT)))


def to_log_records(runs: DataFrame) -> DataFrame:
    """Run rows with timestamps -> D13 records (times as text)."""
    cols = [c for c in runs.columns if c not in ("start_time", "end_time")]
    return runs.select(*cols, ts_text("start_time").alias("start_time"), ts_text("end_time").alias("end_time"))


def write_run_logs(records: DataFrame, path: str) -> None:
    """JSON lines, one record per run; files are named part-*.json, so the
    reader is pointed at them with glob '*.json'."""
    records.write.mode("overwrite").json(path)


def read_run_logs_inferred(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """Logs of different program versions, each read with its own inferred
    schema and appended by name; fields a version lacks come back null."""
    frames = [spark.read.option("multiLine", multi_line).json(p) for p in paths]
    return append_logs(frames)


def append_logs(frames: list[DataFrame]) -> DataFrame:
    """``pd.concat`` of logs with different fields: union by name, missing
    columns filled with null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
