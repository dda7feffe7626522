"""Structured Streaming operators.

The reference moves loss messages and weight deltas between processes over
gRPC.  Here the messages are rows of a streaming DataFrame, read from a table
that is one file or a folder of part files:

* R1 ``loss_stats``       per-worker count / min / mean loss, complete mode
* R2 ``delta_merge``      deltas summed per key and applied to a versioned
                          weights table with the flush rule "distinct keys
                          pending >= subset * workers" (plus a final flush)
* R3 ``online_sgd``       one hinge SGD step per micro-batch of examples,
                          weights versioned by batch id
* R4 ``early_stop``       the early-stopping rule in event order, whatever the
                          order in which the rows arrive

Every sink is written from ``foreachBatch`` into the shared scratch folder;
a batch id is part of every path, so a replayed batch overwrites its own
output (idempotent).  A version counts once its commit row is written, which
is the last write of its batch.  Checkpoints live in the same shared folder.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linearspark.functions.columns import utc_micros
from linearspark.operators import gradients as G
from linearspark.operators import losses as L
from linearspark.operators import series as SE
from linearspark.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """The parquet table at ``path``, one file or a folder of part files, as a
    stream of at most ``max_files`` files a micro-batch."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # a pattern that matches the path alone: the source takes a plain path for a folder
    return r.parquet(f"{path[:-1]}[{path[-1]}]")


def arrivals(df: DataFrame, parts: int, path: str) -> str:
    """``df`` written as a folder of ``parts`` files or more: a table that a stream
    with ``max_files`` reads in several micro-batches."""
    df.repartition(parts).write.mode("overwrite").parquet(path)
    return path


def _run(writer, name: str, spark: SparkSession) -> None:
    q = writer.option("checkpointLocation", scratch_path(spark, f"ckpt-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


# ------------------------------------------------------------------ R1

def loss_stats(loss_events: DataFrame) -> DataFrame:
    return loss_events.groupBy("worker_idx").agg(
        F.count(F.lit(1)).alias("n"), F.min("loss").alias("min_loss"), F.avg("loss").alias("avg_loss"))


def run_loss_log(spark: SparkSession, loss_events: DataFrame, out: str) -> DataFrame:
    """The receiver's append log: every loss message lands in a table
    partitioned by worker (a file sink is exactly-once with its checkpoint)."""
    w = (loss_events.writeStream.format("parquet").option("path", out).partitionBy("worker_idx")
         .outputMode("append"))
    _run(w, "loss-log", spark)
    return spark.read.parquet(out)


def run_loss_stats(spark: SparkSession, loss_events: DataFrame, out: str) -> DataFrame:
    """Complete-mode aggregate; each batch writes a table of its own, the last
    committed one counts."""
    def sink(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(os.path.join(out, "stats", f"v={batch_id}"))
        _commit(spark, out, batch_id)
    _run(loss_stats(loss_events).writeStream.outputMode("complete").foreachBatch(sink), "loss-stats", spark)
    return spark.read.parquet(os.path.join(out, "stats", f"v={_committed(spark, out)}"))


def arrivals_in_order(df: DataFrame, parts: int, path: str, ts: str = "ts") -> str:
    """``df`` written in ``parts`` files or more, one time range after the other, as
    a log grows: a stream with ``max_files`` sees the events in order of ranges."""
    at = utc_micros(ts)
    cuts = df.select(at.alias("t")).approxQuantile("t", [i / parts for i in range(1, parts)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        own = df if low is None else df.filter(at >= F.lit(int(low)))
        own = own if high is None else own.filter(at < F.lit(int(high)))
        own.coalesce(1).write.mode("append").parquet(path)
    return path


def window_stats(loss_events: DataFrame, width: str, delay: str) -> DataFrame:
    """``(worker_idx, start, n, min_loss, avg_loss)`` of tumbling event-time windows;
    a window's row comes once, when the watermark (the latest event less ``delay``)
    has passed its end, and its state goes then.  Later events of it are dropped."""
    per = loss_events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "worker_idx").agg(
        F.count(F.lit(1)).alias("n"), F.min("loss").alias("min_loss"), F.avg("loss").alias("avg_loss"))
    return per.select("worker_idx", F.col("w.start").alias("start"), "n", "min_loss", "avg_loss")


def run_window_stats(spark: SparkSession, loss_events: DataFrame, out: str, width: str, delay: str) -> DataFrame:
    """The windows that are over, appended to a table (exactly once by its checkpoint)."""
    w = window_stats(loss_events, width, delay).writeStream.format("parquet").option("path", out).outputMode("append")
    _run(w, "loss-windows", spark)
    return spark.read.schema("worker_idx int, start timestamp, n long, min_loss double, avg_loss double").parquet(out)


# ------------------------------------------------------------------ R2

def _read_opt(spark: SparkSession, path: str) -> DataFrame | None:
    """A partitioned table in the shared folder, or None before its first write
    (works on any Hadoop file system: no local listing)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _commit(spark: SparkSession, root: str, version: int) -> None:
    """The last write of a version: one row that names it."""
    spark.range(version, version + 1).toDF("v").coalesce(1).write.mode("overwrite").parquet(
        os.path.join(root, "commits", f"batch={version}"))


def _committed(spark: SparkSession, root: str, before: int | None = None) -> int:
    """The newest committed version (below ``before``), -1 without one: a row a
    version is read, never the weights."""
    c = _read_opt(spark, os.path.join(root, "commits"))
    if c is None:
        return -1
    v = (c if before is None else c.filter(F.col("v") < before)).agg(F.max("v")).first()[0]
    return -1 if v is None else int(v)


def _latest_weights(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """The newest weights, or those of the newest version below ``before``."""
    v = _committed(spark, root, before)
    if v < 0:
        return spark.createDataFrame([], "k long, w double")
    return spark.read.parquet(os.path.join(root, "weights", f"v={v}")).select("k", "w")


def _pending(spark: SparkSession, root: str, after: int, upto: int | None = None) -> DataFrame | None:
    """Buffered deltas of the batches after the last flush (and up to ``upto``)."""
    b = _read_opt(spark, os.path.join(root, "buffer"))
    if b is None:
        return None
    b = b.filter(F.col("batch") > after)
    if upto is not None:
        b = b.filter(F.col("batch") <= upto)
    return b if b.limit(1).count() else None


def delta_merge_sink(root: str, lr: float, flush_keys: int):
    """foreachBatch function of R2.  A replayed batch sees what it saw first: the
    versions below its own and the buffers up to its own."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged = batch.groupBy("k").agg(F.sum("d").alias("d"))
        merged.write.mode("overwrite").parquet(os.path.join(root, "buffer", f"batch={batch_id}"))
        pend = _pending(spark, root, _committed(spark, root, batch_id), batch_id)
        if pend is not None and pend.select("k").distinct().count() >= flush_keys:
            flush(spark, root, lr, batch_id)
    return sink


def flush(spark: SparkSession, root: str, lr: float, version: int | None = None) -> DataFrame:
    """Apply the pending deltas to the latest weights, as version ``version`` (that
    of the last buffered batch, if not given)."""
    pend = _pending(spark, root, _committed(spark, root, version), version)
    if pend is None:
        return _latest_weights(spark, root)
    if version is None:
        version = int(pend.agg(F.max("batch")).first()[0])
    summed = pend.groupBy("k").agg(F.sum("d").alias("d"))
    new = G.apply_delta(_latest_weights(spark, root, version), summed, lr)
    new.write.mode("overwrite").parquet(os.path.join(root, "weights", f"v={version}"))
    _commit(spark, root, version)
    return _latest_weights(spark, root)


def run_delta_merge(spark: SparkSession, deltas: DataFrame, root: str, lr: float, flush_keys: int) -> DataFrame:
    _run(deltas.writeStream.foreachBatch(delta_merge_sink(root, lr, flush_keys)), "delta-merge", spark)
    return flush(spark, root, lr)       # the final flush


# ------------------------------------------------------------------ R3

def online_sgd_sink(root: str, feats: DataFrame, lr: float, reg: float, dim: int):
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        w = _latest_weights(spark, root, batch_id)      # a replay starts where the batch first did
        own = batch.select("id", "y")
        mine = feats.join(own.select("id"), "id", "left_semi")      # the batch's features only
        fr = L.feature_rows(own, mine, w, n_weights=dim)
        g = G.hinge_sq_gradient(fr, lr, reg)
        new = G.apply_delta(w, g, -1.0, value="g")
        new.write.mode("overwrite").parquet(os.path.join(root, "weights", f"v={batch_id}"))
        _commit(spark, root, batch_id)
    return sink


def run_online_sgd(spark: SparkSession, examples: DataFrame, feats: DataFrame, root: str, lr: float, reg: float,
                   dim: int) -> DataFrame:
    _run(examples.writeStream.foreachBatch(online_sgd_sink(root, feats, lr, reg, dim)), "online-sgd", spark)
    return _latest_weights(spark, root)


# ------------------------------------------------------------------ R4

def early_stop_sink(root: str, p: int, delay_s: int | None = None):
    """foreachBatch function of R4: the batch's events join the log, the rule runs
    over the log in event order (``series.early_stop_step``: blocks with a halo, so
    no task holds a worker's series), and the result is a version of its own.

    With ``delay_s`` an event that is more than so many seconds older than the latest
    of the batches before it is late: it goes to a table of its own and does not
    count."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = os.path.join(root, "log")
        keep = batch
        if delay_s is not None:
            before = _read_opt(spark, log)
            latest = before.filter(F.col("batch") < batch_id).agg(F.max(utc_micros("ts"))).first()[0] if before is not None else None
            if latest is not None:
                on_time = utc_micros("ts") >= latest - delay_s * 1_000_000
                batch.filter(~on_time).write.mode("overwrite").parquet(os.path.join(root, "late", f"batch={batch_id}"))
                keep = batch.filter(on_time)
        keep.write.mode("overwrite").parquet(os.path.join(log, f"batch={batch_id}"))
        seen = spark.read.parquet(log).filter(F.col("batch") <= batch_id)
        SE.early_stop_step(SE.loss_curve(seen.drop("batch")), p).write.mode("overwrite").parquet(
            os.path.join(root, "stops", f"v={batch_id}"))
        _commit(spark, root, batch_id)
    return sink


def late_events(spark: SparkSession, root: str) -> DataFrame | None:
    return _read_opt(spark, os.path.join(root, "late"))


def run_early_stop(spark: SparkSession, loss_events: DataFrame, root: str, p: int, delay_s: int | None = None) -> DataFrame:
    """``(worker_idx, stop_step, n_steps, best_loss)`` after the last micro-batch."""
    _run(loss_events.writeStream.foreachBatch(early_stop_sink(root, p, delay_s)), "early-stop", spark)
    return spark.read.parquet(os.path.join(root, "stops", f"v={_committed(spark, root)}"))


def new_root(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
