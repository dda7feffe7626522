"""Queries over run logs, metric series and sinks (S6, U2, F1, F2, A9, A12, T5,
P16-P18, M11, W1-W3, K1-K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linearspark.functions import out, ts_text
from linearspark.operators import runs as RN
from linearspark.operators import series as SE
from linearspark.registry.base import DELTAS, LOSS_EVENTS, RUNS, fixed_w, query, r6, with_
from linearspark.session import scratch_path
from linearspark.sources import runlog as RL
from linearspark.sources import sinks as SK
from linearspark.sources import tables as T

THR = RN.PERFORMANCE_THRESHOLD
P = SE.PERSISTENCE

RUNS_T = [RUNS, "rt AS (SELECT *, (epoch_us(end_time) - epoch_us(start_time)) / CAST(1e6 AS DOUBLE) AS running_time "
                "FROM runs)"]
TS_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def _runs(spark, sf_dir):
    return RN.with_running_time(T.runs(spark, sf_dir))


@query("run_log_flatten", with_(*RUNS_T) + f"""
SELECT run_id, running_mode, n_workers, {r6('accuracy_test')} AS accuracy_test,
       {r6('running_time')} AS running_time, {TS_TEXT.format('start_time')} AS start_time FROM rt""")
def run_log_flatten(spark, sf_dir):
    path = scratch_path(spark, "runlogs")
    RL.write_run_logs(RL.to_log_records(_runs(spark, sf_dir)), path)
    logs = RL.flatten_run_logs(RL.read_run_logs(spark, path, multi_line=False, glob="*.json"))
    return logs.select("run_id", "running_mode", "n_workers", out("accuracy_test").alias("accuracy_test"),
                       out("running_time").alias("running_time"), "start_time")


@query("run_log_append", with_(*RUNS_T) + f"""
SELECT run_id, n_workers, CASE WHEN run_id % 2 = 1 THEN running_mode END AS running_mode,
       CASE WHEN run_id % 2 = 0 THEN {r6('accuracy_test')} END AS accuracy_test FROM rt""")
def run_log_append(spark, sf_dir):
    """Logs of two program versions with different fields, appended by name."""
    runs, paths = T.runs(spark, sf_dir), [scratch_path(spark, "runlogs-old"), scratch_path(spark, "runlogs-new")]
    for rest, path, field in ((0, paths[0], "accuracy_test"), (1, paths[1], "running_mode")):
        RL.write_run_logs(runs.filter(F.pmod("run_id", F.lit(2)) == rest).select("run_id", "n_workers", field), path)
    logs = RL.read_run_logs_inferred(spark, paths, multi_line=False)
    return logs.select("run_id", F.col("n_workers").cast("int").alias("n_workers"), "running_mode",
                       out("accuracy_test").alias("accuracy_test"))


@query("runs_above_threshold", with_(*RUNS_T) +
       f"SELECT run_id, {r6('accuracy_test')} AS accuracy_test FROM rt WHERE accuracy_test > CAST({THR} AS DOUBLE)")
def runs_above_threshold(spark, sf_dir):
    return RN.above_threshold(_runs(spark, sf_dir)).select("run_id", out("accuracy_test").alias("accuracy_test"))


@query("runs_by_mode", with_(*RUNS_T) + f"""
SELECT run_id, n_workers, {r6('running_time')} AS running_time, {r6('accuracy_test')} AS accuracy_test
FROM rt WHERE running_mode = 'synchronous' AND n_workers IN (1, 2, 5, 10, 15) ORDER BY n_workers, run_id""")
def runs_by_mode(spark, sf_dir):
    r = RN.by_mode(_runs(spark, sf_dir), "synchronous")
    return r.select("run_id", "n_workers", out("running_time").alias("running_time"),
                    out("accuracy_test").alias("accuracy_test"))


@query("runs_group_size", with_(*RUNS_T) +
       "SELECT running_mode, n_workers, count(*) AS n_runs FROM rt GROUP BY running_mode, n_workers")
def runs_group_size(spark, sf_dir):
    return RN.group_size(_runs(spark, sf_dir))


@query("run_comparison", with_(*RUNS_T) + f"""
SELECT running_mode, n_workers, {r6('avg(running_time)')} AS avg_time,
       {r6('avg(accuracy_test)')} AS avg_accuracy_test, count(*) AS n_runs
FROM rt WHERE accuracy_test > CAST({THR} AS DOUBLE) GROUP BY running_mode, n_workers""")
def run_comparison(spark, sf_dir):
    c = RN.comparison(_runs(spark, sf_dir))
    return c.select("running_mode", "n_workers", out("avg_time").alias("avg_time"),
                    out("avg_accuracy_test").alias("avg_accuracy_test"), "n_runs")


@query("run_report_text", with_(*RUNS_T) + """
SELECT run_id, CAST(CAST(trunc(accuracy_test * 100) AS BIGINT) AS VARCHAR) || '%' AS accuracy_text,
       CAST(CAST(trunc(running_time) AS BIGINT) AS VARCHAR) || ' s' AS time_text FROM rt""")
def run_report_text(spark, sf_dir):
    return RN.report_text(_runs(spark, sf_dir))


@query("run_timing", with_(*RUNS_T) + f"""
SELECT running_mode, {r6('sum(running_time)')} AS total_time, {r6('avg(running_time)')} AS avg_time,
       {r6('max(running_time)')} AS max_time, count(*) AS n_runs FROM rt GROUP BY running_mode""")
def run_timing(spark, sf_dir):
    t = RN.timing(_runs(spark, sf_dir))
    return t.select("running_mode", *[out(c).alias(c) for c in ("total_time", "avg_time", "max_time")], "n_runs")


# ------------------------------------------------------------------ series

CURVE = [LOSS_EVENTS, """cv AS (SELECT worker_idx, row_number() OVER (PARTITION BY worker_idx ORDER BY ts, event_id) - 1
                        AS step, loss, ts, event_id FROM le)"""]


@query("loss_curve", with_(*CURVE) + f"SELECT worker_idx, step, {r6('loss')} AS loss FROM cv")
def loss_curve(spark, sf_dir):
    c = SE.loss_curve(T.loss_events(spark, sf_dir))
    return c.select("worker_idx", "step", out("loss").alias("loss"))


@query("early_stop_step", with_(*CURVE, f"""fl AS (SELECT worker_idx, step, loss,
    min(loss) OVER (PARTITION BY worker_idx ORDER BY step ROWS BETWEEN {P - 1} PRECEDING AND CURRENT ROW) AS wmin,
    min(loss) OVER (PARTITION BY worker_idx ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
    FROM cv)""") + f"""
SELECT worker_idx, min(step) FILTER (WHERE wmin > best) AS stop_step, count(*) AS n_steps,
       {r6('min(loss)')} AS best_loss FROM fl GROUP BY worker_idx""")
def early_stop_step(spark, sf_dir):
    s = SE.early_stop_step(SE.loss_curve(T.loss_events(spark, sf_dir)))
    return s.select("worker_idx", "stop_step", "n_steps", out("best_loss").alias("best_loss"))


@query("elapsed_seconds", with_(LOSS_EVENTS) + f"""
SELECT worker_idx, event_id,
       {r6('(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY worker_idx)) / CAST(1e6 AS DOUBLE)')} AS seconds,
       {TS_TEXT.format('ts')} AS time FROM le""")
def elapsed_seconds(spark, sf_dir):
    e = SE.elapsed_seconds(T.loss_events(spark, sf_dir))
    return e.select("worker_idx", "event_id", out("seconds").alias("seconds"), "time")


GRID_S = 86_400

LOG_POINTS = """lp AS (SELECT user_id AS run_id, CASE WHEN event_id % 2 = 0 THEN 'val' ELSE 'train' END AS series,
        CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(event_id % 3 AS INTEGER) END AS worker, event_id AS pos,
        epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS us, value FROM events)"""


@query("loss_curves_from_logs", with_(LOG_POINTS, f"""gr AS (SELECT run_id, series, worker, unnest(range(
        min(us + {GRID_S * 10**6 - 1}) // {GRID_S * 10**6}, max(us + {GRID_S * 10**6 - 1}) // {GRID_S * 10**6} + 1)) AS c
        FROM lp GROUP BY run_id, series, worker)""") + f"""
SELECT g.run_id, g.series, g.worker, g.c * {GRID_S} AS seconds, {r6('arg_max(p.value, (p.us, p.pos))')} AS value
FROM gr g JOIN lp p ON p.run_id = g.run_id AND p.series = g.series AND p.worker IS NOT DISTINCT FROM g.worker
    AND p.us <= g.c * {GRID_S * 10**6} GROUP BY g.run_id, g.series, g.worker, g.c""")
def loss_curves_from_logs(spark, sf_dir):
    """Run logs with nested loss lists are written (a run a user, validation losses
    and those of three workers), read back and aligned on a grid of days."""
    ev = T.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), "event_id", "ts", "value", (F.col("event_id") % 2 == 0).alias("val"))
    order = lambda e: F.transform(F.array_sort(F.collect_list(e)), lambda x: x["e"])
    time = ts_text("ts").alias("time")
    val = F.when(F.col("val"), F.struct("ts", "event_id", F.struct(time, F.col("value").alias("loss_val")).alias("e")))
    train = F.when(~F.col("val"), F.struct("ts", "event_id", F.struct(
        F.pmod("event_id", F.lit(3)).cast("int").alias("worker_idx"), F.col("value").alias("loss_train"), time).alias("e")))
    logs = ev.groupBy("run_id").agg(ts_text(F.min("ts")).alias("start_time"), ts_text(F.max("ts")).alias("end_time"),
                                    order(val).alias("losses_val"), order(train).alias("losses_train"))
    path = scratch_path(spark, "curve-logs")
    RL.write_run_logs(logs, path)
    back = RL.read_run_logs(spark, path, multi_line=False, glob="*.json")
    grid = RN.on_time_grid(RN.log_curves(back), GRID_S)
    return grid.select("run_id", "series", "worker", "seconds", out("value").alias("value"))


# ------------------------------------------------------------------ sinks

APPLIED_W = [DELTAS, f"""aw AS (SELECT k, sum(x) AS w FROM (
    SELECT DISTINCT k, {fixed_w('k')} AS x FROM dl
    UNION ALL SELECT k, CAST(0.01 AS DOUBLE) * sum(d) AS x FROM dl GROUP BY k) GROUP BY k)"""]


@query("weights_roundtrip", with_(*APPLIED_W) + f"SELECT k, {r6('w')} AS w FROM aw")
def weights_roundtrip(spark, sf_dir):
    from linearspark.registry.model import _applied
    path = scratch_path(spark, "weights")
    SK.write_weights(_applied(spark, sf_dir), path)
    return SK.read_weights(spark, path).select("k", out("w").alias("w"))


@query("metrics_roundtrip", with_(*CURVE) +
       f"SELECT CAST(worker_idx AS BIGINT) AS run_id, 'loss' AS series, step, {r6('loss')} AS value FROM cv")
def metrics_roundtrip(spark, sf_dir):
    c = SE.loss_curve(T.loss_events(spark, sf_dir))
    m = c.select(F.col("worker_idx").cast("long").alias("run_id"), F.lit("loss").alias("series"), "step",
                 "ts", F.col("loss").alias("value"))
    path = scratch_path(spark, "metrics")
    SK.write_metrics(m, path)
    back = SK.read_metrics(spark, path)
    return back.select("run_id", "series", "step", out("value").alias("value"))


@query("run_log_build", with_(LOSS_EVENTS) + f"""
SELECT CAST(worker_idx AS BIGINT) AS run_id, {TS_TEXT.format('min(ts)')} AS start_time,
       {TS_TEXT.format('max(ts)')} AS end_time,
       {r6('(epoch_us(max(ts)) - epoch_us(min(ts))) / CAST(1e6 AS DOUBLE)')} AS running_time,
       count(*) AS n_losses, {r6('min(loss)')} AS min_loss
FROM le GROUP BY worker_idx""")
def run_log_build(spark, sf_dir):
    le = T.loss_events(spark, sf_dir)
    path = scratch_path(spark, "runlog")
    SK.write_run_log(le, path, run_col="worker_idx")
    runs, losses = SK.read_run_log(spark, path)
    per_run = losses.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_losses"), F.min("loss_val").alias("min_loss"))
    j = runs.join(per_run, "run_id")
    return j.select("run_id", "start_time", "end_time", out("running_time").alias("running_time"), "n_losses",
                    out("min_loss").alias("min_loss"))


@query("worker_loss_log", with_(LOSS_EVENTS) +
       f"SELECT worker_idx AS worker, {TS_TEXT.format('ts')} AS time, {r6('loss')} AS loss_val FROM le")
def worker_loss_log(spark, sf_dir):
    le = T.loss_events(spark, sf_dir)
    path = scratch_path(spark, "workerlogs")
    SK.write_worker_loss_log(le, path)
    back = SK.read_worker_loss_log(spark, path)
    return back.select(F.col("worker").cast("int").alias("worker"), "time", out("loss_val").alias("loss_val"))
