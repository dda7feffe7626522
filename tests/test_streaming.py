import itertools
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from linearspark.functions.stopping import has_risen
from linearspark.operators import series as SE
from linearspark.session import scratch_path
from linearspark.sources import tables as T
from linearspark.streaming import jobs as SJ


def folder(spark, df, parts):
    return SJ.arrivals(df, parts, scratch_path(spark, "in"))


@pytest.mark.parametrize("parts", [None, 3])
def test_tables_as_a_file_and_as_a_folder(spark, parts):
    """Every row arrives once, in three micro-batches from a folder of three parts."""
    le = T.loss_events(spark, SF_SMALL)
    if parts is None:
        ev = T.table(spark, SF_SMALL, "events")
        stream = SJ.file_stream(spark, f"{SF_SMALL}/events.parquet", ev.schema, max_files=1).select(
            F.pmod("user_id", F.lit(4)).cast("int").alias("worker_idx"), "event_id", F.col("value").alias("loss"), "ts")
    else:
        stream = SJ.file_stream(spark, folder(spark, le, parts), le.schema, max_files=1)
    log = SJ.run_loss_log(spark, stream, scratch_path(spark, "losslog"))
    assert log.count() == le.count()
    assert {r.worker_idx for r in log.select("worker_idx").distinct().collect()} == {0, 1, 2, 3}
    out = scratch_path(spark, "stats")
    stats = {r["worker_idx"]: tuple(r) for r in SJ.run_loss_stats(spark, stream, out).collect()}
    want = {r["worker_idx"]: tuple(r) for r in SJ.loss_stats(le).collect()}
    assert stats.keys() == want.keys() and all(stats[k] == pytest.approx(want[k]) for k in want)
    assert spark.read.parquet(f"{out}/commits").count() == (parts or 1)


def _deltas(spark):
    data = [[(w, k, 0.1 * (k + 1) + w) for w in range(2) for k in range(b * 3, b * 3 + 5)] for b in range(4)]
    expect = {}
    for rows in data:
        for _, k, d in rows:
            expect[k] = expect.get(k, 0.0) + 0.5 * d
    return [spark.createDataFrame(rows, "worker int, k long, d double") for rows in data], expect


def test_delta_merge_flushes_several_times(spark):
    frames, expect = _deltas(spark)
    path = scratch_path(spark, "deltas")
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
    stream = SJ.file_stream(spark, path, frames[0].schema, max_files=1)
    root = scratch_path(spark, "dm")
    w = SJ.run_delta_merge(spark, stream, root, lr=0.5, flush_keys=6)
    assert {r["k"]: r["w"] for r in w.collect()} == pytest.approx(expect)
    assert spark.read.parquet(f"{root}/commits").count() >= 2


@pytest.mark.parametrize("replayed", [0, 1, 3])
def test_delta_merge_replay(spark, replayed):
    """A batch that runs again, before or after its commit, changes nothing."""
    frames, expect = _deltas(spark)
    root = scratch_path(spark, "dm")
    sink = SJ.delta_merge_sink(root, 0.5, 6)
    for i, f in enumerate(frames):
        sink(f, i)
        if i == replayed:
            sink(f, i)
    assert {r["k"]: r["w"] for r in SJ.flush(spark, root, 0.5).collect()} == pytest.approx(expect)


def test_online_sgd_replay(spark):
    feats = spark.createDataFrame([(i, k, 1.0 + i % 3) for i in range(12) for k in (0, 1 + i % 4)], "id long, k long, v double")
    batches = [spark.createDataFrame([(i, 1 if i % 3 else -1) for i in range(b, b + 4)], "id long, y int") for b in (0, 4, 8)]

    def run(again):
        root = scratch_path(spark, "online")
        sink = SJ.online_sgd_sink(root, feats, 0.1, 0.01, 10)
        for i, b in enumerate(batches):
            sink(b, i)
            if again == i:
                sink(b, i)
        return {r["k"]: r["w"] for r in SJ._latest_weights(spark, root).collect()}

    once = run(None)
    assert once and run(1) == pytest.approx(once) and run(2) == pytest.approx(once)


def _plain_stop(losses, p):
    return next((i for i in range(len(losses)) if has_risen(losses[:i + 1], p)), None)


def test_stop_step_is_the_same_for_every_arrival_order(spark):
    dice = random.Random(5)
    losses = {w: [10 - i * 0.5 + dice.random() if i < 9 else 6 + dice.random() for i in range(24)] for w in (0, 1)}
    rows = [(w, w * 100 + i, x, i) for w, series in losses.items() for i, x in enumerate(series)]
    schema = "worker_idx int, event_id long, loss double, i int"
    frame = spark.createDataFrame(rows, schema).select("worker_idx", "event_id", "loss", F.timestamp_seconds(F.col("i") * 60).alias("ts"))
    cuts = [frame.filter(F.minute("ts") < 8), frame.filter((F.minute("ts") >= 8) & (F.minute("ts") < 16)),
            frame.filter(F.minute("ts") >= 16)]
    want = {w: (_plain_stop(s, 4), len(s), min(s)) for w, s in losses.items()}
    assert all(v[0] is not None for v in want.values())
    for order in itertools.permutations(range(3)):
        root = scratch_path(spark, "es")
        sink = SJ.early_stop_sink(root, 4)
        for batch_id, c in enumerate(order):
            sink(cuts[c], batch_id)
        got = spark.read.parquet(f"{root}/stops/v=2").collect()
        assert {r["worker_idx"]: (r["stop_step"], r["n_steps"], r["best_loss"]) for r in got} == want, order
    root = scratch_path(spark, "es")
    sink = SJ.early_stop_sink(root, 4, 600)      # the first third comes last: late
    for batch_id, c in enumerate((1, 2, 0)):
        sink(cuts[c], batch_id)
    assert SJ.late_events(spark, root).count() == cuts[0].count()
    assert {r["n_steps"] for r in spark.read.parquet(f"{root}/stops/v=2").collect()} == {16}


def test_early_stop_stream_matches_batch(spark):
    le = T.loss_events(spark, SF_SMALL)
    stream = SJ.file_stream(spark, folder(spark, le, 3), le.schema, max_files=1)
    got = {tuple(r) for r in SJ.run_early_stop(spark, stream, scratch_path(spark, "es"), 5).select(
        "worker_idx", "stop_step", "n_steps", "best_loss").collect()}
    batch = SE.early_stop_step(SE.loss_curve(le), 5)
    assert got == {tuple(r) for r in batch.select("worker_idx", "stop_step", "n_steps", "best_loss").collect()}


def test_scratch_lives_under_checkpoint_dir(spark):
    from linearspark.session import ensure_checkpoint_dir, materialize
    base = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark) == base
    p = scratch_path(spark, "probe")
    assert p.startswith(base.replace("file:", ""))
    df = materialize(spark.range(5), "probe")
    root = base.replace("file:", "")
    assert df.count() == 5
    assert df.inputFiles() and all(root in f for f in df.inputFiles())


def test_windows_are_appended_once_when_over(spark):
    """Four files in time order; an event behind the watermark is dropped."""
    rows = [(0, m, float(m)) for m in range(40)] + [(1, m, 1.0) for m in range(0, 40, 5)]
    le = spark.createDataFrame(rows, "worker_idx int, m int, loss double").select(
        "worker_idx", "loss", F.timestamp_seconds(F.col("m") * 60).alias("ts"))
    path = SJ.arrivals_in_order(le, 4, scratch_path(spark, "ordered"))
    spark.createDataFrame([(0, 1.0, 1)], "worker_idx int, loss double, m int").select(
        "worker_idx", "loss", F.timestamp_seconds(F.col("m") * 60).alias("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = SJ.file_stream(spark, path, le.schema, max_files=1)
    got = SJ.run_window_stats(spark, stream, scratch_path(spark, "windows"), "10 minutes", "2 minutes").select(
        "worker_idx", F.unix_seconds("start").alias("s"), "n", "min_loss", "avg_loss").collect()
    want = {(0, s * 600): (10, s * 10.0, s * 10 + 4.5) for s in range(3)} | {(1, s * 600): (2, 1.0, 1.0) for s in range(3)}
    assert {(r["worker_idx"], r["s"]): (r["n"], r["min_loss"], r["avg_loss"]) for r in got} == want
    assert len(got) == len(want)
