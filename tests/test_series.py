import random

from linearspark.operators import series as SE


def _loop(values, p):
    """First step whose last p values are all above some value before them."""
    return next((t for t in range(p, len(values))
                 if any(all(x > old for x in values[t - p + 1:t + 1]) for old in values[:t - p + 1])), None)


def _spark_stop(spark, series, p):
    rows = [(w, t, float(v)) for w, vals in enumerate(series) for t, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "worker_idx int, step long, loss double")
    return {r["worker_idx"]: r["stop_step"] for r in SE.early_stop_step(df, p).collect()}


def test_examples(spark):
    got = _spark_stop(spark, [[3, 1, 2, 2], [1, 1, 1]], 2)
    assert got == {0: 3, 1: None}


def test_against_loop(spark):
    rnd = random.Random(5)
    series = [[rnd.choice([1, 2, 3, 4, 5]) + rnd.random() * (i % 2) for _ in range(rnd.randint(1, 40))]
              for i in range(40)]
    for p in (1, 2, 3, 5):
        got = _spark_stop(spark, series, p)
        assert got == {i: _loop(s, p) for i, s in enumerate(series)}


def test_blocked_scan_small_blocks(spark):
    """Tiny blocks and few partitions force halos and offsets to be used."""
    from pyspark.sql import functions as F
    rnd = random.Random(9)
    series = [[rnd.choice([1, 2, 3, 4, 5]) + rnd.random() for _ in range(rnd.randint(1, 60))] for _ in range(12)]
    rows = [(w, t, float(v)) for w, vals in enumerate(series) for t, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "worker_idx int, t long, loss double").withColumn("event_id", F.col("t"))
    for parts in (1, 3, 7):
        c = SE.loss_curve(df, order=("t", "event_id"), parts=parts)
        assert sorted((r.worker_idx, r.step) for r in c.collect()) == sorted((w, t) for w, t, _ in rows)
        for p, blk in ((2, 1), (3, 4), (5, 5)):
            f = SE.stop_flags(c, p, block=blk)
            firsts = {}
            for r in f.filter("stop").collect():
                firsts[r.worker_idx] = min(firsts.get(r.worker_idx, 10**9), r.step)
            assert firsts == {i: _loop(s, p) for i, s in enumerate(series) if _loop(s, p) is not None}
