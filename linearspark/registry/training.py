"""Training-loop queries (M3, M4, M7) and streaming queries."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import functions as F

from linearspark.functions import out
from linearspark.functions.columns import utc_micros
from linearspark.operators import features as FT
from linearspark.operators import gradients as G
from linearspark.operators import sampling as SP
from linearspark.operators import series as SE
from linearspark.plans import local_sgd as LS
from linearspark.plans import vectorized as VZ
from linearspark.registry.base import DELTAS, EX_ORDERS, FEAT_ORDERS, LOSS_EVENTS, MARGIN_DIGITS, h, query, r6, r9, with_
from linearspark.registry.model import LAM_SVM, LR_HINGE, LR_SVM, REG_HINGE
from linearspark.session import materialize
from linearspark.sources import tables as T
from linearspark.streaming import jobs as SJ

ROUNDS = 2
SHARDS = 4
SUBSET = 100
EPOCHS = 40
VAL_ROWS = 500
STOP_P = 3
EARLY_STEPS = 30
EARLY_BATCH = 1500     # a smaller table's batch is all of its training rows
STREAM_LR = 0.0075
STREAM_SUBSET = 2


def _weights_frame(spark, w: np.ndarray):
    """Dense weights (dim numbers on the driver) as a (k, w) table."""
    nz = np.nonzero(w)[0]
    return spark.createDataFrame([(int(k), float(w[k])) for k in nz], "k long, w double")


def _local_sgd_sql(rounds=ROUNDS, shards=SHARDS, subset=SUBSET, seed=1):
    """The sequential per-row rule replayed in SQL: a recursive CTE per round
    advances each shard one sampled row at a time, holding the weights and the
    running delta totals as dense lists; shard totals are summed by key and
    applied with lr at the round end."""
    lr, lam = f"CAST({LR_SVM!r} AS DOUBLE)", f"CAST({LAM_SVM!r} AS DOUBLE)"
    ctes = [EX_ORDERS, FEAT_ORDERS,
            "dm AS (SELECT max(k) + 1 AS d FROM fo)",
            "pk AS (SELECT id, list(k ORDER BY k) AS ks, list(v ORDER BY k) AS vs FROM fo GROUP BY id)",
            "zero AS (SELECT list_transform(range((SELECT d FROM dm)), lambda i: CAST(0 AS DOUBLE)) AS z)",
            "w_0 AS (SELECT z AS w FROM zero)"]
    delta = "(CASE WHEN sp THEN vs[list_position(ks, i)] * y - rg ELSE rg END)"
    for r in range(rounds):
        ctes += [
            f"""rows_{r} AS (SELECT s.worker, s.rn, s.y, p.ks, p.vs FROM (
                  SELECT wk.worker, e.id, e.y, row_number() OVER (PARTITION BY wk.worker
                         ORDER BY {h(seed, str(r), 'wk.worker', 'e.id')}, e.id) AS rn
                  FROM ex e, (SELECT CAST(range AS INTEGER) AS worker FROM range({shards})) wk) s
                JOIN pk p USING (id) WHERE s.rn <= {subset})""",
            f"""it_{r}(worker, rn, w, tot) AS (
                  SELECT wk.worker, CAST(0 AS BIGINT), (SELECT w FROM w_{r}), (SELECT z FROM zero)
                  FROM (SELECT CAST(range AS INTEGER) AS worker FROM range({shards})) wk
                  UNION ALL
                  SELECT worker, rn,
                         list_transform(range(len(w)), lambda i: w[i + 1] +
                             CASE WHEN list_position(ks, i) > 0 THEN {lr} * {delta} ELSE 0 END),
                         list_transform(range(len(w)), lambda i: tot[i + 1] +
                             CASE WHEN list_position(ks, i) > 0 THEN {delta} ELSE 0 END)
                  FROM (SELECT it.worker, q.rn, it.w, it.tot, q.ks, q.vs, q.y,
                               list_sum(list_transform(range(len(q.ks)), lambda j: q.vs[j + 1] * it.w[q.ks[j + 1] + 1]))
                                   * q.y < 1 AS sp,
                               2 * {lam} * list_sum(list_transform(q.ks, lambda k: it.w[k + 1])) / len(q.ks) AS rg
                        FROM it_{r} it JOIN rows_{r} q ON q.worker = it.worker AND q.rn = it.rn + 1))""",
            f"""d_{r} AS (SELECT t.k, sum(it.tot[t.k + 1]) AS d
                  FROM (SELECT DISTINCT unnest(ks) AS k FROM rows_{r}) t,
                       (SELECT * FROM it_{r} WHERE rn = {subset}) it GROUP BY t.k)""",
            f"""dd_{r} AS (SELECT list(coalesce(dr.d, 0) ORDER BY g.i) AS dl
                  FROM (SELECT unnest(range((SELECT d FROM dm))) AS i) g LEFT JOIN d_{r} dr ON dr.k = g.i)""",
            f"""w_{r + 1} AS (SELECT list_transform(range(len(w)), lambda i: w[i + 1] + {lr} * dl[i + 1]) AS w
                  FROM w_{r}, dd_{r})""",
        ]
    last = rounds - 1
    final = f"""SELECT k, {r6('w')} AS w FROM (
        SELECT u.k, (SELECT w FROM w_{last})[u.k + 1] + {lr} * coalesce(d.d, 0) AS w
        FROM (SELECT DISTINCT k FROM (
                SELECT i AS k FROM (SELECT unnest(range(len(w))) AS i, unnest(w) AS x FROM w_{last}) WHERE x <> 0
                UNION SELECT k FROM d_{last})) u
        LEFT JOIN d_{last} d USING (k))"""
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + final


@query("train_local_sgd", _local_sgd_sql())
def train_local_sgd(spark, sf_dir):
    ex, feats = T.ex_orders(spark, sf_dir), T.feat_orders(spark, sf_dir)
    packed = LS.packed_examples(ex, feats).persist(StorageLevel.MEMORY_AND_DISK)
    n_rows = packed.count()                   # fills the cache; sizes every round's sample
    dim = int(FT.feature_dim_packed(packed).first()["dim"])          # from the cache
    w = LS.train_local_sgd(packed, dim, ROUNDS - 1, SHARDS, SUBSET, seed=1, lr=LR_SVM, lam=LAM_SVM, n_rows=n_rows)
    last = LS.local_sgd_round(packed, w, SHARDS, SUBSET, 1, ROUNDS - 1, LR_SVM, LAM_SVM, n_rows)
    merged = last.groupBy("k").agg(F.sum("d").alias("d"))
    final = materialize(G.apply_delta(_weights_frame(spark, w), merged, LR_SVM))   # dim rows
    packed.unpersist()
    return final.select("k", out("w").alias("w"))


def _independent_sql(workers=SHARDS, epochs=EPOCHS, subset=SUBSET, seed=5):
    """Each worker replays its pool (budget * subset rows in hash order) from
    w = 0 with the per-row rule; the weight changes are summed by key.  With
    budget = epochs / workers <= PERSISTENCE the early-stopping window never
    slides, so the rule cannot fire (a new value never lifts the minimum of
    all values); stopping itself is covered by the brute-force test."""
    budget = max(epochs // workers, 1)
    assert budget <= SE.PERSISTENCE
    lr, lam = f"CAST({LR_SVM!r} AS DOUBLE)", f"CAST({LAM_SVM!r} AS DOUBLE)"
    n = budget * subset
    delta = "(CASE WHEN sp THEN vs[list_position(ks, i)] * y - rg ELSE rg END)"
    ctes = [EX_ORDERS, FEAT_ORDERS,
            "dm AS (SELECT max(k) + 1 AS d FROM fo)",
            "pk AS (SELECT id, list(k ORDER BY k) AS ks, list(v ORDER BY k) AS vs FROM fo GROUP BY id)",
            "zero AS (SELECT list_transform(range((SELECT d FROM dm)), lambda i: CAST(0 AS DOUBLE)) AS z)",
            f"""rows AS (SELECT s.worker, s.rn, s.y, p.ks, p.vs FROM (
                  SELECT wk.worker, e.id, e.y, row_number() OVER (PARTITION BY wk.worker
                         ORDER BY {h(seed, '0', 'wk.worker', 'e.id')}, e.id) AS rn
                  FROM ex e, (SELECT CAST(range AS INTEGER) AS worker FROM range({workers})) wk) s
                JOIN pk p USING (id) WHERE s.rn <= {n})""",
            f"""it(worker, rn, w) AS (
                  SELECT wk.worker, CAST(0 AS BIGINT), (SELECT z FROM zero)
                  FROM (SELECT CAST(range AS INTEGER) AS worker FROM range({workers})) wk
                  UNION ALL
                  SELECT worker, rn, list_transform(range(len(w)), lambda i: w[i + 1] +
                             CASE WHEN list_position(ks, i) > 0 THEN {lr} * {delta} ELSE 0 END)
                  FROM (SELECT it.worker, q.rn, it.w, q.ks, q.vs, q.y,
                               list_sum(list_transform(range(len(q.ks)), lambda j: q.vs[j + 1] * it.w[q.ks[j + 1] + 1]))
                                   * q.y < 1 AS sp,
                               2 * {lam} * list_sum(list_transform(q.ks, lambda k: it.w[k + 1])) / len(q.ks) AS rg
                        FROM it JOIN rows q ON q.worker = it.worker AND q.rn = it.rn + 1))"""]
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"""
SELECT k, {r6('sum(x)')} AS w FROM (
    SELECT unnest(range(len(w))) AS k, unnest(w) AS x FROM it WHERE rn = {n}) WHERE x <> 0 GROUP BY k"""


@query("train_independent", small_sql=_independent_sql())
def train_independent(spark, sf_dir):
    ex, feats = T.ex_orders(spark, sf_dir), T.feat_orders(spark, sf_dir)
    packed = LS.packed_examples(ex, feats).persist(StorageLevel.MEMORY_AND_DISK)
    n_rows = packed.count()
    dim = int(FT.feature_dim_packed(packed).first()["dim"])
    val_ids = SP.sample_exact(ex.select("id"), VAL_ROWS, seed=11)
    val = packed.join(F.broadcast(val_ids), "id", "left_semi")
    o = LS.train_independent(packed, dim, SHARDS, EPOCHS, SUBSET, seed=5, lr=LR_SVM, lam=LAM_SVM,
                             persistence=SE.PERSISTENCE, val=val, n_rows=n_rows)
    final = materialize(LS.combine_independent(o))                     # dim rows
    packed.unpersist()
    return final.select("k", out("w").alias("w"))


def _early_stop_sql() -> str:
    """All EARLY_STEPS hinge steps unrolled; validation objective and accuracy
    after each step; history cut at the first step where the W1 rule fires."""
    lr, reg = f"CAST({LR_HINGE!r} AS DOUBLE)", f"CAST({REG_HINGE!r} AS DOUBLE)"
    ctes = [EX_ORDERS, FEAT_ORDERS, f"""sp AS (
        SELECT id, y, CASE WHEN row_number() OVER (ORDER BY {h(1, 'id')}, id)
                            <= floor(CAST(0.9 AS DOUBLE) * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part
        FROM ex)""", "w0 AS (SELECT CAST(NULL AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS w WHERE false)"]
    stats = []
    for s in range(EARLY_STEPS):
        w, w1 = f"w{s}", f"w{s + 1}"
        ctes += [
            f"b{s} AS (SELECT id, y FROM sp WHERE part = 'train' ORDER BY {h(1, str(s), 'id')}, id LIMIT {EARLY_BATCH})",
            f"""r{s} AS (SELECT f.id, b.y, f.k, f.v, coalesce(pw.w, 0) AS w
                 FROM fo f JOIN b{s} b USING (id) LEFT JOIN {w} pw USING (k))""",
            f"m{s} AS (SELECT id, {r9('sum(v * w)')} AS m FROM r{s} GROUP BY id)",
            f"""g{s} AS (SELECT k, sum({lr} * CASE WHEN r.y * mm.m < 1 THEN -r.v * r.y ELSE 0 END + r.w * r.w * {reg}) AS g
                 FROM r{s} r JOIN m{s} mm USING (id) GROUP BY k)""",
            f"{w1} AS (SELECT k, sum(x) AS w FROM (SELECT k, w AS x FROM {w} UNION ALL SELECT k, -g FROM g{s}) GROUP BY k)",
            f"""vm{s} AS (SELECT t.id, t.y, sum(f.v * coalesce(pw.w, 0)) AS m
                 FROM sp t JOIN fo f USING (id) LEFT JOIN {w1} pw USING (k) WHERE t.part = 'test' GROUP BY t.id, t.y)""",
        ]
        stats.append(f"""SELECT CAST({s} AS BIGINT) AS step,
                 avg(greatest(1 - y * m, 0)) + {reg} / 2 * (SELECT coalesce(sum(w * w), 0) FROM {w1}) AS obj,
                 avg(CASE WHEN y = (CASE WHEN m > 0 THEN 1 ELSE -1 END) THEN 1.0 ELSE 0.0 END) AS acc FROM vm{s}""")
    ctes.append("st AS (" + " UNION ALL ".join(stats) + ")")
    ctes.append(f"""fl AS (SELECT step, obj, acc,
        min(obj) OVER (ORDER BY step ROWS BETWEEN {STOP_P - 1} PRECEDING AND CURRENT ROW) AS wmin,
        min(obj) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM st)""")
    return with_(*ctes) + f"""SELECT step, {r6('obj')} AS val_objective, {r6('acc')} AS val_acc FROM fl
WHERE step <= coalesce((SELECT min(step) FROM fl WHERE wmin > best), {EARLY_STEPS})"""


@query("train_early_stop", _early_stop_sql())
def train_early_stop(spark, sf_dir):
    ex, feats = T.ex_orders(spark, sf_dir), T.feat_orders(spark, sf_dir)
    dim = int(FT.feature_dim(feats).first()["dim"])
    parts = materialize(SP.ratio_split(ex, 0.9, seed=1, label="part"))
    train = parts.filter(F.col("part") == "train").select("id", "y")
    val = parts.filter(F.col("part") == "test").select("id", "y")
    batch = min(EARLY_BATCH, max(train.count(), 1))
    w, hist = VZ.train_hinge(train, feats, dim, EARLY_STEPS, batch, seed=1, lr=LR_HINGE, reg=REG_HINGE,
                             val=val, persistence=STOP_P, digits=MARGIN_DIGITS)
    h = spark.createDataFrame([(int(s), float(o), float(a)) for s, o, a in hist],
                              "step long, val_objective double, val_acc double")
    return h.select("step", out("val_objective").alias("val_objective"), out("val_acc").alias("val_acc"))


# ------------------------------------------------------------------ streaming

ARRIVALS = 4        # files, and so micro-batches, that a streamed table arrives in


def _arriving(spark, table, name):
    """``table`` as a stream of several micro-batches."""
    path = SJ.arrivals(table, ARRIVALS, SJ.new_root(spark, name))
    return SJ.file_stream(spark, path, table.schema, max_files=1)


def _events_stream(spark, sf_dir):
    return _arriving(spark, T.loss_events(spark, sf_dir), "events")


@query("stream_loss_stats", with_(LOSS_EVENTS) + f"""
SELECT worker_idx, count(*) AS n, {r6('min(loss)')} AS min_loss, {r6('avg(loss)')} AS avg_loss
FROM le GROUP BY worker_idx""")
def stream_loss_stats(spark, sf_dir):
    # The receiver appends every loss message, and keeps per-worker stats
    events = _events_stream(spark, sf_dir)
    SJ.run_loss_log(spark, events, SJ.new_root(spark, "loss-log"))
    r = SJ.run_loss_stats(spark, events, SJ.new_root(spark, "loss-stats"))
    return r.select("worker_idx", "n", out("min_loss").alias("min_loss"), out("avg_loss").alias("avg_loss"))


WINDOW_S, DELAY_S = 86_400, 3_600


@query("stream_loss_windows", with_(LOSS_EVENTS) + f"""
SELECT worker_idx, (epoch_us(ts) // {WINDOW_S * 10**6}) * {WINDOW_S} AS start_s, count(*) AS n,
       {r6('min(loss)')} AS min_loss, {r6('avg(loss)')} AS avg_loss
FROM le GROUP BY worker_idx, epoch_us(ts) // {WINDOW_S * 10**6}
HAVING (start_s + {WINDOW_S} + {DELAY_S}) * 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM le)""")
def stream_loss_windows(spark, sf_dir):
    le = T.loss_events(spark, sf_dir).withColumn("ts", F.timestamp_micros(utc_micros("ts")))    # a watermark needs an instant
    path = SJ.arrivals_in_order(le, ARRIVALS, SJ.new_root(spark, "events-in-order"))
    stream = SJ.file_stream(spark, path, le.schema, max_files=1)
    r = SJ.run_window_stats(spark, stream, SJ.new_root(spark, "loss-windows"), f"{WINDOW_S} seconds", f"{DELAY_S} seconds")
    return r.select("worker_idx", F.unix_seconds("start").alias("start_s"), "n", out("min_loss").alias("min_loss"),
                    out("avg_loss").alias("avg_loss"))


@query("stream_delta_merge", with_(DELTAS) +
       f"SELECT k, {r6(f'CAST({STREAM_LR!r} AS DOUBLE) * sum(d)')} AS w FROM dl GROUP BY k")
def stream_delta_merge(spark, sf_dir):
    # the workers' subsets are small beside the key space here, so that the rule fires
    dl = _arriving(spark, T.deltas(spark, sf_dir), "deltas")
    w = SJ.run_delta_merge(spark, dl, SJ.new_root(spark, "delta-merge"), STREAM_LR, flush_keys=STREAM_SUBSET * SHARDS)
    return w.select("k", out("w").alias("w"))


@query("stream_early_stop", with_(LOSS_EVENTS, """cv AS (SELECT worker_idx, row_number() OVER
    (PARTITION BY worker_idx ORDER BY ts, event_id) - 1 AS step, loss FROM le)""", f"""fl AS (SELECT worker_idx, step, loss,
    min(loss) OVER (PARTITION BY worker_idx ORDER BY step ROWS BETWEEN {SE.PERSISTENCE - 1} PRECEDING AND CURRENT ROW)
        AS wmin,
    min(loss) OVER (PARTITION BY worker_idx ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
    FROM cv)""") + f"""
SELECT worker_idx, min(step) FILTER (WHERE wmin > best) AS stop_step, count(*) AS n_steps,
       {r6('min(loss)')} AS best_loss FROM fl GROUP BY worker_idx""")
def stream_early_stop(spark, sf_dir):
    r = SJ.run_early_stop(spark, _events_stream(spark, sf_dir), SJ.new_root(spark, "early-stop"), SE.PERSISTENCE)
    return r.select("worker_idx", "stop_step", "n_steps", out("best_loss").alias("best_loss"))


# All files of orders arrive in one micro-batch (availableNow without a bound on
# files), so the stream's result is one full hinge step from w = 0 over every order.
@query("stream_online_sgd", with_(EX_ORDERS, FEAT_ORDERS) + f"""
SELECT k, {r6(f"-sum(CAST({LR_HINGE!r} AS DOUBLE) * CASE WHEN y * 0 < 1 THEN -v * y ELSE 0 END + 0.0)")} AS w
FROM fo JOIN ex USING (id) GROUP BY k""")
def stream_online_sgd(spark, sf_dir):
    schema = T.table(spark, sf_dir, "orders").schema
    o = SJ.file_stream(spark, f"{sf_dir}/orders.parquet", schema)
    ex = o.select(F.col("o_orderkey").alias("id"),
                  F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).cast("int").alias("y"))
    feats = T.feat_orders(spark, sf_dir)
    dim = int(FT.feature_dim(feats).first()["dim"])
    w = SJ.run_online_sgd(spark, ex, feats, SJ.new_root(spark, "online-sgd"), LR_HINGE, REG_HINGE, dim)
    return w.select("k", out("w").alias("w"))
