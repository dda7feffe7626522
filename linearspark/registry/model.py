"""Queries over margins, predictions, losses, gradients, deltas and training
steps (P6-P14, A1-A8, A11, J2, J3, J5, M1, M2, M5, M6, M8-M10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linearspark.functions import hinge, out, predict_sign, predict_threshold, stable_margin
from linearspark.operators import features as FT
from linearspark.operators import gradients as G
from linearspark.operators import losses as L
from linearspark.operators import sampling as SP
from linearspark.plans import evaluate as EV
from linearspark.plans import steps as ST
from linearspark.registry.base import (DELTAS, EX_DOCS, EX_ORDERS, FEAT_DOCS, FEAT_ORDERS, MARGIN_DIGITS, POINTS,
                                       fixed_w, h, query, r6, r9, with_)
from linearspark.session import materialize
from linearspark.sources import tables as T

# Fixed parameters of the model queries (the reference's settings).
LR_HINGE = 0.03 * 100 / 1500      # RDD trainer: 0.03 * batch_per_worker / batch_size
REG_HINGE = 1e-6                  # RDD trainer: reg
LAM_SVM = 1e-5                    # SVM workers: lambda_reg
LR_SVM = 0.03 * (100 / 100) / 4   # 0.03 * (100 / subset) / n_workers, 4 workers
LAM_DENSE = 1e-3
LR_DENSE = 0.1
DELTA_SCALE = 0.01
BATCH = 1500
SEED = 1
DENSE_BATCH = 50
DENSE_SEED = 3
SYNC_WORKERS = 4
SYNC_SUBSET = 100


def d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


HINGE_SQL = "CASE WHEN isnan(1 - y * m) THEN CAST('inf' AS DOUBLE) ELSE greatest(1 - y * m, 0) END"

# margins of all orders at the fixed weights, with per-row weight sums
MG_ORDERS = [EX_ORDERS, FEAT_ORDERS, f"""fw AS (SELECT DISTINCT k, {fixed_w('k')} AS w FROM fo)""",
             """ms AS (SELECT f.id, sum(f.v * w.w) AS m, sum(w.w) AS sw, sum(w.w * w.w) AS sw2, count(*) AS nnz
                 FROM fo f JOIN fw w USING (k) GROUP BY f.id)""",
             f"""mg AS (SELECT e.id, e.y, {r9('ms.m')} AS m, ms.sw, ms.sw2, ms.nnz FROM ex e JOIN ms USING (id))"""]
ROWS_ORDERS = MG_ORDERS + ["""rw AS (SELECT f.id, mg.y, f.k, f.v, w.w, mg.m, mg.sw, mg.sw2, mg.nnz
                               FROM fo f JOIN fw w USING (k) JOIN mg USING (id))"""]


def _orders(spark, sf_dir):
    ex, feats = T.ex_orders(spark, sf_dir), T.feat_orders(spark, sf_dir)
    return ex, feats, FT.fixed_weights(feats)


def _order_margins(spark, sf_dir):
    ex, feats, w = _orders(spark, sf_dir)
    m = FT.labelled_margins(ex, feats, w)
    return m.select("id", "y", stable_margin("m", MARGIN_DIGITS).alias("m"))


@query("sparse_margin", with_(*MG_ORDERS) + f"SELECT id, y, {r6('m')} AS m FROM mg")
def sparse_margin(spark, sf_dir):
    return _order_margins(spark, sf_dir).select("id", "y", out("m").alias("m"))


# fixed dense weights, as long as the row's vector
FIXED_WL = f"[{fixed_w('i')} for i in range(len(x))]"
DOT = "list_dot_product(x, wl)"
PT_MARGIN = [POINTS, f"pm AS (SELECT id, y, x, wl, {r9(DOT)} AS m FROM (SELECT *, {FIXED_WL} AS wl FROM pt))"]


def by_slot(source: str) -> str:
    """Rows of ``source`` once per coordinate ``i`` (from 1)."""
    return f"(SELECT *, unnest(range(1, len(x) + 1)) AS i FROM {source})"


def _fixed_points(spark, sf_dir):
    points = T.points(spark, sf_dir)
    return points, FT.fixed_dense_weights(T.point_dim(points))


def _point_margins(spark, sf_dir):
    points, w = _fixed_points(spark, sf_dir)
    return G.dense_rows(points, w, digits=MARGIN_DIGITS)


@query("dense_dot", with_(*PT_MARGIN) + f"SELECT id, y, {r6('m')} AS m FROM pm")
def dense_dot(spark, sf_dir):
    return _point_margins(spark, sf_dir).select("id", "y", out("m").alias("m"))


@query("support_rows", with_(*MG_ORDERS) + f"SELECT id, y, {r6('m')} AS m FROM mg WHERE y * m < 1")
def support_rows(spark, sf_dir):
    return L.support_rows(_order_margins(spark, sf_dir)).select("id", "y", out("m").alias("m"))


@query("hinge_rows", with_(*MG_ORDERS) + f"SELECT id, y, {r6(HINGE_SQL)} AS hinge FROM mg")
def hinge_rows(spark, sf_dir):
    return L.hinge_rows(_order_margins(spark, sf_dir)).select("id", "y", out("hinge").alias("hinge"))


@query("predict_sign", with_(*MG_ORDERS) + "SELECT id, CAST(sign(m) AS INTEGER) AS pred FROM mg")
def predict_sign_q(spark, sf_dir):
    return _order_margins(spark, sf_dir).select("id", predict_sign("m").alias("pred"))


@query("predict_threshold", with_(*MG_ORDERS) +
       "SELECT id, CAST(CASE WHEN m > 0 THEN 1 ELSE -1 END AS INTEGER) AS pred FROM mg")
def predict_threshold_q(spark, sf_dir):
    return _order_margins(spark, sf_dir).select("id", predict_threshold("m").alias("pred"))


@query("score_all", with_(*MG_ORDERS) + f"""
SELECT id, y, {r6('m')} AS m, CAST(sign(m) AS INTEGER) AS pred_sign,
       CAST(CASE WHEN m > 0 THEN 1 ELSE -1 END AS INTEGER) AS pred_threshold FROM mg""")
def score_all(spark, sf_dir):
    ex, feats, w = _orders(spark, sf_dir)
    s = EV.score_all(ex, feats, w, digits=MARGIN_DIGITS)
    return s.select("id", "y", out("m").alias("m"), "pred_sign", "pred_threshold")


# ------------------------------------------------------------------ gradients

@query("hinge_gradient", with_(*ROWS_ORDERS) + f"""
SELECT k, ({r9(f"sum({d(LR_HINGE)} * CASE WHEN y * m < 1 THEN -v * y ELSE 0 END + w * w * {d(REG_HINGE)})")} + 0.0) AS g
FROM rw GROUP BY k""")
def hinge_gradient(spark, sf_dir):
    ex, feats, w = _orders(spark, sf_dir)
    fr = L.feature_rows(ex, feats, w, digits=MARGIN_DIGITS)
    # exact values lie on a 1e-8 grid: report 9 places so that no value sits
    # on a rounding boundary
    return G.hinge_sq_gradient(fr, LR_HINGE, REG_HINGE).select("k", out("g", 9).alias("g"))


SVM_D = f"CASE WHEN y * m < 1 THEN v * y - {d(2 * LAM_SVM)} * sw / nnz ELSE {d(2 * LAM_SVM)} * sw / nnz END"


@query("svm_delta", with_(*ROWS_ORDERS) + f"SELECT k, {r6(f'sum({SVM_D})')} AS d FROM rw GROUP BY k")
def svm_delta(spark, sf_dir):
    ex, feats, w = _orders(spark, sf_dir)
    fr = L.feature_rows(ex, feats, w, digits=MARGIN_DIGITS)
    return G.svm_mean_delta(fr, LAM_SVM).select("k", out("d").alias("d"))


@query("dense_gradient", with_(*PT_MARGIN) + f"""
SELECT CAST(i - 1 AS INTEGER) AS i,
       {r6(f"sum(CASE WHEN y * m < 1 THEN -x[i] * y ELSE 0 END + {d(LAM_DENSE)} * wl[i])")} AS g,
       count(*) AS n
FROM {by_slot("pm")} GROUP BY i""")
def dense_gradient(spark, sf_dir):
    points, w = _fixed_points(spark, sf_dir)
    g = G.dense_l2_gradient(G.dense_rows(points, w, digits=MARGIN_DIGITS), w, LAM_DENSE)
    return g.select("i", out("g").alias("g"), "n")


LOGF = "((1 / (1 + exp(-y * m)) - 1) * y)"


@query("logistic_gradient", with_(*PT_MARGIN) + f"""
SELECT CAST(i - 1 AS INTEGER) AS i, {r6(f'sum({LOGF} * x[i])')} AS g
FROM {by_slot("pm")} GROUP BY i""")
def logistic_gradient(spark, sf_dir):
    return G.logistic_gradient(_point_margins(spark, sf_dir)).select("i", out("g").alias("g"))


# ------------------------------------------------------------------ losses, accuracy

@query("svm_loss", with_(*MG_ORDERS) + f"SELECT {r6(f'avg({HINGE_SQL} + {d(LAM_SVM)} * sw2 / nnz)')} AS loss FROM mg")
def svm_loss(spark, sf_dir):
    ex, feats, w = _orders(spark, sf_dir)
    return L.svm_loss(L.example_stats(ex, feats, w, digits=MARGIN_DIGITS), LAM_SVM).select(out("loss").alias("loss"))


@query("primal_objective", with_(*MG_ORDERS) + f"""
SELECT {r6(f"avg({HINGE_SQL}) + {d(REG_HINGE / 2)} * (SELECT sum(w * w) FROM fw)")} AS objective FROM mg""")
def primal_objective(spark, sf_dir):
    ex, feats, w = _orders(spark, sf_dir)
    m = _order_margins(spark, sf_dir)
    return L.primal_objective(m, w, REG_HINGE).select(out("objective").alias("objective"))


@query("accuracy", with_(*MG_ORDERS) +
       f"SELECT {r6('avg(CASE WHEN y = (CASE WHEN m > 0 THEN 1 ELSE -1 END) THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM mg")
def accuracy(spark, sf_dir):
    return L.accuracy(_order_margins(spark, sf_dir)).select(out("accuracy").alias("accuracy"))


CLASS_ACC_SQL = """
    sum(CASE WHEN y = 1 AND sign(m) = 1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END), 0)""", """
    sum(CASE WHEN y = -1 AND sign(m) = -1 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN y = -1 THEN 1 ELSE 0 END), 0)""", """
    avg(CASE WHEN y = sign(m) THEN 1.0 ELSE 0.0 END)"""
CLASS_ACC_COLS = f"{r6(CLASS_ACC_SQL[0])} AS acc_pos, {r6(CLASS_ACC_SQL[1])} AS acc_neg, {r6(CLASS_ACC_SQL[2])} AS acc_tot"

MG_DOCS = [EX_DOCS, FEAT_DOCS, f"fwd AS (SELECT DISTINCT k, {fixed_w('k')} AS w FROM fd)",
           f"""mgd AS (SELECT e.id, e.y, {r9('s.m')} AS m FROM exd e JOIN
               (SELECT f.id, sum(f.v * w.w) AS m FROM fd f JOIN fwd w USING (k) GROUP BY f.id) s USING (id))"""]


@query("class_accuracy", with_(*MG_DOCS) + f"SELECT {CLASS_ACC_COLS} FROM mgd")
def class_accuracy(spark, sf_dir):
    ex = T.ex_docs(spark, sf_dir)
    # labelled documents only, tokenised once: the weights read the table
    feats = materialize(T.feat_docs(spark, sf_dir, ids=ex))
    m = FT.labelled_margins(ex, feats, FT.fixed_weights(feats)).select("id", "y", stable_margin("m", MARGIN_DIGITS).alias("m"))
    return L.class_accuracy(m).select(*[out(c).alias(c) for c in ("acc_pos", "acc_neg", "acc_tot")])


SPLIT_SQL = f"""sp AS (
    SELECT id, y, CASE WHEN row_number() OVER (ORDER BY {h(SEED, 'id')}, id)
                        <= floor(CAST(0.9 AS DOUBLE) * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part FROM ex),
hv AS (SELECT id FROM (
    SELECT id, row_number() OVER (ORDER BY {h(7, 'id')}, id) AS rn, count(*) OVER () AS n FROM sp WHERE part = 'train')
    WHERE rn <= floor(CAST(0.1 AS DOUBLE) * n)),
tagged AS (SELECT id, CASE WHEN part = 'test' THEN 'test' WHEN id IN (SELECT id FROM hv) THEN 'val' ELSE 'train' END AS split
           FROM sp)"""


@query("evaluation_report", with_(*MG_ORDERS, SPLIT_SQL) + f"""
SELECT split, {CLASS_ACC_COLS}, {r6(f'avg({HINGE_SQL} + {d(LAM_SVM)} * sw2 / nnz)')} AS loss, count(*) AS n
FROM mg JOIN tagged USING (id) GROUP BY split""")
def evaluation_report(spark, sf_dir):
    ex, feats, w = _orders(spark, sf_dir)
    tagged = EV.tag_splits(ex, ratio=0.9, seed=SEED, holdout=0.1, holdout_seed=7)   # cuts lineage inside
    r = EV.evaluation_report(tagged, feats, w, LAM_SVM, digits=MARGIN_DIGITS)
    return r.select("split", *[out(c).alias(c) for c in ("acc_pos", "acc_neg", "acc_tot", "loss")], "n")


STEPS = 3
STEP_BATCH = 150


@query("step_metrics", with_(*MG_ORDERS, SPLIT_SQL.split(",\nhv AS")[0], f"""
bt AS (SELECT step, id FROM (
    SELECT s.step, sp.id, sp.part, row_number() OVER (PARTITION BY s.step, sp.part
        ORDER BY CASE WHEN sp.part = 'train' THEN {h(SEED, 's.step', 'sp.id')} ELSE {h(SEED + 1, 's.step', 'sp.id')} END,
                 sp.id) AS rn
    FROM sp, (SELECT CAST(range AS INTEGER) AS step FROM range({STEPS})) s) WHERE rn <= {STEP_BATCH} AND part = 'train'),
bv AS (SELECT step, id FROM (
    SELECT s.step, sp.id, sp.part, row_number() OVER (PARTITION BY s.step, sp.part
        ORDER BY CASE WHEN sp.part = 'train' THEN {h(SEED, 's.step', 'sp.id')} ELSE {h(SEED + 1, 's.step', 'sp.id')} END,
                 sp.id) AS rn
    FROM sp, (SELECT CAST(range AS INTEGER) AS step FROM range({STEPS})) s) WHERE rn <= {STEP_BATCH} AND part = 'test')""") + f"""
SELECT v.step, v.val_objective, t.train_acc, v.val_acc FROM
 (SELECT step, {r6(f"avg({HINGE_SQL}) + {d(REG_HINGE / 2)} * (SELECT sum(w * w) FROM fw)")} AS val_objective,
         {r6('avg(CASE WHEN y = (CASE WHEN m > 0 THEN 1 ELSE -1 END) THEN 1.0 ELSE 0.0 END)')} AS val_acc
  FROM bv JOIN mg USING (id) GROUP BY step) v
 JOIN
 (SELECT step, {r6('avg(CASE WHEN y = (CASE WHEN m > 0 THEN 1 ELSE -1 END) THEN 1.0 ELSE 0.0 END)')} AS train_acc
  FROM bt JOIN mg USING (id) GROUP BY step) t USING (step)""")
def step_metrics(spark, sf_dir):
    ex, feats, w = _orders(spark, sf_dir)
    parts = materialize(SP.ratio_split(ex, 0.9, seed=SEED, label="part"))
    m = EV.step_metrics(parts, feats, w, steps=STEPS, batch=STEP_BATCH, seed=SEED, reg=REG_HINGE,
                        digits=MARGIN_DIGITS)
    return m.select("step", *[out(c).alias(c) for c in ("val_objective", "train_acc", "val_acc")])


# ------------------------------------------------------------------ deltas

@query("merge_deltas", with_(DELTAS) + f"""
SELECT k, {r6('sum(d)')} AS d, count(DISTINCT worker) AS n_workers, count(*) AS n_updates FROM dl GROUP BY k""")
def merge_deltas(spark, sf_dir):
    m = G.merge_deltas(T.deltas(spark, sf_dir))
    return m.select("k", out("d").alias("d"), "n_workers", "n_updates")


APPLIED = [DELTAS, f"""aw AS (SELECT k, sum(x) AS w FROM (
    SELECT DISTINCT k, {fixed_w('k')} AS x FROM dl
    UNION ALL SELECT k, {d(DELTA_SCALE)} * sum(d) AS x FROM dl GROUP BY k) GROUP BY k)"""]


def _applied(spark, sf_dir):
    dl = T.deltas(spark, sf_dir)
    merged = G.merge_deltas(dl)
    return G.apply_delta(FT.fixed_weights(dl), merged, DELTA_SCALE)


@query("apply_delta", with_(*APPLIED) + f"SELECT k, {r6('w')} AS w FROM aw")
def apply_delta(spark, sf_dir):
    return _applied(spark, sf_dir).select("k", out("w").alias("w"))


@query("weight_extremes", with_(*APPLIED) + f"""
SELECT {r6('min(w)')} AS min_w, {r6('max(w)')} AS max_w,
       (SELECT min(k) FROM aw WHERE w = (SELECT min(w) FROM aw)) AS k_min,
       (SELECT min(k) FROM aw WHERE w = (SELECT max(w) FROM aw)) AS k_max,
       count(*) AS n_keys FROM aw""")
def weight_extremes(spark, sf_dir):
    from linearspark.operators.runs import weight_extremes as op
    return op(_applied(spark, sf_dir))


# ------------------------------------------------------------------ training steps

def _hinge_step_sql(prev: str | None, step: int, out_name: str) -> list[str]:
    wsrc = f"LEFT JOIN {prev} pw USING (k)" if prev else ""
    wexpr = "coalesce(pw.w, 0)" if prev else "CAST(0 AS DOUBLE)"
    union_prev = f"SELECT k, w AS x FROM {prev} UNION ALL " if prev else ""
    s = f"s{step}"
    return [
        f"b{s} AS (SELECT id, y FROM ex ORDER BY {h(SEED, str(step), 'id')}, id LIMIT {BATCH})",
        f"r{s} AS (SELECT f.id, b.y, f.k, f.v, {wexpr} AS w FROM fo f JOIN b{s} b USING (id) {wsrc})",
        f"m{s} AS (SELECT id, {r9('sum(v * w)')} AS m FROM r{s} GROUP BY id)",
        f"""g{s} AS (SELECT k, sum({d(LR_HINGE)} * CASE WHEN r.y * mm.m < 1 THEN -r.v * r.y ELSE 0 END
                               + r.w * r.w * {d(REG_HINGE)}) AS g
                  FROM r{s} r JOIN m{s} mm USING (id) GROUP BY k)""",
        f"{out_name} AS (SELECT k, sum(x) AS w FROM ({union_prev}SELECT k, -g AS x FROM g{s}) GROUP BY k)",
    ]


@query("train_hinge_2step", with_(EX_ORDERS, FEAT_ORDERS, *_hinge_step_sql(None, 0, "w1"),
                                  *_hinge_step_sql("w1", 1, "w2")) + f"SELECT k, {r6('w')} AS w FROM w2")
def train_hinge_2step(spark, sf_dir):
    ex, feats = T.ex_orders(spark, sf_dir), T.feat_orders(spark, sf_dir)
    w = ST.hinge_steps(ex, feats, steps=2, batch=BATCH, seed=SEED, lr=LR_HINGE, reg=REG_HINGE,
                       digits=MARGIN_DIGITS)
    return w.select("k", out("w").alias("w"))


def _svm_step_sql(prev: str | None, step: int, out_name: str) -> list[str]:
    wsrc = f"LEFT JOIN {prev} pw USING (k)" if prev else ""
    wexpr = "coalesce(pw.w, 0)" if prev else "CAST(0 AS DOUBLE)"
    union_prev = f"SELECT k, w AS x FROM {prev} UNION ALL " if prev else ""
    s = f"v{step}"
    return [
        f"""b{s} AS (SELECT worker, id, y FROM (
              SELECT wk.worker, e.id, e.y, row_number() OVER (PARTITION BY wk.worker
                     ORDER BY {h(SEED, str(step), 'wk.worker', 'e.id')}, e.id) AS rn
              FROM ex e, (SELECT CAST(range AS INTEGER) AS worker FROM range({SYNC_WORKERS})) wk)
            WHERE rn <= {SYNC_SUBSET})""",
        f"r{s} AS (SELECT b.worker, f.id, b.y, f.k, f.v, {wexpr} AS w FROM fo f JOIN b{s} b USING (id) {wsrc})",
        f"""m{s} AS (SELECT worker, id, {r9('sum(v * w)')} AS m, sum(w) AS sw, count(*) AS nnz
                  FROM r{s} GROUP BY worker, id)""",
        f"""g{s} AS (SELECT k, sum(CASE WHEN r.y * mm.m < 1 THEN r.v * r.y - {d(2 * LAM_SVM)} * mm.sw / mm.nnz
                                   ELSE {d(2 * LAM_SVM)} * mm.sw / mm.nnz END) AS d
                  FROM r{s} r JOIN m{s} mm USING (worker, id) GROUP BY k)""",
        f"{out_name} AS (SELECT k, sum(x) AS w FROM ({union_prev}SELECT k, {d(LR_SVM)} * d AS x FROM g{s}) GROUP BY k)",
    ]


@query("train_svm_sync_2step", with_(EX_ORDERS, FEAT_ORDERS, *_svm_step_sql(None, 0, "w1"),
                                     *_svm_step_sql("w1", 1, "w2")) + f"SELECT k, {r6('w')} AS w FROM w2")
def train_svm_sync_2step(spark, sf_dir):
    ex, feats = T.ex_orders(spark, sf_dir), T.feat_orders(spark, sf_dir)
    w = ST.svm_sync_steps(ex, feats, steps=2, workers=SYNC_WORKERS, subset=SYNC_SUBSET, seed=SEED,
                          lr=LR_SVM, lam=LAM_SVM, digits=MARGIN_DIGITS)
    return w.select("k", out("w").alias("w"))


def _dense_step_sql(prev: str | None, step: int, out_name: str) -> list[str]:
    s = f"d{step}"
    wl = f"(SELECT list(w ORDER BY i) FROM {prev})" if prev else "[CAST(0 AS DOUBLE) for v in x]"
    return [
        f"""b{s} AS (SELECT id, y, x, {wl} AS wl FROM pt ORDER BY {h(DENSE_SEED, str(step), 'id')}, id LIMIT {DENSE_BATCH})""",
        f"m{s} AS (SELECT id, y, x, wl, {r9(DOT)} AS m FROM b{s})",
        f"""{out_name} AS (SELECT CAST(i - 1 AS INTEGER) AS i,
                  any_value(wl[i]) - {d(LR_DENSE)} * sum(CASE WHEN y * m < 1 THEN -x[i] * y ELSE 0 END
                                                          + {d(LAM_DENSE)} * wl[i]) / {DENSE_BATCH} AS w
                  FROM {by_slot(f"m{s}")} GROUP BY i)""",
    ]


@query("train_dense_2step", with_(POINTS, *_dense_step_sql(None, 0, "w1"), *_dense_step_sql("w1", 1, "w2")) +
       f"SELECT i, {r6('w')} AS w FROM w2")
def train_dense_2step(spark, sf_dir):
    points = T.points(spark, sf_dir)
    w = ST.dense_steps(points, T.point_dim(points), steps=2, batch=DENSE_BATCH, seed=DENSE_SEED,
                       lr=LR_DENSE, lam=LAM_DENSE, digits=MARGIN_DIGITS)
    return w.select("i", out("w").alias("w"))


def _logistic_step_sql(prev: str | None, step: int, out_name: str) -> list[str]:
    s = f"l{step}"
    wl = f"(SELECT list(w ORDER BY i) FROM {prev})" if prev else FIXED_WL
    return [
        f"m{s} AS (SELECT y, x, wl, {r9(DOT)} AS m FROM (SELECT y, x, {wl} AS wl FROM pt))",
        f"""{out_name} AS (SELECT CAST(i - 1 AS INTEGER) AS i, any_value(wl[i]) - sum({LOGF} * x[i]) AS w
                  FROM {by_slot(f"m{s}")} GROUP BY i)""",
    ]


@query("train_logistic_2step", with_(POINTS, *_logistic_step_sql(None, 0, "w1"), *_logistic_step_sql("w1", 1, "w2")) +
       f"SELECT i, {r6('w')} AS w FROM w2")
def train_logistic_2step(spark, sf_dir):
    points, w0 = _fixed_points(spark, sf_dir)
    w = ST.logistic_steps(points, w0, steps=2, digits=MARGIN_DIGITS)
    return w.select("i", out("w").alias("w"))


START_SEED = 42
SEEDED_WL = f"""[2 * (CAST(('0x' || substr(md5('{START_SEED}:' || i), 1, 13))::UBIGINT AS DOUBLE) / {d(float(2 ** 52))}) - 1
                for i in range(len(x))]"""


@query("train_logistic_seeded_2step", with_(POINTS, *[c.replace(FIXED_WL, SEEDED_WL) for c in _logistic_step_sql(None, 0, "w1")],
                                            *_logistic_step_sql("w1", 1, "w2")) + f"SELECT i, {r6('w')} AS w FROM w2")
def train_logistic_seeded_2step(spark, sf_dir):
    """M6 from random start weights."""
    points = T.points(spark, sf_dir)
    w0 = ST.random_start(spark, T.point_dim(points), START_SEED)
    w = ST.logistic_steps(points, w0, steps=2, digits=MARGIN_DIGITS)
    return w.select("i", out("w").alias("w"))
