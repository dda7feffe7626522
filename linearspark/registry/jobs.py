"""Queries of whole training runs: live metrics (M10), early-stopped SVM (M7 over
M2), train-evaluate-log (M9 + K3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from linearspark.functions import out
from linearspark.operators import sampling as SP
from linearspark.plans import evaluate as EV
from linearspark.plans import trainer as TR
from linearspark.plans.batches import draw, pack_with_bias, write_batches
from linearspark.registry.base import EX_ORDERS, FEAT_ORDERS, MARGIN_DIGITS, h, query, r6, r9, with_
from linearspark.registry.model import (CLASS_ACC_SQL, HINGE_SQL, LAM_SVM, LR_HINGE, LR_SVM, REG_HINGE, SEED, SPLIT_SQL,
                                        STEP_BATCH, SYNC_SUBSET, SYNC_WORKERS, d)
from linearspark.session import materialize, scratch_path
from linearspark.sources import runlog as RL
from linearspark.sources import tables as T

LIVE_STEPS = 3
JOB_STEPS = 3
STOP_STEPS = 10
STOP_PATIENCE = 2

PART_SQL = SPLIT_SQL.split(",\nhv AS")[0]


def _hinge_sql(step: int, source: str) -> list[str]:
    """Weights ``w<step + 1>`` from ``w<step>`` by one batch of ``source``."""
    s = str(step)
    return [
        f"b{s} AS (SELECT id, y FROM {source} ORDER BY {h(SEED, s, 'id')}, id LIMIT {STEP_BATCH})",
        f"r{s} AS (SELECT f.id, b.y, f.k, f.v, coalesce(w.w, 0) AS w FROM fo f JOIN b{s} b USING (id) LEFT JOIN w{s} w USING (k))",
        f"m{s} AS (SELECT id, {r9('sum(v * w)')} AS m FROM r{s} GROUP BY id)",
        f"""w{step + 1} AS (SELECT k, sum(x) AS w FROM (SELECT k, w AS x FROM w{s} UNION ALL
            SELECT r.k, -({d(LR_HINGE)} * CASE WHEN r.y * m.m < 1 THEN -r.v * r.y ELSE 0 END + r.w * r.w * {d(REG_HINGE)})
            FROM r{s} r JOIN m{s} m USING (id)) GROUP BY k)"""]


NO_WEIGHTS = "w0 AS (SELECT CAST(NULL AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS w WHERE false)"


def _live_sql() -> str:
    ctes = [EX_ORDERS, FEAT_ORDERS, PART_SQL, "tr AS (SELECT id, y FROM sp WHERE part = 'train')", NO_WEIGHTS]
    rows = []
    for s in range(LIVE_STEPS):
        ctes += _hinge_sql(s, "tr")
        ctes += [f"""v{s} AS (SELECT id, y FROM sp WHERE part = 'test' ORDER BY {h(SEED + 1, str(s), 'id')}, id LIMIT {STEP_BATCH})""",
                 *(f"""{kind}m{s} AS (SELECT b.id, b.y, {r9('sum(f.v * coalesce(w.w, 0))')} AS m
                       FROM {kind}{s} b JOIN fo f USING (id) LEFT JOIN w{s + 1} w USING (k) GROUP BY b.id, b.y)""" for kind in "vb")]
        acc = "avg(CASE WHEN y = (CASE WHEN m > 0 THEN 1 ELSE -1 END) THEN 1.0 ELSE 0.0 END)"
        rows.append(f"""SELECT CAST({s} AS INTEGER) AS step,
            (SELECT {r6(f"avg({HINGE_SQL}) + {d(REG_HINGE / 2)} * (SELECT sum(w * w) FROM w{s + 1})")} FROM vm{s}) AS val_objective,
            (SELECT {r6(acc)} FROM bm{s}) AS train_acc, (SELECT {r6(acc)} FROM vm{s}) AS val_acc""")
    return with_(*ctes) + " UNION ALL ".join(rows)


@query("live_step_metrics", _live_sql())
def live_step_metrics(spark, sf_dir):
    ex, feats = T.ex_orders(spark, sf_dir), T.feat_orders(spark, sf_dir)
    parts = materialize(SP.ratio_split(ex, 0.9, seed=SEED, label="part"))
    part = lambda name: parts.filter(F.col("part") == name).select("id", "y")
    rows = LIVE_STEPS * STEP_BATCH
    batches = {"train": write_batches(draw(part("train"), STEP_BATCH, SEED, LIVE_STEPS), feats, rows),
               "val": write_batches(draw(part("test"), STEP_BATCH, SEED + 1, LIVE_STEPS), feats, rows)}
    run = TR.Run(spark, scratch_path(spark, "live-run"))
    TR.train(run, batches["train"], LIVE_STEPS, TR.HingeSq(LR_HINGE, REG_HINGE), digits=MARGIN_DIGITS)
    m = TR.live_metrics(run, LIVE_STEPS, batches, REG_HINGE, digits=MARGIN_DIGITS)
    return m.select("step", *[out(c).alias(c) for c in ("val_objective", "train_acc", "val_acc")])


def _svm_sql(step: int, source: str) -> list[str]:
    """Weights ``w<step + 1>`` from ``w<step>``, every worker with its own sample of ``source``."""
    s = str(step)
    r = f"{d(2 * LAM_SVM)} * m.sw / m.nnz"
    return [
        f"""b{s} AS (SELECT worker, id, y FROM (SELECT k.worker, e.id, e.y, row_number() OVER (PARTITION BY k.worker
              ORDER BY {h(SEED, s, 'k.worker', 'e.id')}, e.id) AS rn
            FROM {source} e, (SELECT CAST(range AS INTEGER) AS worker FROM range({SYNC_WORKERS})) k) WHERE rn <= {SYNC_SUBSET})""",
        f"""r{s} AS (SELECT b.worker, f.id, b.y, f.k, f.v, coalesce(w.w, 0) AS w
            FROM fo f JOIN b{s} b USING (id) LEFT JOIN w{s} w USING (k))""",
        f"""m{s} AS (SELECT worker, id, any_value(y) AS y, {r9('sum(v * w)')} AS m, sum(w) AS sw, sum(w * w) AS sw2, count(*) AS nnz
            FROM r{s} GROUP BY worker, id)""",
        f"""w{step + 1} AS (SELECT k, sum(x) AS w FROM (SELECT k, w AS x FROM w{s} UNION ALL
            SELECT r.k, {d(LR_SVM)} * CASE WHEN r.y * m.m < 1 THEN r.v * r.y - {r} ELSE {r} END
            FROM r{s} r JOIN m{s} m USING (worker, id)) GROUP BY k)"""]


SVM_LOSS_SQL = f"{HINGE_SQL} + {d(LAM_SVM)} * sw2 / nnz"
SIGN_ACC_SQL = "avg(CASE WHEN y = sign(m) THEN 1.0 ELSE 0.0 END)"


def _margins_sql(name: str, rows: str, weights: str) -> str:
    return f"""{name} AS (SELECT e.*, {r9('q.dot')} AS m, q.sw2, q.nnz FROM {rows} e JOIN (
        SELECT f.id, sum(f.v * coalesce(w.w, 0)) AS dot, sum(coalesce(w.w, 0) * coalesce(w.w, 0)) AS sw2, count(*) AS nnz
        FROM fo f LEFT JOIN {weights} w USING (k) GROUP BY f.id) q USING (id))"""


def _stop_sql() -> str:
    ctes = [EX_ORDERS, FEAT_ORDERS, PART_SQL, "tr AS (SELECT id, y FROM sp WHERE part = 'train')",
            "va AS (SELECT id, y FROM sp WHERE part = 'test')", NO_WEIGHTS]
    stats = []
    for s in range(STOP_STEPS):
        ctes += [*_svm_sql(s, "tr"), _margins_sql(f"vm{s}", "va", f"w{s + 1}")]
        stats.append(f"SELECT CAST({s} AS INTEGER) AS step, avg({SVM_LOSS_SQL}) AS loss, {SIGN_ACC_SQL} AS acc FROM vm{s}")
    ctes += ["st AS (" + " UNION ALL ".join(stats) + ")", f"""fl AS (SELECT *,
        min(loss) OVER (ORDER BY step ROWS BETWEEN {STOP_PATIENCE - 1} PRECEDING AND CURRENT ROW) AS recent,
        min(loss) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND {STOP_PATIENCE} PRECEDING) AS best FROM st)"""]
    return with_(*ctes) + f"""SELECT step, {r6('loss')} AS val_loss, {r6('acc')} AS val_acc FROM fl
        WHERE step <= coalesce((SELECT min(step) FROM fl WHERE recent > best), {STOP_STEPS})"""


@query("train_svm_early_stop", _stop_sql())
def train_svm_early_stop(spark, sf_dir):
    ex, feats = T.ex_orders(spark, sf_dir), T.feat_orders(spark, sf_dir)
    parts = materialize(SP.ratio_split(ex, 0.9, seed=SEED, label="part"))
    batches = write_batches(draw(parts.filter("part = 'train'").select("id", "y"), SYNC_SUBSET, SEED, STOP_STEPS, SYNC_WORKERS),
                            feats, STOP_STEPS * SYNC_WORKERS * SYNC_SUBSET)
    val = materialize(pack_with_bias(feats).join(parts.filter("part = 'test'").select("id", "y"), "id"), "val")
    run = TR.Run(spark, scratch_path(spark, "svm-stop"))
    TR.train(run, batches, STOP_STEPS, TR.SvmMean(LR_SVM, LAM_SVM), val, STOP_PATIENCE, MARGIN_DIGITS)
    hist = spark.createDataFrame(run.history(), TR.HISTORY)         # a row a step
    return hist.select("step", out("loss").alias("val_loss"), out("accuracy").alias("val_acc"))


def _job_sql() -> str:
    ctes = [EX_ORDERS, FEAT_ORDERS, SPLIT_SQL, "tg AS (SELECT id, y, split FROM tagged JOIN ex USING (id))",
            "tr AS (SELECT id, y FROM tg WHERE split = 'train')", "va AS (SELECT id, y FROM tg WHERE split = 'val')", NO_WEIGHTS]
    for s in range(JOB_STEPS):
        ctes += [*_svm_sql(s, "tr"), _margins_sql(f"vm{s}", "va", f"w{s + 1}")]
    ctes.append(_margins_sql("fm", "tg", f"w{JOB_STEPS}"))
    cols = []
    for split in TR.SPLITS:
        for name, part in (("_1", 0), ("_-1", 1), ("", 2)):
            cols.append(f"(SELECT {r6(CLASS_ACC_SQL[part])} FROM fm WHERE split = '{split}') AS \"accuracy{name}_{split}\"")
    losses = " UNION ALL ".join(f"SELECT {s} AS s, avg({SVM_LOSS_SQL}) AS x FROM vm{s}" for s in range(JOB_STEPS))
    each = " UNION ALL ".join(f"SELECT avg({SVM_LOSS_SQL}) AS x FROM m{s} GROUP BY worker" for s in range(JOB_STEPS))
    return with_(*ctes) + f"""SELECT CAST(7 AS BIGINT) AS run_id, 'synchronous' AS running_mode, {SYNC_WORKERS} AS n_workers,
        CAST({JOB_STEPS} AS BIGINT) AS sync_epochs, {', '.join(cols)},
        (SELECT {r6(f"max(x) FILTER (WHERE s = {JOB_STEPS - 1})")} FROM ({losses})) AS last_val_loss,
        (SELECT {r6('avg(x)')} FROM ({each})) AS mean_train_loss, {JOB_STEPS * SYNC_WORKERS} AS n_train_losses"""


@query("run_log_job", _job_sql())
def run_log_job(spark, sf_dir):
    """Train, evaluate, log; the record is read back from its file."""
    ex, feats = T.ex_orders(spark, sf_dir), T.feat_orders(spark, sf_dir)
    tagged = materialize(EV.tag_splits(ex, ratio=0.9, seed=SEED, holdout=0.1, holdout_seed=7), "tagged")
    path = scratch_path(spark, "run-log")
    TR.train_evaluate_log(TR.Run(spark, scratch_path(spark, "log-run")), tagged, feats, path, JOB_STEPS, SYNC_WORKERS,
                          SYNC_SUBSET, SEED, LR_SVM, LAM_SVM, run_id=7, digits=MARGIN_DIGITS)
    log = RL.flatten_run_logs(RL.read_run_logs(spark, path, multi_line=False, glob="*.json"))
    mean = F.aggregate("losses_train", F.lit(0.0), lambda a, e: a + e["loss_train"]) / F.size("losses_train")
    return log.select("run_id", "running_mode", "n_workers", "sync_epochs", *[out(F.col(c)).alias(c) for c in RL.ACCURACY_FIELDS],
                      out(F.element_at("losses_val", -1)["loss_val"]).alias("last_val_loss"), out(mean).alias("mean_train_loss"),
                      F.size("losses_train").alias("n_train_losses"))
