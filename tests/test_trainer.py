"""Drawn batches and the trainer over them, against plain Python."""

import hashlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from linearspark.functions.stopping import has_risen
from linearspark.operators import sampling as SP
from linearspark.operators.sampling import SampleTooLarge
from linearspark.plans import batches as B
from linearspark.plans import trainer as TR
from linearspark.session import scratch_path
from linearspark.sources import tables as T


def _md5(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("workers", [None, 3])
@pytest.mark.parametrize("n", [1, 40, 300])
def test_draw_is_the_n_smallest_hashes(spark, n, workers):
    ex = spark.range(300).select("id", F.lit(1).alias("y"))
    got = {}
    for r in B.draw(ex, n, 9, 4, workers).collect():
        got.setdefault((r["step"], r["worker"]), set()).add(r["id"])
    for step in range(4):
        for w in range(workers or 1):
            key = (9, step) if workers is None else (9, step, w)
            want = sorted(range(300), key=lambda i: (_md5(*key, i), i))[:n]
            assert got[step, w] == set(want)


def test_draw_widens_a_short_threshold(spark, monkeypatch):
    ex = spark.range(200).select("id", F.lit(1).alias("y"))
    monkeypatch.setattr(SP, "prefilter_threshold", lambda n, rows: 1 << 20)      # keeps next to nothing
    want = sorted(range(200), key=lambda i: (_md5(1, 0, i), i))[:50]
    assert {r["id"] for r in B.draw(ex, 50, 1, 1).collect()} == set(want)
    with pytest.raises(SampleTooLarge):
        B.draw(ex, 201, 1, 1)


def _plain_train(examples, batches, rule, start=None):
    """Weights after every batch ``[(id, y)]`` over ``examples {id: {k: v}}``."""
    w, out = dict(start or {}), []
    for batch in batches:
        change = {}
        for i, y in batch:
            x = examples[i]
            m = sum(v * w.get(k, 0.0) for k, v in x.items())
            r = 2 * rule.lam * sum(w.get(k, 0.0) for k in x) / len(x) if isinstance(rule, TR.SvmMean) else 0.0
            for k, v in x.items():
                if isinstance(rule, TR.SvmMean):
                    d = rule.lr * (v * y - r if y * m < 1 else r)
                else:
                    d = rule.lr * (v * y if y * m < 1 else 0.0) - rule.reg * w.get(k, 0.0) ** 2
                change[k] = change.get(k, 0.0) + d
        for k, d in change.items():
            w[k] = w.get(k, 0.0) + d
        out.append(dict(w))
    return out


def _objective(examples, labels, w, reg):
    h = [max(0.0, 1 - y * sum(v * w.get(k, 0.0) for k, v in examples[i].items())) for i, y in labels.items()]
    return sum(h) / len(h) + reg / 2 * sum(x * x for x in w.values())


@pytest.fixture(scope="module")
def documents(spark):
    """Labelled documents with 48-bit token keys: far beyond any dense vector."""
    ex = T.ex_docs(spark, SF_SMALL)
    feats = T.feat_docs(spark, SF_SMALL, ex)
    ex = ex.join(feats.select("id").distinct(), "id", "left_semi")
    examples = {}
    for r in feats.collect():
        examples.setdefault(r["id"], {})[r["k"]] = r["v"]
    return ex, feats, examples, {r["id"]: r["y"] for r in ex.collect()}


@pytest.mark.parametrize("rule", [TR.HingeSq(0.2, 0.01), TR.SvmMean(0.2, 0.05)])
def test_sparse_documents_train_like_plain_python(spark, documents, rule):
    ex, feats, examples, labels = documents
    assert max(k for x in examples.values() for k in x) > 1 << 40
    workers = 2 if isinstance(rule, TR.SvmMean) else None
    drawn = B.draw(ex, 15, 3, TR.SNAPSHOT_STEPS + 2, workers)
    rows = drawn.collect()
    steps = [[(r["id"], r["y"]) for r in rows if r["step"] == s] for s in range(TR.SNAPSHOT_STEPS + 2)]
    run = TR.Run(spark, scratch_path(spark, "run"))
    assert TR.train(run, B.write_batches(drawn, feats), len(steps), rule) == len(steps)
    want = _plain_train(examples, steps, rule)
    for s in (1, TR.SNAPSHOT_STEPS, len(steps)):
        got = {r["k"]: r["w"] for r in run.weights(s).collect()}
        assert got.keys() == want[s - 1].keys()
        assert max(abs(got[k] - want[s - 1][k]) for k in got) < 1e-9
    versions = {r["k"]: r["ws"] for r in TR.version_table(run.deltas(), len(steps)).collect()}
    assert all(abs(ws[s] - want[s].get(k, 0.0)) < 1e-9 for k, ws in versions.items() for s in range(len(steps)))


def test_stop_rule_fires_and_a_restart_goes_on(spark, documents):
    ex, feats, examples, labels = documents
    rule, steps, p = TR.HingeSq(8.0, 0.001), 9, 2           # a step size that overshoots
    drawn = B.draw(ex, 10, 4, steps)
    rows = drawn.collect()
    path = B.write_batches(drawn, feats)
    val = B.pack_with_bias(feats).join(ex, "id")
    weights = _plain_train(examples, [[(r["id"], r["y"]) for r in rows if r["step"] == s] for s in range(steps)], rule)
    losses = [_objective(examples, labels, w, rule.reg) for w in weights]
    want = next((s + 1 for s in range(steps) if has_risen(losses[:s + 1], p)), steps)
    assert want < steps, "choose a step size whose stop fires"
    whole = TR.Run(spark, scratch_path(spark, "run"))
    assert TR.train(whole, path, steps, rule, val, p) == want
    assert [h[1] for h in whole.history()] == pytest.approx(losses[:want])
    parts = TR.Run(spark, scratch_path(spark, "run"))
    TR.train(parts, path, steps, rule, val, p, stop_after=lambda s: s == 0)
    # a step that was cut off after its deltas, before its history row
    spark.createDataFrame([(5, 99.0)], "k long, d double").write.parquet(f"{parts.root}/deltas/step=1")
    again = TR.Run(spark, parts.root)
    assert TR.train(again, path, steps, rule, val, p) == want
    assert [h[1] for h in again.history()] == pytest.approx(losses[:want])


def test_steps_read_no_base_table(spark):
    base = scratch_path(spark, "base")
    T.ex_orders(spark, SF_SMALL).write.parquet(f"{base}/ex")
    T.feat_orders(spark, SF_SMALL).write.parquet(f"{base}/feats")
    ex, feats = spark.read.parquet(f"{base}/ex"), spark.read.parquet(f"{base}/feats")
    path = B.write_batches(B.draw(ex, 30, 1, 3), feats, 90)
    shutil.rmtree(base.replace("file:", ""))
    run = TR.Run(spark, scratch_path(spark, "run"))
    assert TR.train(run, path, 3, TR.HingeSq(0.1, 0.0)) == 3 and run.weights(3).count() > 0


def test_weights_to_start_from(spark):
    ex = spark.createDataFrame([(1, 1), (2, -1)], "id long, y int")
    feats = spark.createDataFrame([(1, 0, 1.0), (1, 5, 2.0), (2, 0, 1.0)], "id long, k long, v double")
    start = spark.createDataFrame([(0, 0.5), (5, 0.1), (9, 3.0)], "k long, w double")
    rule = TR.SvmMean(0.1, 0.2)
    run = TR.Run(spark, scratch_path(spark, "run"), start)
    TR.train(run, B.write_batches(B.draw(ex, 2, 1, 1), feats), 1, rule)
    want = _plain_train({1: {0: 1.0, 5: 2.0}, 2: {0: 1.0}}, [[(1, 1), (2, -1)]], rule, {0: 0.5, 5: 0.1, 9: 3.0})[0]
    assert {r["k"]: r["w"] for r in run.weights(1).collect()} == pytest.approx(want)


def test_run_record_has_nine_accuracies(spark, tmp_path):
    from linearspark.sources.runlog import ACCURACY_FIELDS, read_run_logs
    ids = list(range(60))
    dice = random.Random(2)
    tagged = spark.createDataFrame([(i, 1 if i % 2 else -1, ("train", "train", "train", "val", "test")[i % 5]) for i in ids],
                                   "id long, y int, split string")
    feats = spark.createDataFrame([(i, 0, 1.0) for i in ids] + [(i, 1 + i % 2, 1.0 + dice.random()) for i in ids],
                                  "id long, k long, v double")
    run = TR.Run(spark, scratch_path(spark, "run"))
    TR.train_evaluate_log(run, tagged, feats, str(tmp_path / "log"), 4, 2, 10, 1, 0.05, 1e-4)
    log = read_run_logs(spark, str(tmp_path / "log"), multi_line=False, glob="*.json").collect()
    assert len(log) == 1 and log[0]["sync_epochs"] == 4 and log[0]["n_workers"] == "2"
    assert all(log[0][a] == 1.0 for a in ACCURACY_FIELDS)          # the classes are apart: all learned
    assert len(log[0]["losses_val"]) == 4 and len(log[0]["losses_train"]) == 8
    assert log[0]["losses_train"][0]["loss_train"] == pytest.approx(1.0)        # zero weights
    assert log[0]["start_time"] < log[0]["losses_val"][0]["time"] < log[0]["end_time"]
