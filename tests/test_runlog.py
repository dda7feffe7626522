import json

from pyspark.sql import functions as F

from linearspark.operators import runs as RN
from linearspark.sources import runlog as RL


def _write(path, rec):
    path.write_text(json.dumps([rec]))       # the reference's format: an array of one object


def test_reference_format_logs(spark, tmp_path):
    a = {"start_time": "2019-05-14 18:25:09.486384", "end_time": "2019-05-14 18:48:18.294529",
         "running_time": 1388.8081450462341, "n_workers": 2, "accuracy_test": 0.9285, "accuracy_train": 0.9496}
    b = {"start_time": "2019-05-15 10:00:00.000000", "end_time": "2019-05-15 10:01:00.500000",
         "running_time": 60.5, "n_workers": "4", "running_mode": "asynchronous", "sync_epochs": 10,
         "accuracy_test": 0.80, "losses_val": [{"time": "2019-05-15 10:00:30.000000", "loss_val": 0.5}]}
    _write(tmp_path / "log.json", a)
    (tmp_path / "sub").mkdir()
    _write(tmp_path / "sub" / "run_log.json", b)
    (tmp_path / "notes.json").write_text("[]")
    logs = RL.flatten_run_logs(RL.read_run_logs(spark, str(tmp_path)))
    rows = {r["n_workers"]: r for r in logs.collect()}
    assert set(rows) == {2, 4}                                  # notes.json skipped by the glob
    assert rows[2]["running_mode"] is None and rows[4]["sync_epochs"] == 10
    assert rows[4]["losses_val"][0]["loss_val"] == 0.5
    secs = logs.select(F.timestamp_diff("MICROSECOND", "start_ts", "end_ts").alias("us")).collect()
    assert sorted(r.us for r in secs) == [60_500_000, 1_388_808_145]
    good = RN.above_threshold(logs).collect()
    assert [r["n_workers"] for r in good] == [2]
    both = RL.read_run_logs_inferred(spark, [str(tmp_path / "log.json"), str(tmp_path / "sub" / "run_log.json")])
    assert set(both.columns) >= {"running_mode", "sync_epochs", "losses_val", "accuracy_train"}
    assert both.count() == 2
