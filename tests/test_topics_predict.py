import math

import pytest
from pyspark.sql import functions as F

from linearspark.functions import hinge, is_support, out, predict_sign, predict_threshold
from linearspark.operators import features as FT
from linearspark.operators import gradients
from linearspark.operators import losses as L
from linearspark.operators.topics import topic_label, topics_per_doc
from linearspark.sources import tables


def test_topic_label_missing_and_duplicates(spark):
    topics = spark.createDataFrame([("CCAT", 1), ("CCAT", 1), ("E11", 2)], "topic string, doc_id long")
    ex = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    neg = {r["id"]: r["y"] for r in topic_label(ex, topics, "CCAT", on_missing="negative").collect()}
    assert neg == {1: 1, 2: -1, 3: -1}                      # same topic twice: one row
    with pytest.raises(Exception):
        topic_label(ex, topics, "CCAT", on_missing="error").collect()
    ok = topic_label(ex.filter("id < 3"), topics, "CCAT").collect()
    assert len(ok) == 2
    per = {r["doc_id"]: (list(r["topics"]), r["n_lines"]) for r in topics_per_doc(topics).collect()}
    assert per == {1: (["CCAT"], 2), 2: (["E11"], 1)}


def test_predictions_and_hinge(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (-1, float("nan")), (-1, -2.0)], "y int, m double")
    r = df.select(predict_sign("m").alias("s"), predict_threshold("m").alias("t"),
                  is_support("y", "m").alias("sup"), hinge("y", "m").alias("h")).collect()
    assert (r[0]["s"], r[0]["t"]) == (0, -1)             # zero margin
    assert r[1]["sup"] is False and r[1]["h"] == 0.0     # margin exactly 1: not support
    assert math.isinf(r[2]["h"])                         # NaN margin -> +inf
    assert r[3]["h"] == 0.0


def test_unseen_feature_and_empty_class(spark):
    feats = spark.createDataFrame([(1, 0, 1.0), (1, 99, 5.0)], "id long, k long, v double")
    w = spark.createDataFrame([(0, 0.5)], "k long, w double")
    ex = spark.createDataFrame([(1, -1)], "id long, y int")
    m = FT.labelled_margins(ex, feats, w).collect()[0]["m"]
    assert m == 0.5                                      # unseen key contributes 0
    acc = L.class_accuracy(spark.createDataFrame([(-1, -0.3)], "y int, m double")).collect()[0]
    assert acc["acc_pos"] is None and acc["acc_neg"] == 1.0 and acc["acc_tot"] == 1.0
    assert F is not None


def test_time_functions_ignore_session_zone(spark):
    from linearspark.functions import ts_text
    from linearspark.functions.columns import micros_between
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.1' AS t, TIMESTAMP_NTZ'2024-03-10 01:30:00' AS s")
            r = df.select(ts_text("t").alias("f"), micros_between("s", "t").alias("d")).first()
            assert (r.f, r.d) == ("2024-03-10 02:30:00.100000", 3_600_100_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_ts_text_whole_seconds(spark):
    from linearspark.functions import ts_text
    r = spark.sql("SELECT TIMESTAMP_NTZ'1995-01-02 00:00:00' AS t").select(ts_text("t").alias("f")).first()
    assert r.f == "1995-01-02 00:00:00.000000"


def test_margins_are_compared_raw_unless_digits_are_asked_for(spark):
    points = spark.createDataFrame([(1, 1.0, [4e-10, 0.0]), (2, 1.0, [1e11, 1.0])], "id long, y double, x array<double>")
    raw = {r["id"]: r["m"] for r in gradients.dense_rows(points, [1.0, 0.0]).collect()}
    assert raw == {1: 4e-10, 2: 1e11}
    near = gradients.dense_rows(points, [1.0, 0.0], digits=9).select("id", predict_threshold("m").alias("p")).collect()
    assert {r["id"]: r["p"] for r in near} == {1: -1, 2: 1}


def test_reported_doubles_do_not_saturate(spark):
    row = spark.createDataFrame([(1e13, -1e300)], "a double, b double").select(out("a").alias("a"), out("b").alias("b")).first()
    assert (row["a"], row["b"]) == (1e13, -1e300)


def test_points_keep_every_coordinate(spark, tmp_path):
    spark.createDataFrame([(1, [float(i) for i in range(64)], 3), (2, [1.0], 7)],
                          "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    points = tables.points(spark, str(tmp_path))
    assert {r["id"]: len(r["x"]) for r in points.collect()} == {1: 64, 2: 1}
    assert tables.point_dim(points) == 64
