from pyspark.sql import functions as F

from linearspark.sources import text as TX


def _parse(spark, lines):
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    return {r["id"]: dict(zip(r["idx"], r["val"])) for r in TX.parse_sparse_lines(df).collect()}


def test_sparse_edge_cases(spark):
    got = _parse(spark, ["7  ", "8  3:0.5 ", "9  3:0.5 3:0.7", "10  0:2.0", "11  4:1.5  2:0.25", "12 5:1"])
    assert got[7] == {0: 1.0}                      # no features: bias only
    assert got[8] == {0: 1.0, 3: 0.5}              # trailing blank ignored
    assert got[9] == {0: 1.0, 3: 0.7}              # repeated key: last wins
    assert got[10] == {0: 2.0}                     # explicit 0 overrides the bias
    assert got[11] == {0: 1.0, 2: 0.25, 4: 1.5}    # double blank, sorted keys
    assert got[12] == {0: 1.0, 5: 1.0}             # single blank keeps the feature


def test_label_first_and_topics(spark):
    df = spark.createDataFrame([("-1 2:0.5 2:0.75 9:1",), ("1",)], "line string")
    rows = TX.parse_label_first_lines(df).collect()
    assert [(r["label"], list(r["idx"]), list(r["val"])) for r in rows] == [
        ("-1", [0, 2, 9], [1.0, 0.75, 1.0]), ("1", [0], [1.0])]
    t = TX.parse_topic_lines(spark.createDataFrame([("CCAT 2286 1",), ("E11 2286 1 ",)], "line string")).collect()
    assert [(r["topic"], r["doc_id"], r["rel"]) for r in t] == [("CCAT", 2286, 1), ("E11", 2286, 1)]


def test_dense_points_blanks_and_commas(spark):
    df = spark.createDataFrame([("1 0.1 0.2",), ("-1,0.5,0.25",)], "line string")
    rows = TX.parse_dense_points(df).collect()
    import numpy as np
    assert rows[0]["y"] == 1.0 and rows[1]["y"] == -1.0
    assert rows[0]["x"] == [float(np.float32(0.1)), float(np.float32(0.2))]   # float32 parse
    assert rows[1]["x"] == [0.5, 0.25]


def test_render_roundtrip(spark):
    feats = spark.createDataFrame([(1, 0, 1.0), (1, 3, 0.02), (1, 5, 1.5), (2, 0, 1.0)], "id long, k long, v double")
    lines = TX.render_sparse_lines(feats)
    back = TX.explode_sparse(TX.parse_sparse_lines(lines.select("line")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, feats.collect()))


def test_read_text_files(spark, tmp_path):
    p0, p1 = tmp_path / "a.dat", tmp_path / "b.dat"
    p0.write_text("1  2:0.5\n2  3:1\n")
    p1.write_text("3  4:2 \n")
    df = TX.read_sparse_text(spark, [str(p0), str(p1)])
    assert sorted(r["id"] for r in df.collect()) == [1, 2, 3]
    tp = tmp_path / "t.qrels"
    tp.write_text("CCAT 1 1\nGCAT 2 1\n")
    assert TX.read_topics(spark, str(tp)).count() == 2
    assert F is not None


def test_blank_lines_skipped(spark):
    df = spark.createDataFrame([("",), ("   ",), ("5  1:2",)], "line string")
    assert [r["id"] for r in TX.parse_sparse_lines(df).collect()] == [5]
    assert TX.parse_label_first_lines(df).count() == 1
    assert TX.parse_dense_points(spark.createDataFrame([("",), ("1 2",)], "line string")).count() == 1
    assert TX.parse_topic_lines(spark.createDataFrame([("",), ("A 1 1",)], "line string")).count() == 1
