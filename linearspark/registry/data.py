"""Queries over sources, parsing, packing and sampling (S, P1-P5, J1, J4, T, U1)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from linearspark.functions import out
from linearspark.operators import features as FT
from linearspark.operators import sampling as SP
from linearspark.registry.base import (EX_ORDERS, FEAT_ORDERS, POINTS, TOPICS, h, query, r6, with_)
from linearspark.session import scratch_path
from linearspark.sources import tables as T
from linearspark.sources import text as TX

# Fixed parameters of the sampling queries.
BATCH = 1500            # mini-batch rows (15 workers x 100)
SEED = 1
N_WORKERS = 4
PER_WORKER = 100
SPLIT_RATIO = 0.9
HOLDOUT = 0.1
HOLDOUT_SEED = 7
DENSE_TASK = 1 << 32    # features x dim of a task that makes dense rows (about a second), ...
DENSE_TASKS = 16        # ... but so many tasks a core suffice to let the cores end together


def _order_lines(spark, sf_dir):
    """Sparse text lines rendered from feat_orders; every 7th line gets a
    trailing blank and every 5th a double blank between features."""
    lines = TX.render_sparse_lines(T.feat_orders(spark, sf_dir))
    line = F.when(F.pmod("id", F.lit(7)) == 0, F.concat("line", F.lit(" "))).otherwise(F.col("line"))
    line = F.when(F.pmod("id", F.lit(5)) == 0, F.regexp_replace(line, " (?=[0-9]+:)", "  ")).otherwise(line)
    return lines.select("id", "body", line.alias("line"))


FO_LONG_SQL = with_(FEAT_ORDERS) + f"SELECT id, k, {r6('v')} AS v FROM fo"


@query("parse_sparse_lines", FO_LONG_SQL)
def parse_sparse_lines(spark, sf_dir):
    parsed = TX.read_sparse_text(spark, TX.write_lines(_order_lines(spark, sf_dir), scratch_path(spark, "sparse-lines")))
    return TX.explode_sparse(parsed).select("id", "k", out("v").alias("v"))


def _label_first_lines(spark, sf_dir):
    lines = _order_lines(spark, sf_dir).join(T.ex_orders(spark, sf_dir), "id")
    return lines.select("id", F.concat(F.col("y").cast("string"), F.lit(" "), F.col("body")).alias("line"))


@query("parse_label_first_lines", with_(EX_ORDERS, FEAT_ORDERS) +
       f"SELECT f.id, CAST(e.y AS VARCHAR) AS label, f.k, {r6('f.v')} AS v FROM fo f JOIN ex e USING (id)")
def parse_label_first_lines(spark, sf_dir):
    parsed = TX.parse_label_first_lines(_label_first_lines(spark, sf_dir), keep=("id",))
    return TX.explode_sparse(parsed, keep=("id", "label")).select("id", "label", "k", out("v").alias("v"))


@query("scan_label_first", with_(EX_ORDERS, FEAT_ORDERS) +
       f"SELECT CAST(e.y AS VARCHAR) AS label, f.k, count(*) AS n_rows, {r6('sum(f.v)')} AS v_sum "
       "FROM fo f JOIN ex e USING (id) GROUP BY e.y, f.k")
def scan_label_first(spark, sf_dir):
    """Label-first text files; their lines carry no id, so the result is a sum for each label and feature."""
    path = TX.write_lines(_label_first_lines(spark, sf_dir), scratch_path(spark, "label-first-lines"))
    long = TX.explode_sparse(TX.read_label_first_text(spark, path), keep=("label",))
    return long.groupBy("label", "k").agg(F.count(F.lit(1)).alias("n_rows"), out(F.sum("v")).alias("v_sum"))


def _point_lines(spark, sf_dir):
    p = T.points(spark, sf_dir)
    # every other line uses commas, as the format allows both
    sep = F.when(F.pmod("id", F.lit(2)) == 0, F.lit(",")).otherwise(F.lit(" "))
    lines = p.select("id", F.concat_ws(" ", F.col("y").cast("string"),
                                       F.array_join(F.transform("x", lambda v: v.cast("string")), " ")).alias("l"), sep.alias("s"))
    return lines.select("id", F.when(F.col("s") == ",", F.regexp_replace("l", " ", ",")).otherwise(F.col("l")).alias("line"))


@query("parse_dense_points", with_(POINTS) +
       "SELECT id, y, CAST(i - 1 AS INTEGER) AS i, x[i] AS x FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM pt)")
def parse_dense_points(spark, sf_dir):
    parsed = TX.parse_dense_points(_point_lines(spark, sf_dir), keep=("id",))
    return parsed.select("id", "y", F.posexplode("x").alias("i", "x")).select("id", "y", "i", "x")


@query("scan_dense_points", with_(POINTS) +
       "SELECT y, CAST(i - 1 AS INTEGER) AS i, count(*) AS n_rows, min(x[i]) AS x_min, max(x[i]) AS x_max "
       "FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM pt) GROUP BY ALL")
def scan_dense_points(spark, sf_dir):
    """Dense text files; their lines carry no id, so the result is the range of each coordinate and label."""
    path = TX.write_lines(_point_lines(spark, sf_dir), scratch_path(spark, "point-lines"))
    x = TX.read_dense_points(spark, path).select("y", F.posexplode("x").alias("i", "x"))
    return x.groupBy("y", "i").agg(F.count(F.lit(1)).alias("n_rows"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))


def _topic_lines(spark, sf_dir):
    t = T.topics(spark, sf_dir)
    return t.select(F.concat_ws(" ", "topic", F.col("doc_id").cast("string"), F.lit("1")).alias("line"))


@query("topics_per_doc", with_(TOPICS) + """
SELECT doc_id, string_agg(topic, ',' ORDER BY topic) AS topics,
       CAST(sum(c) AS BIGINT) AS n_lines
FROM (SELECT doc_id, topic, count(*) AS c FROM tp GROUP BY ALL) GROUP BY doc_id""")
def topics_per_doc(spark, sf_dir):
    from linearspark.operators.topics import topics_per_doc as op
    t = TX.read_topics(spark, TX.write_lines(_topic_lines(spark, sf_dir), scratch_path(spark, "topic-lines")))
    return op(t).select("doc_id", F.array_join("topics", ",").alias("topics"), "n_lines")


@query("topic_label", with_(TOPICS) + """
SELECT d.doc_id AS id,
       CAST(CASE WHEN EXISTS (SELECT 1 FROM tp WHERE tp.doc_id = d.doc_id AND tp.topic = 'purchase')
            THEN 1 ELSE -1 END AS INTEGER) AS y
FROM documents d""")
def topic_label(spark, sf_dir):
    from linearspark.operators.topics import topic_label as op
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return op(docs, T.topics(spark, sf_dir), "purchase", on_missing="negative")


@query("union_parts", with_(FEAT_ORDERS) +
       "SELECT CAST(id % 4 AS INTEGER) AS part, id, count(*) AS n_features, "
       f"{r6('sum(v)')} AS v_sum FROM fo GROUP BY id")
def union_parts(spark, sf_dir):
    lines = _order_lines(spark, sf_dir).withColumn("part", F.pmod("id", F.lit(4)).cast("int"))
    path = TX.write_lines(lines, scratch_path(spark, "sparse-parts"), ["part"])
    parsed = TX.read_sparse_text(spark, [f"{path}/part={p}" for p in range(4)], base_path=path, keep=("part",))
    return parsed.select(
        "part", "id", F.size("idx").cast("long").alias("n_features"),
        out(F.aggregate("val", F.lit(0.0), lambda s, x: s + x)).alias("v_sum"))


@query("pack_features", with_(FEAT_ORDERS) + """
SELECT id, string_agg(CAST(k AS VARCHAR), ' ' ORDER BY k) AS idx_text, count(*) AS nnz,
       """ + r6("sum(v * k)") + " AS kv_sum FROM fo GROUP BY id")
def pack_features(spark, sf_dir):
    p = FT.pack(T.feat_orders(spark, sf_dir))
    return p.select(
        "id",
        F.array_join(F.transform("idx", lambda k: k.cast("string")), " ").alias("idx_text"),
        F.size("idx").cast("long").alias("nnz"),
        out(F.aggregate(F.zip_with("idx", "val", lambda k, v: k * v), F.lit(0.0), lambda s, x: s + x)).alias("kv_sum"),
    )


@query("feature_dim", with_(FEAT_ORDERS) + "SELECT max(k) + 1 AS dim FROM fo")
def feature_dim(spark, sf_dir):
    return FT.feature_dim(T.feat_orders(spark, sf_dir))


@lru_cache(maxsize=1)
def _positions(first: int, n: int) -> np.ndarray:
    return np.arange(first + 1.0, first + n + 1.0)


def _dense_facts(x: np.ndarray, first: int = 0) -> list:
    """Length, sum of value x position, and non-zero values of dense rows, or of their
    columns from ``first`` on."""
    return [np.full(len(x), x.shape[1]), x @ _positions(first, x.shape[1]), [np.count_nonzero(row) for row in x != 0]]


@query("densify", with_(FEAT_ORDERS) + """,
dim AS (SELECT max(k) + 1 AS d FROM fo)
SELECT id, CAST((SELECT d FROM dim) AS INTEGER) AS n, """ + r6("sum(v * (k + 1))") + """ AS pos_sum,
       count(*) FILTER (WHERE v <> 0) AS nnz FROM fo GROUP BY id""")
def densify(spark, sf_dir):
    """The work is rows x dim, however few bytes the packed rows have: where that is much
    for a core, tasks follow it (chosen by bytes, they would be few and uneven)."""
    feats, keys = T.feat_orders(spark, sf_dir), T.feat_orders_keys(spark, sf_dir)
    dim = int(FT.feature_dim(keys).first()["dim"])      # one scalar to the driver
    tasks, cores = keys.count() * dim // DENSE_TASK, spark.sparkContext.defaultParallelism
    if tasks > cores:
        feats = feats.repartition(max(min(tasks, DENSE_TASKS * cores), int(spark.conf.get("spark.sql.shuffle.partitions"))), "id")
    d = FT.densify(FT.pack(feats), dim, measure=_dense_facts, fields="n int, pos_sum double, nnz long", by_columns=True)
    return d.select("id", "n", out("pos_sum").alias("pos_sum"), "nnz")


# ------------------------------------------------------------------ sampling

@query("minibatch_sample", with_(EX_ORDERS) +
       f"SELECT id, y FROM ex ORDER BY {h(SEED, '0', 'id')}, id LIMIT {BATCH}")
def minibatch_sample(spark, sf_dir):
    return SP.sample_exact(T.ex_orders(spark, sf_dir), BATCH, seed=SEED, step=0)


@query("worker_samples", with_(EX_ORDERS) + f"""
SELECT worker, id, y FROM (
  SELECT w.worker, e.id, e.y,
         row_number() OVER (PARTITION BY w.worker ORDER BY {h(SEED, '0', 'w.worker', 'e.id')}, e.id) AS rn
  FROM ex e, (SELECT CAST(range AS INTEGER) AS worker FROM range({N_WORKERS})) w)
WHERE rn <= {PER_WORKER}""")
def worker_samples(spark, sf_dir):
    return SP.group_samples(T.ex_orders(spark, sf_dir), PER_WORKER, seed=SEED, groups=N_WORKERS)


@query("ratio_split", with_(EX_ORDERS) + f"""
SELECT id, y, CASE WHEN row_number() OVER (ORDER BY {h(SEED, 'id')}, id)
                        <= floor(CAST({SPLIT_RATIO} AS DOUBLE) * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
FROM ex""")
def ratio_split(spark, sf_dir):
    return SP.ratio_split(T.ex_orders(spark, sf_dir), SPLIT_RATIO, seed=SEED)


HOLDOUT_SQL = f"""val AS (SELECT id FROM (
    SELECT id, row_number() OVER (ORDER BY {h(HOLDOUT_SEED, 'id')}, id) AS rn, count(*) OVER () AS n FROM ex)
    WHERE rn <= floor(CAST({HOLDOUT} AS DOUBLE) * n))"""


@query("holdout_split", with_(EX_ORDERS, HOLDOUT_SQL) + """
SELECT id, y, 'train' AS split FROM ex WHERE id NOT IN (SELECT id FROM val)
UNION ALL SELECT id, y, 'val' AS split FROM ex WHERE id IN (SELECT id FROM val)""")
def holdout_split(spark, sf_dir):
    ex = T.ex_orders(spark, sf_dir)
    train, val = SP.holdout_split(ex, SP.holdout_ids(ex, HOLDOUT, seed=HOLDOUT_SEED))
    return train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))


@query("holdout_sizes", with_(EX_ORDERS, HOLDOUT_SQL) + """
SELECT (SELECT count(*) FROM ex) AS n_rows,
       (SELECT count(*) FROM ex WHERE id NOT IN (SELECT id FROM val)) AS n_train,
       (SELECT count(*) FROM val) AS n_val""")
def holdout_sizes(spark, sf_dir):
    ex = T.ex_orders(spark, sf_dir)
    train, val = SP.holdout_split(ex, SP.holdout_ids(ex, HOLDOUT, seed=HOLDOUT_SEED))
    tagged = (ex.select(F.lit(1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
              .unionByName(train.select(F.lit(0).alias("a"), F.lit(1).alias("b"), F.lit(0).alias("c")))
              .unionByName(val.select(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("c"))))
    return tagged.agg(F.sum("a").cast("long").alias("n_rows"), F.sum("b").cast("long").alias("n_train"),
                      F.sum("c").cast("long").alias("n_val"))
