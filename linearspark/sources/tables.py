"""Example tables derived from the driver's parquet tables.

The reference trains on sparse text (RCV1).  The driver ships relational
tables instead, so every dataset the operators need is *derived* from them
with plain DataFrame operations (nothing is materialised):

=============  ==============================================================
ex_orders      (id, y)          y = +1 if o_orderstatus = 'F' else -1
feat_orders    (id, k, v)       per order and supplier k = l_suppkey + 1,
                                v = sum(l_quantity) / 50, plus bias (id, 0, 1.0)
ex_docs        (id, y)          labels.quality -> +1 / -1
feat_docs      (id, k, v)       tokens of documents.text, k = 1 + leading
                                48 bits of the md5, v = count / tokens in
                                the document, plus bias
topics         (topic, doc_id)  events: event_type, event_id div 4
points         (id, y, x)       embeddings: the whole vector, y = +1 if label < 5
loss_events    (worker_idx, event_id, loss, ts)   events: user_id % 4, value
deltas         (worker, k, d)   lineitem: l_linenumber, l_suppkey + 1,
                                l_discount - l_tax
runs           run log rows     orders grouped by o_custkey
=============  ==============================================================
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed parameters of the derived datasets.
TOKEN_HEX = 12              # hex digits of a token's md5 in its key: 48 bits
TOKEN_SPLIT = "[ \t\n\r]+"  # token separator of documents.text
N_LOSS_WORKERS = 4          # loss_events.worker_idx = user_id % 4


def few_splits(scan: DataFrame) -> bool:
    """True when a *plain file scan* has fewer input splits than the cluster
    has cores (e.g. a single-row-group file).  Only call this on a scan: the
    split count then comes from file metadata and no job runs."""
    return scan.rdd.getNumPartitions() < scan.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame, needed: bool) -> DataFrame:
    """Round-robin ``df`` over the cores before CPU-heavy per-row work when
    its source scan had too few splits; a no-op on large inputs."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if needed else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ex_orders(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).cast("int").alias("y"),
    )


def feat_orders(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    lines = li.groupBy(
        F.col("l_orderkey").alias("id"), (F.col("l_suppkey") + 1).alias("k")
    ).agg((F.sum("l_quantity") / 50.0).alias("v"))
    bias = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.lit(0).cast("long").alias("k"), F.lit(1.0).alias("v")
    )
    return lines.unionByName(bias)


def feat_orders_keys(spark, sf_dir) -> DataFrame:
    """Every key of ``feat_orders``, a row (k) for each line and each bias: not grouped, so
    nothing is shuffled where repeats do not matter."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + 1).alias("k"))
    return li.unionByName(table(spark, sf_dir, "orders").select(F.lit(0).cast("long").alias("k")))


def ex_docs(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("quality") == 1, 1).otherwise(-1).cast("int").alias("y"),
    )


def feat_docs(spark, sf_dir, ids: DataFrame | None = None) -> DataFrame:
    """Bag of hashed tokens over the whole text of every document (or of the
    documents in ``ids`` -- a semi join before tokenising)."""
    scan = table(spark, sf_dir, "documents")
    docs = scan.select("doc_id", "text")
    if ids is not None:
        docs = docs.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    # tokenising is CPU-heavy: spread a few-split file over the cores (filters
    # and the semi join are pushed below this exchange by the optimizer)
    docs = spread(docs, few_splits(scan))
    toks = docs.select(
        F.col("doc_id").alias("id"),
        F.filter(F.split("text", TOKEN_SPLIT), lambda t: t != "").alias("toks"),
    ).select("id", F.size("toks").alias("n"), F.explode("toks").alias("tok"))
    k = F.conv(F.substring(F.md5("tok"), 1, TOKEN_HEX), 16, 10).cast("long") + 1
    counts = toks.groupBy("id", k.alias("k"), "n").agg(F.count(F.lit(1)).alias("c"))
    feats = counts.select("id", "k", (F.col("c") / F.col("n")).alias("v"))
    bias = docs.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("k"), F.lit(1.0).alias("v"))
    return feats.unionByName(bias)


def topics(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("topic"),
        F.floor(F.col("event_id") / 4).cast("long").alias("doc_id"),
    )


def points(spark, sf_dir) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("y"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def point_dim(points: DataFrame) -> int:
    """Coordinates of the longest point (one row reaches the driver)."""
    return points.agg(F.max(F.size("x"))).first()[0] or 0


def loss_events(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.pmod(F.col("user_id"), F.lit(N_LOSS_WORKERS)).cast("int").alias("worker_idx"),
        "event_id",
        F.col("value").alias("loss"),
        "ts",
    )


def deltas(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_linenumber").alias("worker"),
        (F.col("l_suppkey") + 1).alias("k"),
        (F.col("l_discount") - F.col("l_tax")).alias("d"),
    )


def runs(spark, sf_dir) -> DataFrame:
    """One run-log row per customer (flattened D13 fields)."""
    o = table(spark, sf_dir, "orders")
    hi = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    g = o.groupBy("o_custkey").agg(
        F.sum(hi).alias("n_hi"),
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("o_orderstatus") != "P").cast("int")).alias("n_ok"),
        F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("n_f"),
        F.min("o_orderdate").alias("start_time"),
        F.max("o_orderdate").alias("end_time"),
    )
    return g.select(
        F.col("o_custkey").alias("run_id"),
        F.when(F.col("n_hi") * 2 >= F.col("n"), "synchronous").otherwise("asynchronous").alias("running_mode"),
        (F.pmod(F.col("o_custkey"), F.lit(15)) + 1).cast("int").alias("n_workers"),
        (F.col("n_ok") / F.col("n")).alias("accuracy_test"),
        (F.col("n_f") / F.col("n")).alias("accuracy_train"),
        "start_time",
        "end_time",
    )
