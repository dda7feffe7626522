"""Session helpers: a local session for tests and a shared scratch location.

Scratch data (written tables, streaming checkpoints) always lives under the
folder the cluster names in ``spark.checkpoint.dir``.  Only when that setting
is missing (local tests) do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session used by tests, the bench and the local checker.  Python workers find
    this package wherever the program was started (a cluster installs it)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("linearspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a private one only if unset."""
    path = spark.conf.get(_CKPT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_CKPT_KEY} to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="linearspark-ckpt-")
        spark.conf.set(_CKPT_KEY, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "cut"):
    """Cut lineage: write ``df`` as a parquet table into the shared checkpoint
    folder and read it back.  One pass (``Dataset.checkpoint`` on an
    unpersisted plan computes it twice), columnar, and it survives executor
    loss -- unlike a local checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
