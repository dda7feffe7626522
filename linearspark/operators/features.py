"""Feature-level operators: pack, dimension, densify, margins.

Two physical forms are supported and tested equal:

* *relational* -- long ``(id, k, v)`` joined to ``(k, w)``.  Simple and
  SQL-checkable; it shuffles the non-zeros by ``id`` once.
* *vectorized* -- packed ``(id, idx, val)`` rows scored against a broadcast
  NumPy weight vector inside Arrow batches (see ``plans.vectorized``): no
  shuffle at all for the margin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from linearspark.functions import fixed_weight

# Largest weight table (rows) that is shipped to every executor.  8 bytes key
# + 8 bytes value per row: 4M keys ~ 64 MB before compression.
BROADCAST_MAX_KEYS = 4_000_000


def bounded_broadcast(df: DataFrame, n_rows: int | None) -> DataFrame:
    """Broadcast ``df`` when its row count is known to be below the bound.

    With no known bound, no hint is given: adaptive execution measures the
    materialised side at run time and broadcasts it only if it is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise the join
    stays a sort-merge join on the key."""
    if n_rows is not None and n_rows <= BROADCAST_MAX_KEYS:
        return F.broadcast(df)
    return df


def check_dense(dim: int) -> None:
    """A dense weight vector goes to every executor only below the bound."""
    if dim > BROADCAST_MAX_KEYS:
        raise ValueError(f"weight vector of {dim} keys is above the broadcast bound; use plans.trainer")


def fixed_weights(feats: DataFrame) -> DataFrame:
    """Deterministic test weights over the keys present in ``feats``."""
    return feats.select("k").distinct().select("k", fixed_weight("k").alias("w"))


def pack(feats: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Long (id, k, v) -> (id, idx, val) sorted by key.

    The group is one example's features, bounded by the row width."""
    g = feats.groupBy("id", *keep).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("_kv"))
    return g.select(
        "id", *keep,
        F.transform("_kv", lambda e: e["k"]).alias("idx"),
        F.transform("_kv", lambda e: e["v"]).alias("val"),
    )


def feature_dim(feats: DataFrame) -> DataFrame:
    """max key + 1 (one row, ``dim``); partial max per partition."""
    return feats.agg((F.max("k") + 1).cast("long").alias("dim"))


def feature_dim_packed(packed: DataFrame) -> DataFrame:
    return packed.agg((F.max(F.array_max("idx")) + 1).cast("long").alias("dim"))


DENSE_BLOCK = 1 << 17   # numbers of dense rows that a task works on at once (1 MB, in its core's cache)
DENSE_COLUMNS = 1 << 14  # columns of such a block, where facts of column ranges add up


def _dense_blocks(idx: pa.ListArray, val: pa.ListArray, dim: int, numbers: int,
                  columns: int | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
    """The dense rows of packed ones, about ``numbers`` numbers at a time, as (first row,
    first column, block): whole rows, or ranges of ``columns`` columns, one after the
    other (one buffer a range, written anew for each block).  Keys outside the vector are
    not looked at; a null value is 0; a key that is null or comes twice in a row is refused."""
    sizes = pc.fill_null(pc.list_value_length(idx), 0).to_numpy(zero_copy_only=False)
    if (sizes != pc.fill_null(pc.list_value_length(val), 0).to_numpy(zero_copy_only=False)).any():
        raise ValueError("idx and val of a row differ in length")
    keys = idx.flatten()
    if keys.null_count:
        raise ValueError("null feature key")
    ks, vs = keys.to_numpy(zero_copy_only=False), pc.fill_null(val.flatten(), 0.0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((ks, rows))
    if ((np.diff(rows[order]) == 0) & (np.diff(ks[order]) == 0)).any():
        raise ValueError("feature key comes twice in a row")
    inside = (ks >= 0) & (ks < dim)
    rows, ks, vs = rows[inside], ks[inside], vs[inside]
    width = max(min(columns or dim, dim), 1)
    height = max(min(numbers // width, len(sizes)), 1)
    starts, firsts = range(0, len(sizes), height), range(0, max(dim, 1), width)
    at = ks // width * len(starts) + rows // height      # number of the block
    order = np.argsort(at, kind="stable")
    ends = np.searchsorted(at, np.arange(len(firsts) * len(starts) + 1), sorter=order).tolist()
    rows, ks, vs = (rows % height)[order], (ks % width)[order], vs[order]
    parts = zip(ends, ends[1:])
    for first in firsts:
        block = np.zeros((height, min(width, dim - first)))
        flat = block.reshape(-1)
        for start in starts:
            a, b = next(parts)
            places = rows[a:b] * block.shape[1] + ks[a:b]
            flat[places] = vs[a:b]
            yield start, first, block[:len(sizes) - start]
            flat[places] = 0.0


def densify(packed: DataFrame, dim: int, keep: tuple[str, ...] = ("id",),
            measure: Callable[..., list] | None = None, fields: str = "x array<double>",
            by_columns: bool = False) -> DataFrame:
    """Packed row -> dense ARRAY<DOUBLE> ``x`` of length ``dim`` (small dim only).

    Rows become dense in the task that has them, block by block.  With ``measure``,
    which gives the columns ``fields`` of a block of dense rows, the vectors are used
    up there: rows x dim numbers are made and read, but neither kept nor sent on.
    ``by_columns`` is for numbers that add up over ranges of columns: ``measure`` gets
    each range with its first column, so a block stays in the cache at any ``dim``."""
    plain = packed.select(*keep, F.col("idx").cast("array<long>").alias("_idx"), F.col("val").cast("array<double>").alias("_val"))
    kept, made = packed.select(*keep).schema, StructType.fromDDL(fields)
    schema = StructType([*kept.fields, *made.fields])
    types = to_arrow_schema(made).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, idx, val = batch.select(kept.names), batch.column("_idx"), batch.column("_val")
            if measure is None:
                for start, _, x in _dense_blocks(idx, val, dim, 8 * DENSE_BLOCK):
                    rows = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * dim, x.flatten())
                    yield pa.RecordBatch.from_arrays([*own.slice(start, len(x)).columns, rows], schema.names)
            elif len(batch):
                if by_columns:
                    sums = [np.zeros(len(batch), t.to_pandas_dtype()) for t in types]
                    for start, first, x in _dense_blocks(idx, val, dim, DENSE_BLOCK, DENSE_COLUMNS):
                        for s, fact in zip(sums, measure(x, first)):
                            s[start:start + len(x)] += fact
                else:
                    sums = map(np.concatenate, zip(*[measure(x) for _, _, x in _dense_blocks(idx, val, dim, DENSE_BLOCK)]))
                found = [pa.array(c, t) for c, t in zip(sums, types)]
                yield pa.RecordBatch.from_arrays([*own.columns, *found], schema.names)

    return plain.mapInArrow(run, schema)


BIAS_KEY = 0
BIAS_SALTS = 1024       # join keys that the bias, a feature of every example, is dealt over


def with_weights(rows: DataFrame, weights: DataFrame, n_weights: int | None = None, id_col: str = "id") -> DataFrame:
    """``rows (id, k, ...)`` with their weight ``w`` (absent: 0).

    The weight table is broadcast when its size is known to be bounded; otherwise
    the join is left to the planner (sort-merge on the key).  The bias key, which
    every example has, is dealt over ``BIAS_SALTS`` join keys, so no task gets
    them all."""
    bias = F.col("k") == BIAS_KEY
    salt = -1 - F.pmod(F.xxhash64(id_col), F.lit(BIAS_SALTS))
    salted = F.when(bias, F.sequence(F.lit(-BIAS_SALTS).cast("long"), F.lit(-1).cast("long"))).otherwise(
        F.array(F.col("k").cast("long")))
    w = weights.select("w", F.explode(salted).alias("_at"))
    w = bounded_broadcast(w, None if n_weights is None else n_weights + BIAS_SALTS)
    return rows.withColumn("_at", F.when(bias, salt).otherwise(F.col("k").cast("long"))).join(w, "_at", "left").withColumn(
        "w", F.coalesce("w", F.lit(0.0))).drop("_at")


def margins(feats: DataFrame, weights: DataFrame, n_weights: int | None = None) -> DataFrame:
    """Relational sparse dot product: (id, m) = sum(v * w_k), absent w = 0."""
    return with_weights(feats, weights, n_weights).groupBy("id").agg(F.sum(F.col("v") * F.col("w")).alias("m"))


def labelled_margins(ex: DataFrame, feats: DataFrame, weights: DataFrame, n_weights: int | None = None) -> DataFrame:
    """(id, y, m): examples joined to their margin (an example without
    features has margin 0)."""
    m = margins(feats, weights, n_weights)
    return ex.join(m, "id", "left").select("id", "y", F.coalesce("m", F.lit(0.0)).alias("m"))


def dense_dot(x_col: str, w: list[float]):
    """Dense dot product of an ARRAY<DOUBLE> column with a constant vector."""
    wv = F.array(*[F.lit(float(v)) for v in w])
    return F.aggregate(F.zip_with(F.col(x_col), wv, lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)


def fixed_dense_weights(dim: int) -> list[float]:
    """Dense test weights, same rule as ``fixed_weight``: ((i*37)%11-5)/10."""
    return [float((i * 37) % 11 - 5) / 10.0 for i in range(dim)]
