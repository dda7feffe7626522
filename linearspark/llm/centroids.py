"""Centroid clustering of integer vectors over subvector dictionaries.

The vectors are written once, lossless, as chunks: in each chunk a block of
``BLOCK_DIMS`` dimensions keeps its distinct subvectors (its dictionary) and one
code per vector.  In a round, the squared distances of every dictionary entry
to every centroid are computed once, in exact integers; a vector's distance is
the sum of its blocks' entries, found by code.  Cluster sums come from the
codes too: entries times how often a cluster uses them.

Nothing is shuffled in a round but, for each task, one number per cluster and
dimension; the centroids (clusters x dimensions) are all that the driver holds.
A chunk is bounded by ``CHUNK_ROWS`` vectors whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.llm.common import map_partition, parallel, read_table
from linearspark.session import materialize

CLUSTERS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
START_TAG = "1"
BLOCK_DIMS = 2
CHUNK_ROWS = 1 << 14      # codes fit 16 bits
MAX_COMPONENT = 1 << 27   # beyond it a squared distance of 64 components may pass a long

SUMS = "cluster int, dim int, total long"


def kept_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)``: the vectors of ``dims`` components, none of them null or
    non-finite, as integers ``floor(scale * component)``."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall("x", lambda v: F.abs(v) <= MAX_COMPONENT)
    rows = vectors.filter((F.size("embedding") == dims) & whole).select(
        "vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("x"))
    return rows.withColumn("x", F.when(small, F.col("x")).otherwise(
        F.raise_error(F.lit(f"a component beyond {MAX_COMPONENT}: its distance may not fit a long"))))


def start_centroids(kept: DataFrame, clusters: int = CLUSTERS, tag: str = START_TAG) -> np.ndarray:
    """The vectors with the smallest sha256 of ``tag:vec_id`` (null ids last, ties
    by components), in this order; fewer, if there are fewer vectors."""
    key = F.sha2(F.concat(F.lit(f"{tag}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.select(key.alias("key"), "x").orderBy(F.asc_nulls_last("key"), "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def encode(x: np.ndarray, block_dims: int = BLOCK_DIMS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Codes ``[block, row]`` and, for each block, its distinct subvectors."""
    codes, entries = [], []
    for at in range(0, x.shape[1], block_dims):
        own, code = np.unique(x[:, at:at + block_dims], axis=0, return_inverse=True)
        entries.append(own)
        codes.append(code.reshape(-1).astype(np.uint16))
    return np.array(codes), entries


def chunks(kept: DataFrame, dims: int = DIMS, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """``(vec_ids, codes, sizes, entries)``, one row per chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, kind = [], 0, None

        def chunk(table: pa.Table) -> pa.RecordBatch:
            flat = pa.concat_arrays([c.flatten() for c in table.column("x").chunks])
            codes, entries = encode(flat.to_numpy(zero_copy_only=False).reshape(-1, dims), block_dims)
            ids = pa.array([table.column("vec_id").to_pylist()], pa.list_(kind))
            sizes = pa.array([[len(e) for e in entries]], pa.list_(pa.int32()))
            packed = b"".join(e.astype("<i4").tobytes() for e in entries)
            return pa.RecordBatch.from_arrays(
                [ids, pa.array([codes.astype("<u2").tobytes()]), sizes, pa.array([packed])],
                ["vec_ids", "codes", "sizes", "entries"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("vec_id").type
            held.append(batch)
            n += batch.num_rows
            while n >= CHUNK_ROWS:
                whole = pa.Table.from_batches(held)
                yield chunk(whole.slice(0, CHUNK_ROWS))
                held, n = whole.slice(CHUNK_ROWS).to_batches(), n - CHUNK_ROWS
        if n:
            yield chunk(pa.Table.from_batches(held))

    kind = kept.schema["vec_id"].dataType.simpleString()
    return map_partition(kept.select("vec_id", "x"), run,
                         f"vec_ids array<{kind}>, codes binary, sizes array<int>, entries binary")


def _decode(batch: pa.RecordBatch, row: int, dims: int, block_dims: int) -> tuple[np.ndarray, list[np.ndarray]]:
    sizes = batch.column("sizes")[row].as_py()
    codes = np.frombuffer(batch.column("codes")[row].as_py(), "<u2").reshape(len(sizes), -1)
    flat = np.frombuffer(batch.column("entries")[row].as_py(), "<i4").astype(np.int64)
    entries, at = [], 0
    for block, m in enumerate(sizes):
        width = min(block_dims, dims - block * block_dims)
        entries.append(flat[at:at + m * width].reshape(m, width))
        at += m * width
    return codes, entries


def nearest(codes: np.ndarray, entries: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid (ties: the
    smaller number), from the distances of the dictionary entries."""
    total = np.zeros((codes.shape[1], len(centroids)), dtype=np.int64)
    at = 0
    for code, own in zip(codes, entries):
        part = centroids[:, at:at + own.shape[1]]
        total += np.square(own[:, None, :] - part[None, :, :]).sum(axis=2)[code]
        at += own.shape[1]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


def cluster_sums(coded: DataFrame, centroids: np.ndarray, dims: int = DIMS, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """``(cluster, dim, total)`` for every task: component sums; dim -1 has the
    number of vectors."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dims + 1), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                codes, entries = _decode(batch, row, dims, block_dims)
                best, _ = nearest(codes, entries, centroids)
                at = 0
                for code, own in zip(codes, entries):
                    used = np.bincount(best * len(own) + code, minlength=k * len(own)).reshape(k, len(own))
                    sums[:, at:at + own.shape[1]] += used @ own
                    at += own.shape[1]
                sums[:, dims] += np.bincount(best, minlength=k)
        number = np.where(np.arange(dims + 1) == dims, -1, np.arange(dims + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k), dims + 1), pa.int32()), pa.array(np.tile(number, k), pa.int32()),
             pa.array(sums.ravel())], ["cluster", "dim", "total"])

    return map_partition(coded, run, SUMS)


def moved(coded: DataFrame, centroids: np.ndarray, dims: int = DIMS, block_dims: int = BLOCK_DIMS) -> np.ndarray:
    """The centroids after one round; those of empty clusters stay."""
    rows = cluster_sums(coded, centroids, dims, block_dims).groupBy("cluster", "dim").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()     # clusters x (dims + 1) rows
    total = {(r["cluster"], r["dim"]): int(r["total"]) for r in rows}
    new = centroids.copy()
    for c in range(len(centroids)):
        if n := total.get((c, -1), 0):
            new[c] = [total[c, d] // n for d in range(dims)]
    return new


def assigned(coded: DataFrame, centroids: np.ndarray, kind: str, dims: int = DIMS, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                best, distance = nearest(*_decode(batch, row, dims, block_dims), centroids)
                ids = batch.column("vec_ids").slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(best, pa.int32()), pa.array(distance)],
                                                 ["vec_id", "cluster", "distance"])

    return map_partition(coded, run, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
            tag: str = START_TAG, block_dims: int = BLOCK_DIMS) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``,
    one row per kept vector.

    Vectors that are null, have another number of components, or hold a null or
    non-finite one give no row.  Repeated rows are as many vectors; a null
    ``vec_id`` starts a cluster only if there are fewer others than clusters.
    An empty table gives no rows; other columns are ignored.  A component
    beyond ``MAX_COMPONENT`` is an error: its distance might not fit a long.
    """
    kept = kept_vectors(parallel(vectors.select("vec_id", "embedding")), dims, scale)
    kind = kept.schema["vec_id"].dataType.simpleString()
    coded = materialize(chunks(kept, dims, block_dims), "vector-chunks")
    centroids = start_centroids(kept, clusters, tag)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(coded, centroids, dims, block_dims)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, "
                                                 "inertia long, centroid_sha256 string")
    rows = materialize(assigned(coded, centroids, kind, dims, block_dims), "assigned")
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # one a cluster
    inertia = {r["cluster"]: int(r["d"]) for r in per}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = kept.sparkSession.createDataFrame(
        [(c, d, sum(inertia.values()), digest[c]) for c, d in inertia.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark, sf_dir) -> DataFrame:
    """Contract query: 16 clusters, 3 rounds, over all of ``embeddings``."""
    return cluster(read_table(spark, sf_dir, "embeddings"))


def _op12_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    near = """n{r} AS (SELECT rid, arg_min(k, d * 1000 + k) AS k, min(d) AS d FROM (
        SELECT v.rid, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c USING (i) GROUP BY v.rid, c.k) GROUP BY rid)"""
    ctes = [f"""kept AS (SELECT vec_id, row_number() OVER () AS rid, list_transform(embedding, lambda e:
            CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS xs FROM embeddings
        WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda e: isfinite(e))) = {DIMS})""",
            "v AS (SELECT rid, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM kept)",
            f"""c0 AS (SELECT k, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (
            SELECT xs, row_number() OVER (ORDER BY sha256('{START_TAG}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, xs) - 1 AS k
            FROM kept QUALIFY k < {clusters}))""", near.format(r=0)]
    for r in range(1, rounds + 1):
        ctes += [f"""c{r} AS (SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{r - 1} c LEFT JOIN (
            SELECT n.k, v.i, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*)) // count(*) AS x
            FROM n{r - 1} n JOIN v USING (rid) GROUP BY n.k, v.i) m ON m.k = c.k AND m.i = c.i)""", near.format(r=r)]
    last = rounds
    return "WITH " + ",\n".join(ctes) + f"""
SELECT kept.vec_id, CAST(n.k AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance,
       CAST(sum(n.d) OVER (PARTITION BY n.k) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia,
       s.centroid_sha256
FROM n{last} n JOIN kept USING (rid) JOIN (
    SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY k) s USING (k)"""


OP12_SQL = _op12_sql()
