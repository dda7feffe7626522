"""Connected components of a large link table, by alternating star contraction.

Every round is two aggregations and joins in Spark; links never reach the
driver, only a count and a checksum that tell when nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.session import materialize


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return r["n"], r["x"]


def _large_star(links: DataFrame) -> DataFrame:
    """Each vertex hands its smallest neighbour to its larger neighbours."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.filter("v > u").join(least, "u")
    return larger.select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each vertex hands its smallest neighbour to itself and its smaller neighbours."""
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = links.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
    own = least.select("hi", F.col("m").alias("lo"))
    return own.unionByName(moved).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links (hi, lo)`` with ``hi > lo`` to ``(vertex, root)`` for every linked
    vertex; the root is the smallest vertex of the component."""
    links = materialize(links.select("hi", "lo").distinct(), "links")
    state = _state(links)
    while state[0]:
        links = materialize(_small_star(_large_star(links)), "links")
        after = _state(links)
        if after == state:
            break
        state = after
    roots = links.select(F.col("lo").alias("vertex")).distinct()
    return links.select(F.col("hi").alias("vertex"), F.col("lo").alias("root")).unionByName(
        roots.select("vertex", F.col("vertex").alias("root")))
