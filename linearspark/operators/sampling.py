"""Exact, repeatable sampling and splitting.

Every row gets a hash key ``md5(seed:step[:group]:id)``; "the first n rows" of
a sample or split are the rows with the n smallest ``(hash, id)``.  This is a
seeded stand-in for the reference's ``random.sample`` / ``random.shuffle`` and
gives the same sizes (exact n, ``int(ratio*n)``) without a global sort:

* small n, no groups: a top-k (``orderBy(...).limit(n)`` is planned as
  TakeOrderedAndProject, each task keeps at most n rows);
* many groups (steps, workers): one scan for all, candidates by a hash
  threshold, rank within a group;
* otherwise the *histogram cutoff*: count rows per 16-bit hash prefix
  (a partial aggregate, at most 65,536 rows per group), find the bucket where
  the running count crosses n, and rank rows only inside that one bucket.
  Every task holds a bounded share of the data; no row goes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linearspark.functions import hash_prefix, hash_text
from linearspark.session import materialize

TOPK_MAX = 100_000   # largest n drawn with a top-k
HASH_BITS = 16       # histogram buckets = 2**HASH_BITS per group


class SampleTooLarge(ValueError):
    pass


def with_hash(df: DataFrame, seed: int, step: int | str | None = None, group: str | None = None,
              id_col: str = "id", name: str = "_h") -> DataFrame:
    parts: list = [seed]
    if step is not None:
        parts.append(step if isinstance(step, int) else F.col(step))
    if group is not None:
        parts.append(F.col(group))
    parts.append(F.col(id_col))
    return df.withColumn(name, hash_text(*parts))


def flag_first_n(df: DataFrame, n: int | Column, h: str = "_h", id_col: str = "id",
                 groups: Sequence[str] = (), flag: str = "_in", bits: int = HASH_BITS) -> DataFrame:
    """Add boolean ``flag``: row is among the first ``n`` by (h, id) in its group.

    ``n`` may be an int or a Column over ``_tot`` (rows in the group), e.g.
    ``floor(0.9 * _tot)``.  All rows are kept."""
    g = list(groups)
    x = df.withColumn("_b", hash_prefix(F.col(h), bits))
    hist = x.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_c"))
    base = Window.partitionBy(*g) if g else Window
    wcum = base.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wall = base.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hist = hist.withColumn("_cum", F.sum("_c").over(wcum)).withColumn("_tot", F.sum("_c").over(wall))
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    hist = hist.withColumn("_n", n_col).withColumn("_before", F.col("_cum") - F.col("_c"))
    boundary = (F.col("_before") < F.col("_n")) & (F.col("_n") <= F.col("_cum"))
    cut = hist.groupBy(*g).agg(
        F.max(F.when(boundary, F.col("_b"))).alias("_bs"),
        F.max(F.when(boundary, F.col("_n") - F.col("_before"))).alias("_need"),
        F.max("_n").alias("_n"),
        F.max("_tot").alias("_tot"),
    )
    if g:
        # one row per group; the groups are parameters (steps, workers)
        x = x.join(F.broadcast(cut), g, "inner")
    else:
        # one scalar subquery (a single row) bound once as a struct column
        row = cut.select(F.struct("_bs", "_need", "_n", "_tot").alias("s"))
        x = x.select("*", row.scalar().alias("_cut")).select(
            *x.columns, "_cut._bs", "_cut._need", "_cut._n", "_cut._tot")
    plain = x.filter(F.col("_bs").isNull() | (F.col("_b") != F.col("_bs"))).withColumn(
        flag, F.when(F.col("_bs").isNull(), F.col("_n") >= F.col("_tot")).otherwise(F.col("_b") < F.col("_bs")))
    wr = Window.partitionBy(*g, "_b").orderBy(h, id_col)
    border = x.filter(F.col("_b") == F.col("_bs")).withColumn(flag, F.row_number().over(wr) <= F.col("_need"))
    cols = [c for c in df.columns] + [flag]
    return plain.select(*cols).unionByName(border.select(*cols))


def balanced_bits(n_rows: int | None) -> int:
    """Histogram resolution for a known row count: 2**bits buckets per group
    and ~n_rows / 2**bits rows in the boundary bucket are both ~sqrt(n_rows)
    (at least 16 bits, at most 30)."""
    if not n_rows:
        return HASH_BITS
    return max(HASH_BITS, min(30, math.ceil(math.log2(max(n_rows, 2)) / 2)))


def prefilter_threshold(n: int, n_rows: int) -> int | None:
    """32-bit hash threshold keeping about n + 8*sqrt(n) + 64 of ``n_rows``
    rows (None when that is all of them).  The n smallest hashes are all
    below it unless fewer than n rows survive -- an 8-sigma event, which the
    callers detect and answer with the exact histogram cutoff."""
    q = (n + 8.0 * math.sqrt(n) + 64.0) / max(n_rows, 1)
    return None if q >= 1.0 else int(q * 2 ** 32)


def candidates(h: DataFrame, n: int, n_rows: int, hcol: str = "_h") -> DataFrame:
    thr = prefilter_threshold(n, n_rows)
    return h if thr is None else h.filter(hash_prefix(F.col(hcol), 32) < F.lit(thr))


def top_n(h: DataFrame, n: int, n_rows: int | None, id_col: str = "id") -> DataFrame:
    """First n rows by (_h, id).  With a known row count the rows are first
    pre-filtered by hash, so the single merging task of the top-k sees about
    n + 8*sqrt(n) rows instead of n per input partition."""
    c = candidates(h, n, n_rows) if n_rows is not None else h
    return c.orderBy("_h", id_col).limit(n)


def sample_exact(df: DataFrame, n: int, seed: int, step: int = 0, id_col: str = "id",
                 strict: bool = True, n_rows: int | None = None) -> DataFrame:
    """Exactly ``n`` rows without replacement, repeatable for (seed, step).

    ``strict`` raises SampleTooLarge when the table has fewer than n rows.  The
    pre-filtered candidate set is counted (a small job); in the rare case that
    it is short, the histogram cutoff is used."""
    if strict or n_rows is None:
        n_rows = n_rows if n_rows is not None else df.count()
        if strict and n > n_rows:
            raise SampleTooLarge(f"sample of {n} asked from {n_rows} rows")
    h = with_hash(df, seed, step, id_col=id_col)
    if n <= TOPK_MAX:
        if prefilter_threshold(n, n_rows) is not None:
            cand = materialize(candidates(h, n, n_rows), "candidates")     # one pass, ~n rows
            if cand.count() >= n:
                return cand.orderBy("_h", id_col).limit(n).drop("_h")
        else:
            return top_n(h, n, n_rows, id_col).drop("_h")
    return flag_first_n(h, n, id_col=id_col, bits=balanced_bits(n_rows)).filter("_in").drop("_h", "_in")


def _slot_hash(seed: int, step0: int, slot: Column, workers: int | None, id_col: str) -> Column:
    """Hash of slot ``step * workers + worker`` (or ``step``) for the row's id."""
    if workers is None:
        return hash_text(seed, slot + F.lit(step0), id_col)
    return hash_text(seed, F.floor(slot / workers).cast("long") + F.lit(step0), F.pmod(slot, F.lit(workers)), id_col)


def slot_samples(df: DataFrame, n: int, seed: int, steps: int, workers: int | None = None, step0: int = 0,
                 id_col: str = "id", n_rows: int | None = None) -> DataFrame:
    """``(step, worker, df columns)``: an exact sample of ``n`` rows for every step
    from ``step0`` on (and every worker; 0 if there are none), drawn in one scan.

    A row's hashes of all slots are computed together and only those below a
    threshold that keeps about n + 8 sqrt(n) rows a slot become rows; rank cuts
    the rest.  A slot short of candidates (an 8-sigma event) makes the scan run
    again with a larger threshold; the last one keeps every row."""
    n_rows = df.count() if n_rows is None else n_rows
    if n > n_rows:
        raise SampleTooLarge(f"sample of {n} asked from {n_rows} rows")
    slots, w = steps * (workers or 1), workers or 1
    limit = prefilter_threshold(n, n_rows)
    while True:
        each = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda s: F.struct(
            s.alias("slot"), _slot_hash(seed, step0, s, workers, id_col).alias("h")))
        if limit is not None:
            each = F.filter(each, lambda e: hash_prefix(e["h"], 32) < F.lit(limit))
        found = materialize(df.select("*", F.explode(each).alias("_e")), "drawn")
        enough = found.groupBy("_e.slot").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= n).count()
        if enough == slots or limit is None:
            break
        limit = None if limit >= 2 ** 30 else 4 * limit
    rank = F.row_number().over(Window.partitionBy("_e.slot").orderBy("_e.h", id_col))
    return found.withColumn("_r", rank).filter(F.col("_r") <= n).select(
        (F.floor(F.col("_e.slot") / w) + F.lit(step0)).cast("int").alias("step"),
        F.pmod("_e.slot", F.lit(w)).cast("int").alias("worker"), *df.columns)


def group_samples(df: DataFrame, n: int, seed: int, groups: int, group_col: str = "worker",
                  step: int | None = 0, id_col: str = "id", n_rows: int | None = None) -> DataFrame:
    """An independent exact sample of ``n`` rows for each of ``groups`` groups
    (workers of a step, or steps without workers); overlap between groups is
    allowed.  One scan (``slot_samples``)."""
    if step is None:
        found, own, other = slot_samples(df, n, seed, groups, None, 0, id_col, n_rows), "step", "worker"
    else:
        found, own, other = slot_samples(df, n, seed, 1, groups, step, id_col, n_rows), "worker", "step"
    return found.drop(other).select(*df.columns, F.col(own).alias(group_col))


def step_samples(df: DataFrame, n: int, seed: int, steps: int, id_col: str = "id",
                 n_rows: int | None = None) -> DataFrame:
    """Mini-batches for steps 0..steps-1 in one plan: (step, ...)."""
    return group_samples(df, n, seed, steps, group_col="step", step=None, id_col=id_col, n_rows=n_rows)


def ratio_split(df: DataFrame, ratio: float, seed: int = 1, id_col: str = "id",
                label: str = "split", names=("train", "test")) -> DataFrame:
    """First ``floor(ratio * rows)`` rows in hash order -> names[0], rest names[1]."""
    h = with_hash(df, seed, None, id_col=id_col)
    n = F.floor(F.lit(float(ratio)) * F.col("_tot"))
    f = flag_first_n(h, n, id_col=id_col)
    return f.withColumn(label, F.when(F.col("_in"), names[0]).otherwise(names[1])).drop("_h", "_in")


def holdout_ids(df: DataFrame, fraction: float = 0.1, seed: int = 7, id_col: str = "id") -> DataFrame:
    """Ids of an exact holdout of ``int(fraction * rows)`` rows."""
    h = with_hash(df.select(id_col), seed, None, id_col=id_col)
    n = F.floor(F.lit(float(fraction)) * F.col("_tot"))
    return flag_first_n(h, n, id_col=id_col).filter("_in").select(id_col)


def holdout_split(df: DataFrame, val_ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(train, val): anti / semi join against the holdout ids."""
    train = df.join(val_ids, id_col, "left_anti")
    val = df.join(val_ids, id_col, "left_semi")
    return train, val


def duplicate_ids(df: DataFrame, id_col: str = "id") -> int:
    """Number of ids carried by more than one row.  Sampling and packing treat
    ``id`` as a key; run this once per dataset (a partial aggregate, then a
    count) before trusting exact sample sizes."""
    return df.groupBy(id_col).count().filter(F.col("count") > 1).count()
