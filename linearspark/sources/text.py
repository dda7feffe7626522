"""Text formats of the reference, read and written with DataFrame expressions.

* sparse lines      ``id<blank><blank>k:v k:v ...``      -> (id, idx, val)
* label-first lines ``label k:v k:v ...``                -> (label, idx, val)
* dense points      ``label x1 x2 ...`` (blanks/commas)  -> (y, x)
* topic lines       ``topic doc_id rel``                 -> (topic, doc_id, rel)

Parsing rules (decided once for all readers):
  - the line is trimmed and split on blanks; empty tokens are dropped, so a
    trailing blank or a double blank never loses a feature;
  - the bias ``0 -> 1.0`` is always present;
  - a repeated key keeps its *last* value; an explicit ``0:`` overrides the bias;
  - blank lines are skipped.

The de-duplication is done inside the row with array functions (sort by key,
keep the first of each run), so parsing is a narrow transformation: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), " "), lambda t: t != "")


def _sparse_entries(tokens: Column, first: int) -> Column:
    """Features of ``tokens[first:]`` as a key-sorted, last-wins, biased array
    of struct(k LONG, v DOUBLE)."""
    feats = F.slice(tokens, first + 1, F.greatest(F.size(tokens) - first, F.lit(0)))
    entries = F.transform(
        feats,
        lambda t, i: F.struct(
            F.split(t, ":").getItem(0).cast("long").alias("k"),
            (-i).alias("np"),
            F.split(t, ":").getItem(1).cast("double").alias("v"),
        ),
    )
    bias = F.array(F.struct(F.lit(0).cast("long").alias("k"), F.lit(1).alias("np"), F.lit(1.0).alias("v")))
    # sorted by key, and within a key latest token first (bias last)
    return F.array_sort(F.concat(bias, entries))


def _dedup(sorted_col: str) -> Column:
    s = F.col(sorted_col)
    kept = F.filter(s, lambda e, i: (i == 0) | (F.element_at(s, i)["k"] != e["k"]))
    return kept


def parse_sparse_lines(df: DataFrame, line_col: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """``id  k:v ...`` -> (keep..., id LONG, idx ARRAY<LONG>, val ARRAY<DOUBLE>)."""
    toks = df.select(*keep, _tokens(F.col(line_col)).alias("_t")).filter(F.size("_t") > 0)   # blank lines skipped
    s = toks.select(*keep, F.col("_t").getItem(0).cast("long").alias("id"), _sparse_entries(F.col("_t"), 1).alias("_s"))
    return s.select(*keep, "id", _dedup("_s").alias("_d")).select(
        *keep,
        "id",
        F.transform("_d", lambda e: e["k"]).alias("idx"),
        F.transform("_d", lambda e: e["v"]).alias("val"),
    )


def parse_label_first_lines(df: DataFrame, line_col: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """``label k:v ...`` -> (keep..., label STRING, idx, val)."""
    toks = df.select(*keep, _tokens(F.col(line_col)).alias("_t")).filter(F.size("_t") > 0)
    s = toks.select(*keep, F.col("_t").getItem(0).alias("label"), _sparse_entries(F.col("_t"), 1).alias("_s"))
    return s.select(*keep, "label", _dedup("_s").alias("_d")).select(
        *keep,
        "label",
        F.transform("_d", lambda e: e["k"]).alias("idx"),
        F.transform("_d", lambda e: e["v"]).alias("val"),
    )


def parse_dense_points(df: DataFrame, line_col: str = "line", keep: Sequence[str] = ()) -> DataFrame:
    """``label x1 ... xD`` with blanks or commas -> (keep..., y DOUBLE, x ARRAY<DOUBLE>).

    Numbers are parsed as 32-bit floats and widened, like the reference."""
    parts = F.filter(F.split(F.trim(F.col(line_col)), "[, ]+"), lambda t: t != "")
    p = df.select(*keep, parts.alias("_p")).filter(F.size("_p") > 0)
    return p.select(
        *keep,
        F.col("_p").getItem(0).cast("float").cast("double").alias("y"),
        F.transform(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda t: t.cast("float").cast("double")).alias("x"),
    )


def parse_topic_lines(df: DataFrame, line_col: str = "line") -> DataFrame:
    """``topic doc_id rel`` -> (topic STRING, doc_id LONG, rel INT)."""
    t = df.select(_tokens(F.col(line_col)).alias("_t")).filter(F.size("_t") > 0)
    return t.select(
        F.col("_t").getItem(0).alias("topic"),
        F.col("_t").getItem(1).cast("long").alias("doc_id"),
        F.col("_t").getItem(2).cast("int").alias("rel"),
    )


def explode_sparse(df: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Packed (idx, val) -> long form (keep..., k, v)."""
    z = df.select(*keep, F.explode(F.arrays_zip(F.col("idx").alias("k"), F.col("val").alias("v"))).alias("_e"))
    return z.select(*keep, F.col("_e.k").alias("k"), F.col("_e.v").alias("v"))


# ---------------------------------------------------------------- readers

def _lines(spark: SparkSession, paths: str | Sequence[str], base_path: str | None = None) -> DataFrame:
    r = spark.read if base_path is None else spark.read.option("basePath", base_path)
    return r.text(paths if isinstance(paths, str) else list(paths)).withColumnRenamed("value", "line")


def read_sparse_text(spark: SparkSession, paths: str | Sequence[str], base_path: str | None = None,
                     keep: Sequence[str] = ()) -> DataFrame:
    """One or many sparse text files (the train file and test parts) in one scan.
    With ``base_path``, partition columns of the folders can be kept."""
    return parse_sparse_lines(_lines(spark, paths, base_path), keep=keep)


def read_label_first_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_label_first_lines(_lines(spark, paths))


def read_dense_points(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_dense_points(_lines(spark, paths))


def read_topics(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return parse_topic_lines(_lines(spark, paths))


# ---------------------------------------------------------------- writers

def render_sparse_lines(feats: DataFrame, id_col: str = "id") -> DataFrame:
    """Long (id, k, v) -> (id, body, line): ``id  k:v ...`` sorted by key with
    a bias of 1.0 omitted (the parser adds it).  ``body`` alone is the feature part, used for the
    label-first form ``label body``."""
    grouped = feats.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.when((F.col("k") != 0) | (F.col("v") != 1.0), F.struct("k", "v")))).alias("_kv")
    )
    body = F.array_join(
        F.transform("_kv", lambda e: F.concat(e["k"].cast("string"), F.lit(":"), e["v"].cast("string"))), " "
    )
    return grouped.select(id_col, body.alias("body")).select(
        id_col, "body", F.concat(F.col(id_col).cast("string"), F.lit("  "), F.col("body")).alias("line")
    )


def write_lines(lines: DataFrame, path: str, partition: Sequence[str] = ()) -> str:
    """Text files of the column ``line``, in a folder for each value of ``partition``."""
    lines.select("line", *partition).write.mode("overwrite").partitionBy(*partition).text(path)
    return path
