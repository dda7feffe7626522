"""Helpers shared by the operators of this subpackage.

Row identity: an operator that must find a row of ``documents`` again uses
``(doc_id, text hash)``, so repeated and null ids are handled like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linearspark.sources.tables import few_splits, spread

# Code units of ASCII white space, and the ASCII letters (fixed by the contracts).
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows per Arrow batch handed to Python: bounds a worker's memory for long texts.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallel(df: DataFrame) -> DataFrame:
    """Deal a table of very few splits over all cores before heavy row work."""
    return spread(df, few_splits(df))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``fn`` over the Arrow batches of ``df`` (no shuffle, no state between batches)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def map_partition(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``fn`` over the batches of each partition (it may keep bounded state)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; a null is the empty text."""
    return [b"" if v is None else v for v in batch.column(name).cast(pa.binary()).to_pylist()]


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return ["" if v is None else v for v in batch.column(name).to_pylist()]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_hash(name: str = "text") -> Column:
    return F.xxhash64(text_or_empty(name))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII strings take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def id_remainder(divisor: int, name: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``divisor`` (a null id: 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(name).cast("string")), F.lit(divisor)), F.lit(0)).cast("int")
