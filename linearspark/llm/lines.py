"""Line dedup: drop lines whose normalised form is in many documents.

Only (document, position, line hash) rows are exploded and shuffled; the text
itself moves once, to meet the dropped positions of its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.llm.common import ASCII_SPACE, ascii_lower, text_hash, text_or_empty
from linearspark.session import materialize

MIN_CHARS = 1
MIN_DOCS = 10


def _lines():
    return F.split(text_or_empty(), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, th, pos, h1, h2)``: one row per line whose key has at least
    ``min_chars`` code points.  Two 64-bit hashes of different seeds stand for
    the key."""
    lines = docs.select("doc_id", text_hash().alias("th"), F.posexplode(_lines()).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", F.btrim("line", F.lit(ASCII_SPACE)).alias("line")).filter(
        F.char_length("line") >= min_chars).select("doc_id", "th", "pos", ascii_lower(F.col("line")).alias("key"))
    return keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def drop_common_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay, and two more
    columns ``_n_lines`` and ``_n_dropped``; every row and every other column
    stays as it was, whatever its name (a column of ``docs`` by one of these two
    names is replaced).

    A null or empty text is one empty line and becomes the empty text.  A key is
    a line stripped of ASCII white space with A-Z lower-cased; keys shorter than
    ``min_chars`` never go.  Documents are counted by distinct id (all null ids
    are one document), so repeated rows of one id count once.
    """
    hashes = materialize(line_hashes(docs, min_chars), "lines")
    # written, so that the join below deals out both sides itself and can split a hot line
    common = materialize(hashes.groupBy("h1", "h2").agg(F.count_distinct(F.struct("doc_id")).alias("n")).filter(
        F.col("n") >= min_docs).select("h1", "h2"), "common")
    hits = hashes.join(common, ["h1", "h2"], "left_semi").groupBy(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_hits"))
    # both sides are one struct or named by it, so no column of docs can clash with a helper
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                       docs["doc_id"].alias("id"), text_hash().alias("th"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    joined = rows.join(hits.hint("shuffle_hash"), same, "left").select("row", "_hits", F.split(text, "\n", -1).alias("all")).withColumn(
        "keep", F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.coalesce("_hits", F.array().cast("array<int>"))))
    kept = F.array_join(F.transform("keep", lambda i: F.get("all", i)), "\n")
    own = [F.when(F.col("_hits").isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c)
           for c in docs.columns if c not in ("_n_lines", "_n_dropped")]
    return joined.select(*own, F.size("all").cast("long").alias("_n_lines"),
                         (F.size("all") - F.size("keep")).cast("long").alias("_n_dropped"))


def op6_line_dedup(spark, sf_dir) -> DataFrame:
    """Contract query: doc_id, n_lines, n_dropped, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_common_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"))


_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT doc_id, pos, line, {_KEY} AS key FROM lines),
common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id
"""
