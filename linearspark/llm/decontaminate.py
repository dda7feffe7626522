"""Benchmark decontamination with a distributed positional inverted index.

The phrases are windows of consecutive words of the benchmark items.  The
index holds postings ``(term, doc_id, th, pos)`` of the corpus for the rarest
terms of each phrase (its seeds), and with each posting the test terms around
it, which are the offset-adjusted postings that any phrase through it can need.
A lookup joins phrases and index on the seeds and intersects the other terms
at their adjusted offsets: all equal is an exact phrase match, nearly all of
them in one span is a proximity match.

A proximity match needs ``need`` of the ``d`` distinct words of a phrase, so it
has one of any ``d - need + 1`` of them (pigeonhole): with that many of the
rarest as seeds none is missed, also if the rarest words are changed or absent.

Term numbers come from the benchmark only.  They are broadcast in blocks of at
most ``BLOCK_WORDS`` benchmark words; a larger benchmark takes more passes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linearspark.llm.common import map_batches, map_partition, parallel, read_table, strings, text_hash, utf8
from linearspark.session import materialize

WINDOW = 13
RATIO = 20            # contaminated: RATIO * n_hit >= n_words
NEAR_WORDS = 10       # distinct words of a phrase that a proximity match needs in one span of 2 * WINDOW - 1 words
BLOCK_WORDS = 1_000_000

# Bytes that part words: ASCII other than letters and digits.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def item_words(items: DataFrame) -> DataFrame:
    """``(item_id string, item, ws)``: the words of every item that has any, and
    their digest, which is one for all items of the same words."""
    src = items.select(F.col("item_id").cast("string").alias("item_id"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ws = pa.array([[w.decode() for w in words(text)] for text in utf8(batch, "text")], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([batch.column("item_id"), ws], ["item_id", "ws"])

    found = map_batches(src, run, "item_id string, ws array<string>").filter(F.size("ws") > 0)
    return found.select("item_id", F.md5(F.array_join("ws", " ").cast("binary")).alias("item"), "ws")


def phrases(worded: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(phrase_id, phrase array<string>, item)``: the distinct windows of ``window``
    words of each distinct item (one of fewer words is one window)."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1)))
    windows = worded.select("item", "ws").distinct().select(
        "item", F.explode(F.transform(starts, lambda i: F.slice("ws", i, window))).alias("phrase"))
    return windows.select(F.md5(F.array_join("phrase", " ").cast("binary")).alias("phrase_id"), "phrase", "item").distinct()


def term_counts(docs: DataFrame, terms) -> DataFrame:
    """``(term, n)``: occurrences in the whole corpus of the broadcast terms."""

    def run(batches):
        number, total = terms.value, np.zeros(len(terms.value), dtype=np.int64)
        for batch in batches:
            for text in utf8(batch, "text"):
                got = Counter(map(number.get, words(text)))
                got.pop(None, None)
                total[np.fromiter(got.keys(), np.int64, len(got))] += np.fromiter(got.values(), np.int64, len(got))
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    return map_partition(docs.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def build_index(docs: DataFrame, terms, seeds, span: int) -> DataFrame:
    """Postings ``(term, doc_id, th, pos, around)`` of the seed terms in ``docs
    (doc_id, th, text)``; ``around`` has the numbers of the test terms less than
    ``span`` words away (-1: another word, or none).  ``seeds`` has for each term
    the fewest test words that a match through it has (0: no seed); occurrences
    in no span of so many are left out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        number, least = terms.value, seeds.value
        rows, term, pos, around = [], [], [], []
        for row, text in enumerate(utf8(batch, "text")):
            ids = np.array([number.get(w, -1) for w in words(text)], dtype=np.int32)
            at = np.nonzero(least[ids])[0]       # the last entry of least is for -1
            if len(at):
                padded = np.pad(ids, span - 1, constant_values=-1)
                before = np.concatenate([[0], np.cumsum(padded >= 0)])
                held = before[span:] - before[:-span]              # test words of the span from each place
                at = at[held[at[:, None] + np.arange(span)].max(axis=1) >= least[ids[at]]]
            if len(at):
                rows.append(np.full(len(at), row))
                term.append(ids[at])
                pos.append(at)
                around.append(padded[at[:, None] + np.arange(2 * span - 1)])
        if not rows:
            return None
        rows, flat = pa.array(np.concatenate(rows)), np.concatenate(around)
        offsets = np.arange(len(flat) + 1, dtype=np.int32) * (2 * span - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(term)), batch.column("doc_id").take(rows), batch.column("th").take(rows),
             pa.array(np.concatenate(pos).astype(np.int32)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))],
            ["term", "doc_id", "th", "pos", "around"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "th", "text"), run,
                       f"term int, doc_id {kind}, th long, pos int, around array<int>")


def _lookup(index: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """Join the seeds of phrases ``(term, off, rarest, need, ids, phrase_id)`` and
    postings and intersect the other terms at their adjusted offsets; an exact
    match is found through the rarest seed."""
    joined = index.join(wanted, "term")
    exact = F.col("rarest") & (F.slice("around", span - F.col("off"), F.size("ids")) == F.col("ids"))
    shared = lambda terms: F.size(F.array_intersect(terms, "ids")) >= F.col("need")
    spans = F.sequence(F.lit(1), F.lit(span))
    near = shared(F.col("around")) & F.exists(spans, lambda i: shared(F.slice("around", i, span)))
    return joined.filter(exact | near).select(
        "doc_id", "th", (F.col("pos") - F.col("off")).alias("start"),
        (F.col("pos") - F.col("off") + F.size("ids")).alias("end"), "phrase_id", exact.alias("exact"))


def search(docs: DataFrame, known: DataFrame, window: int = WINDOW, near_words: int = NEAR_WORDS,
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """Matches ``(doc_id, th, start, end, phrase_id, exact)`` of the ``phrases``
    ``known`` in ``docs``, in words from the start of the text; ``exact`` is
    false for a proximity match (at least ``near_words`` of the phrase's distinct
    words, or all if it has fewer, in ``2 * window - 1`` consecutive words; it
    has a row for each seed found).  ``th`` is the hash of the text."""
    spark, span = docs.sparkSession, 2 * window - 1
    corpus = parallel(docs).select("doc_id", text_hash().alias("th"), "text")
    every = materialize(known.select("phrase_id", "phrase").distinct(), "distinct-phrases")
    n_words = every.agg(F.sum(F.size("phrase")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-n_words // block_words))
    parts = []
    for block in range(blocks):
        own = every.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block)
        vocabulary = [r["w"] for r in own.select(F.explode("phrase").alias("w")).distinct().collect()]  # <= block_words
        terms = spark.sparkContext.broadcast({w.encode(): i for i, w in enumerate(sorted(vocabulary))})
        numbered = spark.createDataFrame(sorted((w, i) for i, w in enumerate(sorted(vocabulary))), "w string, term int")
        counts = term_counts(corpus, terms)
        weight = numbered.join(counts, "term", "left").select("w", "term", F.coalesce("n", F.lit(0)).alias("n"))
        placed = own.select("phrase_id", F.posexplode("phrase").alias("off", "w")).join(weight, "w")
        ranked = placed.groupBy("phrase_id", "n", "term").agg(F.min("off").alias("off")).groupBy("phrase_id").agg(
            F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("rank"))
        whole = placed.groupBy("phrase_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("off", "term"))), lambda x: x["term"]).alias("ids"))
        need = F.least(F.lit(near_words), F.size("rank"))
        wanted = materialize(
            ranked.join(whole, "phrase_id")
            .select("ids", "phrase_id", need.alias("need"), F.posexplode(F.slice("rank", 1, F.size("rank") - need + 1)).alias("place", "seed"))
            .filter("seed.n > 0").select(F.col("seed.term").alias("term"), F.col("seed.off").alias("off"),
                                         (F.col("place") == 0).alias("rarest"), "need", "ids", "phrase_id"), "wanted")
        least = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        for r in wanted.groupBy("term").agg(F.min("need").alias("need")).collect():             # <= block_words
            least[r["term"]] = r["need"]
        index = materialize(build_index(corpus, terms, spark.sparkContext.broadcast(least), span), "index")
        parts.append(_lookup(index, wanted, span))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hit_counts(matches: DataFrame) -> DataFrame:
    """``(doc_id, th, n_hit)`` from exact matches: words covered by any match
    (merged intervals)."""
    exact = matches.filter("exact").select("doc_id", "th", "start", "end")
    before = F.max("end").over(Window.partitionBy("doc_id", "th").orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, -1))
    spans = exact.groupBy("doc_id", "th", "start").agg(F.max("end").alias("end")).withColumn("covered", before)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("covered", F.lit(0))))
    return spans.groupBy("doc_id", "th").agg(F.sum(fresh).alias("n_hit"))


def matched_items(matches: DataFrame, known: DataFrame, worded: DataFrame) -> DataFrame:
    """``(doc_id, th, items, near_items)``: the distinct items of a document's
    exact matches and of its proximity matches, sorted as strings.  Phrases lead to
    distinct items first, and those to the ids of all items of the same words."""
    found = matches.groupBy("doc_id", "th", "phrase_id").agg(F.max("exact").alias("exact"))
    distinct = found.join(known.select("phrase_id", "item"), "phrase_id").groupBy("doc_id", "th", "item").agg(
        F.max("exact").alias("exact"))
    ids = distinct.join(worded.select("item", "item_id").distinct(), "item").groupBy("doc_id", "th", "item_id").agg(
        F.max("exact").alias("exact"))
    return ids.groupBy("doc_id", "th").agg(
        F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item_id")))).alias("items"),
        F.sort_array(F.collect_list(F.when(~F.col("exact"), F.col("item_id")))).alias("near_items"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, n_words)`` for every row (a null text has no words)."""
    src = parallel(docs).select("doc_id", text_hash().alias("th"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array([len(words(t)) for t in utf8(batch, "text")], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), n], ["doc_id", "th", "n_words"])

    return map_batches(src, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, n_words long")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, ratio: int = RATIO) -> DataFrame:
    """One row per row of ``docs``: doc_id, th, n_words, n_hit, items, near_items
    (of proximity matches only, without ``items``), contaminated (``n_hit > 0 and
    ratio * n_hit >= n_words``).

    Null and empty texts and items have no words and no match.  Rows that repeat
    an id and a text each get the row of that text.  Equal windows of several
    items count for each of them.  Empty tables give empty or unmatched results;
    other columns are ignored.
    """
    worded = materialize(item_words(items), "item-words")
    known = materialize(phrases(worded, window), "phrases")
    matches = materialize(search(docs, known, window), "matches")
    hits = hit_counts(matches).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "n_hit")
    named = matched_items(matches, known, worded).select(
        F.col("doc_id").alias("_nid"), F.col("th").alias("_nth"), "items", "near_items")
    counts = word_counts(docs)
    joined = counts.join(hits, counts["doc_id"].eqNullSafe(F.col("_id")) & (counts["th"] == F.col("_th")), "left").join(
        named, counts["doc_id"].eqNullSafe(F.col("_nid")) & (counts["th"] == F.col("_nth")), "left")
    none = F.array().cast("array<string>")
    found = joined.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                          F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * ratio >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, ratio: int = RATIO) -> DataFrame:
    """``docs`` without the contaminated rows, all columns as they were."""
    bad = contamination(docs, items, window, ratio).filter("contaminated").select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (text_hash() == bad["_th"]), "left_anti")


def op9_decontaminate(spark, sf_dir) -> DataFrame:
    """Contract query: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                          read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_proximity(spark, sf_dir) -> DataFrame:
    """doc_id, n_words, n_near_items, near_items_sha256: the items that only
    proximity matches find (the contract of ``op9_decontaminate`` has no column for them)."""
    found = contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                          read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("near_items").cast("long").alias("n_near_items"),
                        F.sha2(F.array_join("near_items", ","), 256).alias("near_items_sha256"))


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
OP9_SQL = f"""
WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT item_id, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS phrase, least(len(ws), {WINDOW}) AS m
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sizes AS (SELECT DISTINCT m FROM windows),
spots AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, sizes WHERE len(ws) >= m)),
hits AS (SELECT s.doc_id, s.i, s.m, w.item_id FROM spots s JOIN windows w ON s.phrase = w.phrase AND s.m = w.m),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND {RATIO} * coalesce(c.n_hit, 0) >= len(d.ws) AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
