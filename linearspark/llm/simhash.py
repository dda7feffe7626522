"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits.  If two
fingerprints differ in at most two bits, at least one segment is equal in both
(pigeonhole) and any other segment differs in at most two bits.  Padded to 23
bits, such a segment is a word for the perfect binary Golay code: the words at
distance one or less from it decode to one or six codeword indices, and two
words that differ in at most two bits share an index, because a word between
them is at distance one or less from both.  The keys of a fingerprint are
therefore (segment number, its bits, an index of the next segment).

Fingerprints that share a key with another one are joined and verified through
the words between them: each is at distance one or less from at most 65
fingerprints, so no key, however common, gives all pairs of its members.  All
fingerprints around such a word differ pairwise in at most two bits, and each
is linked to the smallest.  These links have the components of all true links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linearspark.llm.common import map_batches, map_partition, parallel, text_hash, utf8
from linearspark.llm.components import connected_components
from linearspark.session import materialize

SHINGLE_WORDS = 3
MAX_BITS = 2          # what three segments and the radius of the code guarantee
HASH_SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))   # (shift, bits)
GENERATOR = 0b101011100011                 # generator polynomial of the (23, 12) Golay code
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text: ASCII-lower-cased words at ASCII white space,
    shingles with repeats; a bit is set if set in over half the hashes."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(shingle_words, len(words))
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b - 1], HASH_SEED) for a, b in zip(starts, ends[k - 1:])], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), _CHUNK):
        part = hashes[i:i + _CHUNK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, th, fp)`` for every row; a null or empty text has fingerprint 0."""
    src = docs.select("doc_id", text_hash().alias("th"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle_words) for t in utf8(batch, "text")], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(fps.view(np.int64))],
                                          ["doc_id", "th", "fp"])

    return map_batches(parallel(src), run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, th long, fp long")


@cache
def golay_index() -> np.ndarray:
    """For each 22-bit word (as a 23-bit one): the 12-bit index of the codeword
    within distance three, which is unique because the code is perfect."""
    message = np.arange(1 << 12, dtype=np.int64)
    rest = message << 11
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    codewords = message << 11 | rest
    table = np.empty(1 << 23, dtype=np.uint16)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            table[codewords ^ sum(1 << b for b in bits)] = message
    return table[:1 << SEGMENTS[0][1]].copy()


def _segment(fps: np.ndarray, which: int) -> np.ndarray:
    shift, bits = SEGMENTS[which]
    return (fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _flips(bits: int) -> np.ndarray:
    return np.array([0, *(1 << b for b in range(bits))], dtype=np.int64)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(position in fps, key)``; keys of a fingerprint are distinct."""
    rows, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        near = np.sort(golay_index()[_segment(fps, j)[:, None] ^ _flips(SEGMENTS[j][1])], axis=1).astype(np.int64)
        new = np.ones(near.shape, dtype=bool)
        new[:, 1:] = near[:, 1:] != near[:, :-1]
        row, col = np.nonzero(new)
        rows.append(row)
        keys.append(i << 34 | _segment(fps, i)[row] << 12 | near[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def words_between(fps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(position, word)``: the words at distance one or less from the
    fingerprint that keep the key's exact segment and decode to its index."""
    rows, words = [], []
    which, index = keys >> 34, keys & 0xFFF
    for i in range(3):
        at = np.nonzero(which == i)[0]
        if not len(at):
            continue
        j, rest = (i + 1) % 3, (i + 2) % 3
        own = fps[at]
        flips = _flips(SEGMENTS[j][1])
        same = golay_index()[_segment(own, j)[:, None] ^ flips] == index[at][:, None]
        row, col = np.nonzero(same)
        rows.append(at[row])
        words.append(own[row] ^ flips[col].astype(np.uint64) << np.uint64(SEGMENTS[j][0]))
        row = np.nonzero(same[:, 0])[0]
        other = _flips(SEGMENTS[rest][1])[1:].astype(np.uint64) << np.uint64(SEGMENTS[rest][0])
        rows.append(np.repeat(at[row], len(other)))
        words.append((own[row][:, None] ^ other).ravel())
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(rows), np.concatenate(words)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def links(distinct_fps: DataFrame) -> DataFrame:
    """``(hi, lo)`` between distinct fingerprints of at most two differing bits,
    enough of them to connect every such pair."""

    def keyed(batches):
        for batch in _blocks(batches):
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(keys)], ["fp", "key"])

    def between(batches):
        for batch in _blocks(batches):
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            rows, words = words_between(fps.view(np.uint64), batch.column("key").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(words.view(np.int64))], ["fp", "word"])

    keys = materialize(map_partition(distinct_fps.select("fp"), keyed, "fp long, key long"), "keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    words = map_partition(keys.join(shared, "key", "left_semi").select("fp", "key"), between, "fp long, word long")
    lo = F.min("fp").over(Window.partitionBy("word"))
    return (words.distinct().select(F.col("fp").alias("hi"), lo.alias("lo"))
            .filter(f"hi > lo AND bit_count(hi ^ lo) <= {MAX_BITS}").distinct())


def _components(docs: DataFrame, shingle_words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, th, fp)`` of every row, and ``(fp, first)`` of every distinct
    fingerprint: ``first (no_id, doc_id, th)`` is the smallest row of its
    component, null ids last."""
    if max_bits != MAX_BITS:
        raise ValueError(f"the segments are laid out for {MAX_BITS} differing bits")
    fps = materialize(fingerprints(docs, shingle_words), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    classes = materialize(fps.groupBy("fp").agg(F.min(row).alias("own")), "classes")
    member = connected_components(links(classes)).select(F.col("vertex").alias("fp"), "root")
    named = member.join(classes, "fp")
    smallest = named.groupBy("root").agg(F.min("own").alias("first"))
    linked = member.join(smallest, "root").select("fp", "first")
    # written, so that a join with it can split a fingerprint of very many copies
    return fps, materialize(classes.join(linked, "fp", "left").select(
        "fp", F.coalesce("first", "own").alias("first")), "component-ids")


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per row of ``docs``.

    Null and empty texts have fingerprint 0 and are linked like any other.
    Equal fingerprints are folded before the search, so exact copies cost one
    fingerprint.  ``component_id`` is the smallest id reachable (null ids are
    never the smallest; a component of null ids only has a null one).  Repeated
    rows give repeated rows; an empty table gives none; other columns are
    ignored.
    """
    fps, ids = _components(docs, shingle_words, max_bits)
    return fps.join(ids.select("fp", F.col("first.doc_id").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without near-duplicates: one row of each component stays, that
    of the smallest ``(doc_id, text hash)``, null ids last (of rows that repeat
    both, the one with the smallest hash of all columns)."""
    _, ids = _components(docs, shingle_words, max_bits)
    # equal texts have equal fingerprints: no two components share a row's (doc_id, th)
    stay = ids.select(F.col("first.doc_id").alias("_id"), F.col("first.th").alias("_th")).distinct()
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["_id"]) & (text_hash() == stay["_th"]), "left_semi")
    row = F.struct(*(F.col(c) for c in docs.columns))
    one = kept.groupBy(F.col("doc_id").alias("_id"), text_hash().alias("_th")).agg(
        F.min_by(row, F.xxhash64(*docs.columns)).alias("_row"))
    return one.select("_row.*")


def op5_simhash(spark, sf_dir) -> DataFrame:
    """Contract query: doc_id, fingerprint (16 hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
