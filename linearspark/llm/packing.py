"""Packing along a space-filling curve.

A document's tokens are hashed into a vector of ``HASH_DIMS`` counts, projected
to ``AXES`` dimensions by a fixed random matrix, and given the Hilbert key of
its cell.  Spark range-sorts the documents by (key, id), which splits cells of
very many equal documents, and each range is packed in this order: neighbours
on the curve share sequences.  Documents are cut where a sequence is full, so
only the last sequence of a range is short; it is cut into sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.llm.common import map_batches, map_partition, parallel, read_table, strings
from linearspark.llm.tokens import TOKENIZER, encode
from linearspark.session import materialize

SEQUENCE = 2048
END_ID = 1
HASH_DIMS = 256
AXES, BITS = 4, 10
SEED = 1


@cache
def _projection() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((HASH_DIMS, AXES))


def project(ids: np.ndarray) -> np.ndarray:
    """The cell of a document: ``AXES`` coordinates of ``BITS`` bits."""
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.int64)
    vector = np.sqrt(np.bincount(bucket, minlength=HASH_DIMS)[:HASH_DIMS])
    place = vector / (np.linalg.norm(vector) or 1.0) @ _projection()
    cells = 1 << BITS
    return np.clip((place + 2.0) / 4.0 * cells, 0, cells - 1).astype(np.int64)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``cells`` (rows x axes).

    The cell's bits are taken from the top.  In each level the subcube's bits
    are put into the curve's orientation (a Gray code read back to its rank) and
    the orientation of that subcube is applied to the bits below: axis 0 changes
    places with the axis, or is reflected.
    """
    x = cells.T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for axis in range(axes):
            high = (x[axis] >> level & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[axis]) & below)
            x[0] = np.where(high, x[0] ^ below, x[0] ^ swap)
            if axis:
                x[axis] ^= swap
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            key = key << 1 | x[axis] >> level & 1
    return key


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, key, n, ids)``: the Hilbert key, the number of ids with the end
    id, and the ids as little-endian unsigned 32-bit integers without it."""
    src = docs.select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [encode(t, tokenizer) for t in strings(batch, "text")]
        keys = hilbert_key(np.stack([project(x) for x in ids]))
        # 16 bits hold the ids of a vocabulary of up to 65,536
        small = [x.astype("<u2").tobytes() if not len(x) or x.max() < 1 << 16 else None for x in ids]
        wide = [x.astype("<u4").tobytes() if s is None else None for x, s in zip(ids, small)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(keys), pa.array([len(x) + 1 for x in ids], pa.int64()),
             pa.array(small, pa.binary()), pa.array(wide, pa.binary())], ["doc_id", "key", "n", "small", "wide"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return map_batches(parallel(src), run, f"doc_id {kind}, key long, n long, small binary, wide binary")


class _Sequences:
    """Fills sequences one after the other; keeps the pieces of the open one."""

    def __init__(self, base: int, sequence: int):
        self.next_id, self.sequence = base, sequence
        self.open: list[tuple] = []
        self.used = 0
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        start = 0
        while start < len(ids):
            take = min(self.sequence - self.used, len(ids) - start)
            self.open.append((doc_id, start, ids[start:start + take], len(ids)))
            self.used += take
            start += take
            if self.used == self.sequence:
                self._close(self.open)
                self.open, self.used = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            self.out.append((doc_id, start, len(ids), zlib.crc32(raw), total, self.next_id, offset, raw))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """Cut the open sequence into sequences whose lengths are powers of two."""
        pieces, left = self.open, self.used
        self.open, self.used = [], 0
        while left:
            room = 1 << left.bit_length() - 1
            left -= room
            now: list[tuple] = []
            while room:
                doc_id, start, ids, total = pieces[0]
                take = min(room, len(ids))
                now.append((doc_id, start, ids[:take], total))
                room -= take
                pieces[0] = (doc_id, start + take, ids[take:], total)
                if take == len(ids):
                    pieces = pieces[1:]
            self._close(now)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, ids (binary, little-endian unsigned 32-bit).

    A null or empty text is the end id alone.  Each row of ``docs`` is packed,
    repeated ids and texts too; equal keys are ordered by id.  An empty table
    gives no piece; other columns are ignored.  Sequence ids are unique and hold
    the range's number in their high bits.
    """
    ready = materialize(tokenized(docs, tokenizer, end_id), "tokens")
    ranged = ready.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "n", "small")
    kind = ready.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sequences(TaskContext.get().partitionId() << 32, sequence)

        def emit() -> pa.RecordBatch:
            rows, state.out = state.out, []
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], kind_of), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                                       "sequence_id", "offset", "ids"])

        kind_of = pa.int64()
        for batch in batches:
            kind_of = batch.schema.field("doc_id").type
            for doc_id, small, wide in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "small", "wide"))):
                ids = np.frombuffer(small, "<u2") if wide is None else np.frombuffer(wide, "<u4")
                state.add(doc_id, np.append(ids.astype(np.uint32), np.uint32(end_id)))
                if len(state.out) >= 2000:
                    yield emit()
        state.finish()
        if state.out:
            yield emit()

    return map_partition(ranged.select("doc_id", "small", "wide"), run, f"doc_id {kind}, start long, length long, "
                         "ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def op4_packing(spark, sf_dir) -> DataFrame:
    """Contract query: the pieces without their ids."""
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("ids")
