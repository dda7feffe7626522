"""N-gram Jaccard join by multiple-global-order filtering.

Two sets whose Jaccard similarity is ``t`` or more share a token of their
prefixes under *every* total order of all tokens (the prefix of a set of n is
its first ``n - ceil(t n) + 1`` tokens).  Three orders are used; in each of them
tokens that occur in one document only come first:

* ``rare``: then by how often a token occurs in the corpus, then by hash;
* ``up``: then by hash;
* ``down``: then by the hash read in the other byte order.

Pairs are found by a join on rare prefix tokens, within the bounds of sizes, of
positions in that order, and of the difference that counts of own tokens and
parity bits of the others show; pairs without a common prefix token in the two
other orders are dropped; what is left is verified on the whole sets.

Frequencies are counted in packed form: the sorted token hashes of a block of
documents are dealt out by hash range, counted range by range, and the tokens
that occur more than once go back to their block with the logarithm of their
frequency.  Tokens of one document need not be known one by one: they are in no
intersection, and a set with too many of them has no partner at all.

Equal sets are folded.  A prefix token's bucket of at most ``SMALL_BUCKET`` sets
(nearly all are: most tokens are shared by chance) is joined with itself, once.
Large groups of similar sets are linked without their pairs: in rounds, members
of a larger bucket are compared with one leader; after that only pairs of
different components are left, each with a member outside its bucket's largest
component.  All of those are compared.

Token hashes have 48 bits (a pair of sets of n tokens sees a false common token
with a chance of n^2 / 2^48), names of sets 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.llm.common import map_partition, parallel, read_table, utf8
from linearspark.llm.components import connected_components
from linearspark.session import materialize

SHINGLE_WORDS = 4
PERCENT = 85                  # link: 100 * intersection >= PERCENT * union
BLOCK_TOKENS = 1 << 17
RANGE_TOKENS = 1 << 21        # tokens that one counting task holds
TOKEN_BYTES = 6
BYTES_A_TOKEN = 6             # expected, for the number of ranges
TOKEN_BITS = 8 * TOKEN_BYTES
PARITY_BITS = 256
SMALL_BUCKET = 8              # sets of a bucket whose pairs are all compared at once
LEAST_ROUNDS = 3              # before rounds that change little end them: a leader may be a poor one
STAR_ROUNDS = 6               # at most; they only make the last, complete round smaller


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (all arithmetic modulo 2^64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct ``TOKEN_BITS``-bit hashes of a text's word shingles; a
    text of fewer words has one (all its words), one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter(map(digest, words), dtype=np.uint64, count=len(words))
    k = min(shingle_words, len(words))
    last = len(words) - k + 1
    h = np.full(last, k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + each[i:last + i])
    return np.unique(h >> np.uint64(64 - TOKEN_BITS))


def prefix_size(n, percent: int = PERCENT):
    """Tokens of a prefix: ``n - ceil(percent n / 100) + 1`` (numbers or columns)."""
    return n - (n * percent + 99) // 100 + 1


def index_size(n, percent: int = PERCENT):
    """The same for the smaller set of a pair, whose union is at least its size:
    ``n - ceil(2 t n / (1 + t)) + 1``."""
    return n - (2 * percent * n + 99 + percent) // (100 + percent) + 1


def _pack(tokens: np.ndarray) -> bytes:
    """Token bytes, most significant first, plane by plane: sorted runs compress."""
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - TOKEN_BYTES:].T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(TOKEN_BYTES, -1)
    wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    wide[:, 8 - TOKEN_BYTES:] = planes.T
    return wide.view(">u8").reshape(-1).astype(np.uint64)


# ------------------------------------------------------------------ sets and frequencies

_DOCS = ["doc_ids", "sizes", "set_hashes"]


def _range_bits(text_bytes: int) -> int:
    """Ranges are a power of two in number, of about ``RANGE_TOKENS`` tokens each."""
    wanted = max(text_bytes, 1) / BYTES_A_TOKEN / RANGE_TOKENS
    return min(max(int(np.ceil(np.log2(wanted))), 0), 30)


def _no_docs(n: int, id_type: pa.DataType) -> list[pa.Array]:
    return [pa.nulls(n, pa.list_(id_type)), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int64()))]


def dealt_tokens(docs: DataFrame, bits: int, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Blocks of documents: a row with their ids, set sizes and set names, and a
    row per hash range with its sorted tokens (as gaps) and their documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    low = np.uint64(TOKEN_BITS - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sets, n, id_type = TaskContext.get().partitionId() << 32, [], [], 0, pa.int64()

        def rows() -> pa.RecordBatch:
            flat = np.concatenate(sets)
            order = np.argsort(flat)
            owner = np.repeat(np.arange(len(sets), dtype="<u2"), [len(s) for s in sets])[order]
            flat = flat[order]
            ends = np.searchsorted(flat >> low, np.arange(1 << bits, dtype=np.uint64), side="right")
            starts = np.concatenate([[0], ends[:-1]])
            which = np.nonzero(ends > starts)[0]
            rest = flat & np.uint64((1 << int(low)) - 1)
            gaps = [_pack(np.diff(rest[starts[r]:ends[r]], prepend=np.uint64(0))) for r in which]
            owners = [owner[starts[r]:ends[r]].tobytes() for r in which]
            names = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) for s in sets], dtype=np.uint64).view(np.int64)
            m = len(which)
            docs_ = [pa.concat_arrays([x, pa.array([v], x.type)]) for x, v in
                     zip(_no_docs(m, id_type), (ids, [len(s) for s in sets], names))]
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * (m + 1)), pa.array([*which.tolist(), block & ((1 << bits) - 1)], pa.int32()),
                 pa.array([*gaps, None], pa.binary()), pa.array([*owners, None], pa.binary()), *docs_],
                ["block", "range", "gaps", "owners", *_DOCS])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text")):
                own = shingle_hashes(text, shingle_words)
                ids.append(doc_id)
                sets.append(own)
                n += len(own) + 8                 # at most 1 << 16 documents a block
                if n >= BLOCK_TOKENS:
                    yield rows()
                    block, ids, sets, n = block + 1, [], [], 0
        if ids:
            yield rows()

    return map_partition(parallel(docs.select("doc_id", "text")), run, "block long, range int, gaps binary, owners binary, "
                         f"doc_ids array<{kind}>, sizes array<int>, set_hashes array<long>")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict], pa.DataType]]:
    """``(key, its rows, type of the ids)`` of sorted batches."""
    held, last, id_type = [], None, pa.int64()
    for batch in batches:
        id_type = batch.schema.field("doc_ids").type.value_type
        for row in batch.to_pylist():
            if held and row[key] != last:
                yield last, held, id_type
                held = []
            last = row[key]
            held.append(row)
    if held:
        yield last, held, id_type


def shared_tokens(dealt: DataFrame, bits: int) -> DataFrame:
    """The rows of ``dealt_tokens`` with only the tokens that occur in several
    documents, and the logarithm of how many (one byte each)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, rows, id_type in _runs(batches, "range"):
            own = [(x, np.cumsum(_unpack(x["gaps"]))) for x in rows if x["gaps"] is not None]
            out = []
            if own:
                keys, n = np.unique(np.concatenate([k for _, k in own]), return_counts=True)
                keys, log = keys[n > 1], np.log2(n[n > 1]).astype(np.uint8)
            for x, k in own if own and len(keys) else []:
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                hit = keys[at] == k
                if hit.any():
                    out.append((x["block"], r, _pack(np.diff(k[hit], prepend=np.uint64(0))),
                                np.frombuffer(x["owners"], "<u2")[hit].tobytes(), log[at[hit]].tobytes(), None, None, None))
            out += [(x["block"], r, None, None, None, *(x[c] for c in _DOCS)) for x in rows if x["gaps"] is None]
            if out:
                types = [pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 ["block", "range", "gaps", "owners", "logs", *_DOCS])

    kind = dealt.schema["doc_ids"].dataType.simpleString()
    placed = dealt.repartition(1 << bits, "range").sortWithinPartitions("range")
    return map_partition(placed, run, "block long, range int, gaps binary, owners binary, logs binary, "
                         f"doc_ids {kind}, sizes array<int>, set_hashes array<long>")


_PARITY = [f"odd{i}" for i in range(PARITY_BITS // 64)]
_SET = ("n int, set_hash long, alone int, tokens array<long>, rare array<long>, up array<long>, down array<long>, "
        + ", ".join(f"{c} long" for c in _PARITY))


def parity(tokens: np.ndarray) -> np.ndarray:
    """For every value of a token's lowest bits, whether an odd number of the tokens
    have it: two sets differ in as many tokens at least as in such bits."""
    odd = np.bincount((tokens & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(tokens: np.ndarray, logs: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``kept`` of a set's (sorted) shared tokens under the three orders."""
    return tokens[np.argsort(logs, kind="stable")][:kept], tokens[:kept], tokens[np.argsort(tokens.byteswap())][:kept]


def sets_of(shared: DataFrame, bits: int, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n, set_hash, alone, tokens, rare, up, down)``, one row a document:
    the size of its set, how many of its tokens are in no other document, the
    others, what the prefixes hold of these, and their parity bits.  ``tokens`` is null for a set
    that cannot have a partner: its prefix is all its own."""
    kind = shared.schema["doc_ids"].dataType.elementType.simpleString()
    low = np.uint64(TOKEN_BITS - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, id_type in _runs(batches, "block"):
            docs = next(x for x in rows if x["gaps"] is None)
            rows = [x for x in rows if x["gaps"] is not None]
            joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
            tokens = joined([np.cumsum(_unpack(x["gaps"])) | np.uint64(x["range"]) << low for x in rows], np.uint64)
            owner = joined([np.frombuffer(x["owners"], "<u2") for x in rows], "<u2")
            logs = joined([np.frombuffer(x["logs"], np.uint8) for x in rows], np.uint8)
            order = np.lexsort((tokens, owner))
            tokens, logs = tokens[order], logs[order]
            ends = np.searchsorted(owner[order], np.arange(len(docs["sizes"])), side="right")
            out, a = [], 0
            for doc_id, n, name, b in zip(docs["doc_ids"], docs["sizes"], docs["set_hashes"], ends):
                alone = n - int(b - a)
                kept = prefix_size(n, percent) - alone
                found = [None] * (4 + len(_PARITY))
                if n and kept > 0:
                    own = tokens[a:b]
                    found = [*(x.view(np.int64) for x in (own, *prefixes(own, logs[a:b], kept))), *parity(own).tolist()]
                out.append((doc_id, n, name, alone, *found))
                a = b
            types = [id_type, pa.int32(), pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 4, *[pa.int64()] * len(_PARITY)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                             ["doc_id", "n", "set_hash", "alone", "tokens", "rare", "up", "down", *_PARITY])

    placed = shared.repartition("block").sortWithinPartitions("block")
    return map_partition(placed, run, f"doc_id {kind}, {_SET}")


# ------------------------------------------------------------------ pairs

def postings(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(token, sid, n, alone, pos)`` and parity bits: the rare prefix of each set."""
    return sets.select("sid", "n", "alone", *_PARITY, F.posexplode("rare").alias("at", "token")).select(
        "sid", "n", "alone", *_PARITY, (F.col("alone") + F.col("at")).alias("pos"), "token")


def _fits(a: str, b: str, percent: int):
    """The bounds for a pair that shares this token: sizes, prefix of the smaller
    set, positions, and tokens that only one of the two has."""
    apart = " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in _PARITY)
    both = f"({a}.n + {b}.n)"

    def ordered(large: str, small: str) -> str:
        return (f"100 * {small}.n >= {percent} * {large}.n AND {small}.pos < {small}.n - "
                f"(2 * {percent} * {small}.n + {99 + percent}) div {100 + percent} + 1")

    return F.expr(f"({100 + percent} * ({a}.alone + {b}.alone + {apart}) <= {100 - percent} * {both}) AND "
                  f"({100 + percent} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {percent} * {both}) AND "
                  f"CASE WHEN {a}.n > {b}.n OR ({a}.n = {b}.n AND {a}.sid > {b}.sid) THEN {ordered(a, b)} ELSE {ordered(b, a)} END")


def linked(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(hi, lo)`` that share prefix tokens under the other two orders
    and whose whole sets reach the similarity."""
    side = lambda name: sets.select(F.col("sid").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("up", "down", "tokens", "n")))
    both = pairs.join(side("hi"), "hi").join(side("lo"), "lo")
    shared = both.filter(F.arrays_overlap("up_hi", "up_lo") & F.arrays_overlap("down_hi", "down_lo"))
    common = F.size(F.array_intersect("tokens_hi", "tokens_lo"))
    return shared.filter(100 * common >= percent * (F.col("n_hi") + F.col("n_lo") - common)).select("hi", "lo")


def _relabel(links: DataFrame) -> DataFrame:
    """``(sid, comp)`` of linked sets."""
    return materialize(connected_components(links).select(F.col("vertex").alias("sid"), F.col("root").alias("comp")), "components")


def components(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(sid, comp)`` for every set with a link; comp is the smallest sid."""
    shared = sets.select(F.explode("rare").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    post = materialize(postings(sets, percent).join(shared, "token"), "shared-postings")
    rows = post.count()
    small = post.filter(F.col("m") <= SMALL_BUCKET).drop("m")
    found = small.alias("a").join(small.alias("b"), F.expr("a.token = b.token AND a.sid > b.sid") & _fits("a", "b", percent))
    pairs = materialize(found.select(F.col("a.sid").alias("hi"), F.col("b.sid").alias("lo")).distinct(), "small-candidates")
    links = materialize(linked(pairs, sets, percent), "small-links")
    comp = _relabel(links)
    post = post.filter(F.col("m") > SMALL_BUCKET).drop("m")
    if post.isEmpty():
        return comp
    left = None
    for star in range(STAR_ROUNDS + 1):
        # buckets that still hold several components, each with its largest
        named = post.join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        named = materialize(named, "named-postings")
        groups = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
        open_ = groups.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.sum("m").alias("size"),
                                            F.max(F.struct("m", F.col("comp"))).alias("top")).filter("comps > 1")
        open_ = materialize(open_.select("token", "size", F.col("top.m").alias("top_m"), F.col("top.comp").alias("top")), "open")
        todo = open_.agg(F.sum((F.col("size") - F.col("top_m")) * F.col("size")).alias("pairs")).first()["pairs"] or 0
        complete = star == STAR_ROUNDS or todo <= 4 * rows or (star >= LEAST_ROUNDS and todo > 0.9 * left)
        left = todo
        own = named.join(open_, "token")
        if complete:
            # every pair of different components: one of them is outside the bucket's largest
            minor = own.filter("comp <> top").alias("a")
            cross = minor.join(own.alias("b"), F.expr("a.token = b.token AND a.comp <> b.comp AND a.sid <> b.sid"))
            found = cross.filter(_fits("a", "b", percent))
        else:
            # one leader a bucket, of its largest component, another one in each round
            lead = own.filter("comp = top").groupBy("token").agg(
                F.min_by(F.struct("sid", "n", "alone", "pos", *_PARITY), F.xxhash64(F.lit(star), "sid")).alias("l")).select("token", "l.*")
            found = own.filter("comp <> top").alias("a").join(
                lead.alias("b"), F.expr("a.token = b.token AND a.sid <> b.sid")).filter(_fits("a", "b", percent))
        pairs = materialize(found.select(F.greatest("a.sid", "b.sid").alias("hi"), F.least("a.sid", "b.sid").alias("lo")).distinct(),
                            "candidates")
        new = materialize(linked(pairs, sets, percent), "links")
        links = materialize(links.unionByName(new), "all-links")
        comp = _relabel(links)
        if complete:
            return comp


def similar_documents(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row per row of ``docs``.

    Documents are linked when ``100 * intersection >= percent * union`` of their
    sets of distinct word shingles (ASCII-lower-cased words at ASCII white space).
    Null texts and texts without words have an empty set, linked with nothing.
    Equal sets are folded, so exact copies cost one set.  ``component_id`` is the
    smallest id reachable, the row's own included (null ids are never the
    smallest; a component of null ids only has a null one).  Repeated rows give
    repeated rows; an empty table gives none; other columns are ignored.
    """
    bits = _range_bits(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    rows = materialize(sets_of(shared_tokens(dealt_tokens(docs, bits, shingle_words), bits), bits, percent), "sets")
    # one set of each class of equal ones; its name is its id
    sets = materialize(rows.filter("tokens IS NOT NULL").dropDuplicates(["set_hash"]).select(
        F.col("set_hash").alias("sid"), "n", "alone", "tokens", "rare", "up", "down", *_PARITY), "distinct-sets")
    comp = components(sets, percent).withColumnRenamed("sid", "set_hash")
    classes = rows.filter("n > 0").groupBy("set_hash").agg(F.min("doc_id").alias("least"))
    classes = classes.join(comp, "set_hash", "left").withColumn("comp", F.coalesce("comp", "set_hash"))
    classes = materialize(classes, "classes")
    least = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = materialize(classes.join(least, "comp").select(F.col("set_hash").alias("s"), "component_id"), "component-ids")
    return rows.join(named, (F.col("n") > 0) & (F.col("set_hash") == F.col("s")), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_jaccard_join(spark, sf_dir) -> DataFrame:
    """Contract query: 4-word shingles, similarity 0.85, over all of ``documents``."""
    return similar_documents(read_table(spark, sf_dir, "documents"))
