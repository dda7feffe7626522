"""Language-model scores from a log-bilinear model trained with noise contrast.

Words fall into classes whose number follows the corpus: with V distinct training
words, each of the ``sqrt(V)`` most frequent words is a class (at most
``MAX_TOP``, which bounds the model's memory), the end of the text is one, and a
quarter as many classes hold all other words by their last bytes.  The
log-bilinear model predicts the class of a token from the two before it,

    score(t | a, b) = (r_a C1 + r_b C2) . q_t + bias_t ,

and is trained in numpy by noise-contrastive estimation on every training
document.  A word has its class's probability times its smoothed share of the
class, from the corpus counts.

Training is in rounds.  The documents are dealt by a hash over as many parts as
their tokens need (``PART_TOKENS`` each), and each part goes through its documents
in hash order from the common start; the averaged parameters are the next start.
Rounds end when the objective stops improving.  Neither files, splits, cores nor
shuffle partitions change a part, so they do not change the model.

The normalisers come from matrix products: with A = R C1 Q' and B = R C2 Q',
the sum over t of exp(A[a, t] + B[b, t] + bias_t) is exp(A + bias) exp(B)'.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.llm.common import id_remainder, map_partition, parallel, read_table
from linearspark.session import materialize

FOLDS, HELD_OUT = 10, 0
SMOOTH = 0.1
MAX_TOP = 4096            # words that are classes of their own, at most: the normalisers are classes x classes
TOP_PER_SUFFIX, MIN_SUFFIXES, SUFFIX_BYTES = 4, 16, 3
SHARED_WORDS = 200_000    # frequent words whose counts every task holds, at most; the others are joined
DIM = 16
NOISE = 32                # noise classes per minibatch
BATCH = 2048
RATE = 0.05
PART_TOKENS = 1 << 22     # training tokens of a part
MAX_ROUNDS, TOLERANCE = 4, 0.01   # rounds end when the objective falls by a smaller share
FLUSH = 1_000_000         # counts of words a task holds before it adds them up and hands them on
COMBINERS = 8
LIMIT = 20                # of a log odds; products of four such odds are finite
SCORE_BLOCK = 1 << 16     # tokens scored at once
BATCH_BYTES = 1 << 23     # of text split into words at once, unless one text is longer

_END_WORD = b""           # no word is empty


@dataclass
class Tokens:
    """The tokens of a batch of texts, each distinct word once."""
    words: pa.Array         # distinct words (binary); the end, which is the empty word, is the last
    codes: np.ndarray       # position in ``words`` of each token, text after text
    starts: np.ndarray      # where each text's tokens begin in ``codes``

    @staticmethod
    def of(batch: pa.RecordBatch, name: str = "text") -> Tokens:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(name).fill_null("")))
        flat = lists.flatten().dictionary_encode()
        words, codes = flat.dictionary.cast(pa.binary()), flat.indices.to_numpy()
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        real = (pc.binary_length(words).to_numpy() > 0)[codes]       # blanks at either end leave an empty word
        codes, row = codes[real], row[real]
        ends = np.cumsum(np.bincount(row, minlength=len(lists)) + 1) - 1
        out = np.full(len(codes) + len(lists), len(words), dtype=np.int64)
        out[np.arange(len(codes)) + row] = codes
        return Tokens(pa.concat_arrays([words, pa.array([_END_WORD], pa.binary())]), out, np.append(0, ends[:-1] + 1))


def _by_bytes(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of at most ``BATCH_BYTES`` of text, or of one row."""
    for batch in batches:
        before = np.cumsum(pc.binary_length(batch.column(name).fill_null("")).to_numpy())
        at = 0
        while at < batch.num_rows:
            full = before[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(before, full + BATCH_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def corpus_counts(training: DataFrame) -> DataFrame:
    """``(word binary, n)`` of all tokens of ``training``; the end is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def added() -> list[pa.RecordBatch]:
            total = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            held.clear()
            return total.select(["word", "n_sum"]).rename_columns(["word", "n"]).combine_chunks().to_batches()

        for batch in _by_bytes(batches):
            found = Tokens.of(batch)
            n = np.bincount(found.codes, minlength=len(found.words))
            own = np.flatnonzero(n)
            held.append(pa.table({"word": found.words.take(pa.array(own)), "n": n[own]}))
            if sum(t.num_rows for t in held) > FLUSH:
                yield from added()
        if held:
            yield from added()

    return map_partition(training.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What every task knows of the words: bounded by ``SHARED_WORDS`` and ``MAX_TOP``."""
    top: int                      # words that are classes of their own; also the class of the end
    suffixes: int
    cutoff: int                   # the words of at least this count are in ``number``
    number: dict[bytes, int]      # word -> position in the next two
    classes: np.ndarray
    counts: np.ndarray
    total: int                    # N, tokens in training
    distinct: int                 # V
    class_total: np.ndarray       # tokens of each class
    class_distinct: np.ndarray    # distinct words of each class

    @property
    def n_classes(self) -> int:
        return self.top + 1 + self.suffixes

    def suffix_class(self, word: bytes) -> int:
        return self.top + 1 + zlib.crc32(word[-SUFFIX_BYTES:]) % self.suffixes

    def share(self) -> np.ndarray:
        smoothed = self.class_total + SMOOTH
        return smoothed / smoothed.sum()

    def log_all(self) -> float:
        return float(np.log10(self.total + SMOOTH * (self.distinct + 1)))

    def log_class(self) -> np.ndarray:
        """log10 of what a word's smoothed count is divided by in its class; a top word has all of its class."""
        return np.log10(self.class_total + SMOOTH * (self.class_distinct + 1))


def _cutoff(counts: DataFrame, most: int) -> int:
    """The least count that at most ``most`` words reach, on a scale of 1,024 single
    counts and then eighths of powers of two: a histogram, no global sort."""
    step = F.when(F.col("n") < 1024, F.col("n").cast("double")).otherwise(1024 + F.floor((F.log2("n") - 10) * 8))
    rows = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("least")).collect()  # < 1,500
    cutoff, held = max((r["least"] for r in rows), default=0) + 1, 0
    for r in sorted(rows, key=lambda r: -r["step"]):
        held += r["v"]
        if held > most:
            break
        cutoff = r["least"]
    return cutoff


def lexicon(counts: DataFrame, shared_words: int = SHARED_WORDS, max_top: int = MAX_TOP) -> Lexicon:
    """Collect the frequent words (at most ``shared_words``) and the class totals."""
    words_only = counts.filter(F.length("word") > 0)
    cutoff = _cutoff(words_only, shared_words)
    got = words_only.filter(F.col("n") >= cutoff).toArrow()
    words, n = got.column("word").to_pylist(), got.column("n").to_numpy().astype(np.float64)
    rank = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    words, n = [words[i] for i in rank], n[rank] if len(rank) else n
    top = min(isqrt(words_only.count()), max_top, len(words))
    suffixes = max(MIN_SUFFIXES, top // TOP_PER_SUFFIX)
    suffix = (F.pmod(F.crc32(F.substring("word", -SUFFIX_BYTES, SUFFIX_BYTES)), F.lit(suffixes)) + top + 1).cast("int")
    kind = F.when(F.length("word") == 0, F.lit(top)).otherwise(suffix)
    rows = counts.groupBy(kind.alias("class")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # a row a class
    lex = Lexicon(top, suffixes, cutoff, {w: i for i, w in enumerate(words)}, np.zeros(0), n, 0, 0,
                  np.zeros(top + 1 + suffixes), np.zeros(top + 1 + suffixes))
    total, distinct = lex.class_total, lex.class_distinct
    for r in rows:
        total[r["class"]], distinct[r["class"]] = r["n"], r["v"]
    lex.total, lex.distinct = int(total.sum()), int(distinct.sum())
    lex.classes = np.array([i if i < top else lex.suffix_class(w) for i, w in enumerate(words)] + [top], dtype=np.int32)
    for i, word in enumerate(words[:top]):             # a top word leaves its suffix class
        total[lex.suffix_class(word)] -= n[i]
        distinct[lex.suffix_class(word)] -= 1
        total[i], distinct[i] = n[i], 1
    lex.counts = np.append(n, total[top])
    lex.number[_END_WORD] = len(words)
    return lex


@dataclass
class Parameters:
    context: np.ndarray     # R: classes x dim
    first: np.ndarray       # C1, for the token before
    second: np.ndarray      # C2, for the one before that
    target: np.ndarray      # Q: classes x dim
    bias: np.ndarray

    def pack(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in (self.context, self.first, self.second, self.target, self.bias)])

    @staticmethod
    def unpack(flat: np.ndarray, n_classes: int, dim: int = DIM) -> Parameters:
        sizes = [(n_classes, dim), (dim, dim), (dim, dim), (n_classes, dim), (n_classes,)]
        out, at = [], 0
        for shape in sizes:
            out.append(flat[at:at + int(np.prod(shape))].reshape(shape).astype(np.float32))
            at += int(np.prod(shape))
        return Parameters(*out)


def start(lex: Lexicon, seed: int = 1) -> Parameters:
    """Small random vectors and the log shares of the classes: the unigram model."""
    rng, c = np.random.default_rng(seed), lex.n_classes
    noise = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return Parameters(noise(c, DIM), np.eye(DIM, dtype=np.float32), 0.5 * np.eye(DIM, dtype=np.float32),
                      noise(c, DIM), np.log(lex.share()).astype(np.float32))


def contexts(classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token of one text; the end class stands before the start."""
    padded = np.concatenate([np.array([end, end], dtype=classes.dtype), classes])
    return padded[1:-1], padded[:-2]


def batch_contexts(classes: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``contexts`` of the texts that begin at ``starts``, one after another in ``classes``."""
    a, b = (np.concatenate([np.full(i, end, dtype=classes.dtype), classes[:-i]])[:len(classes)] for i in (1, 2))
    a[starts] = b[starts] = end
    second = starts + 1
    b[second[second < len(classes)]] = end
    return a, b


def _word_counts(found: Tokens, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, word, occurrences)`` of the ``wanted`` words, by text."""
    row = np.repeat(np.arange(len(found.starts)), np.diff(found.starts, append=len(found.codes)))
    own = wanted[found.codes]
    key, n = np.unique(row[own] * len(found.words) + found.codes[own], return_counts=True)
    return key // len(found.words), key % len(found.words), n


class Trainer:
    """Adagrad on the noise-contrastive objective; noise is drawn from the class shares."""

    def __init__(self, begin: Parameters, lex: Lexicon, seed: int):
        self.p = Parameters(*(a.copy() for a in (begin.context, begin.first, begin.second, begin.target, begin.bias)))
        share, self.loss, self.tokens = lex.share(), 0.0, 0
        self.cumulated, self.log_noise = np.cumsum(share), np.log(NOISE * share).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.seen = {k: np.full(len(getattr(self.p, k)), 1e-7, dtype=np.float32) for k in ("context", "target", "bias")}
        self.seen |= {k: np.full((DIM, DIM), 1e-7, dtype=np.float32) for k in ("first", "second")}

    def _rows(self, rows: np.ndarray, grad: np.ndarray, *names: str) -> None:
        """Add up the gradients (components x rows) of equal rows and take one
        step; the bias is the last component, if it is named."""
        own = np.flatnonzero(np.bincount(rows, minlength=len(self.p.bias)))
        total = np.stack([np.bincount(rows, weights=g)[own] for g in grad]).astype(np.float32)
        for name in names:
            now = total[-1] if name == "bias" else total[:DIM]
            self.seen[name][own] += now ** 2 if now.ndim == 1 else np.einsum("ij,ij->j", now, now) / DIM
            getattr(self.p, name)[own] -= (now * (RATE / np.sqrt(self.seen[name][own]))).T

    def step(self, a: np.ndarray, b: np.ndarray, t: np.ndarray) -> None:
        p = self.p
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), len(p.bias) - 1)
        a, b, t = a.astype(np.intp), b.astype(np.intp), t.astype(np.intp)
        ra, rb, qt, qn = (x.take(rows, axis=0) for x, rows in ((p.context, a), (p.context, b), (p.target, t), (p.target, noise)))
        h = ra @ p.first + rb @ p.second
        of_data = -1 / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", h, qt) + p.bias[t] - self.log_noise[t], LIMIT)))
        more = h @ qn.T
        more += p.bias[noise] - self.log_noise[noise]
        np.exp(np.minimum(more, LIMIT, out=more), out=more)
        more += 1
        pairs = more[:, :NOISE // 2] * more[:, NOISE // 2:]
        fours = pairs[:, :NOISE // 4] * pairs[:, NOISE // 4:]       # one logarithm for four noise terms
        self.loss += float(np.log(fours).sum(dtype=np.float64) - np.log1p(of_data).sum(dtype=np.float64))
        of_noise = np.subtract(1, np.reciprocal(more, out=more), out=more)
        self.tokens += len(t)
        scale = np.float32(1 / len(t))
        of_data *= scale
        of_noise *= scale
        grad_h = of_data[:, None] * qt + of_noise @ qn
        grad_first, grad_second = ra.T @ grad_h, rb.T @ grad_h
        grad_a, grad_b = (grad_h @ p.first.T).T, (grad_h @ p.second.T).T
        grad_q = np.empty((DIM + 1, len(t) + NOISE), dtype=np.float32)
        grad_q[:DIM, :len(t)], grad_q[DIM, :len(t)] = (h * of_data[:, None]).T, of_data
        grad_q[:DIM, len(t):], grad_q[DIM, len(t):] = (of_noise.T @ h).T, np.ones(len(t), dtype=np.float32) @ of_noise
        self._rows(np.concatenate([t, noise]), grad_q, "target", "bias")
        self._rows(np.concatenate([a, b]), np.concatenate([grad_a, grad_b], axis=1), "context")
        for name, grad in (("first", grad_first), ("second", grad_second)):
            self.seen[name] += grad ** 2
            setattr(p, name, getattr(p, name) - RATE * grad / np.sqrt(self.seen[name]))


def _classes(words: pa.Array, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Position in the lexicon (-1: not there) and class of each word."""
    get, crc, first, suffixes = lex.number.get, zlib.crc32, lex.top + 1, lex.suffixes
    listed = words.to_numpy(zero_copy_only=False).tolist()
    at = np.array([get(w, -1) for w in listed], dtype=np.int64)
    classes = lex.classes[at]
    others = np.flatnonzero(at < 0)
    classes[others] = [first + crc(listed[i][-SUFFIX_BYTES:]) % suffixes for i in others.tolist()]
    return at, classes


def encode(training: DataFrame, shared, parts: int) -> DataFrame:
    """``(part, h, classes)`` of the training documents, the classes of a text's
    tokens as 16-bit numbers.  Documents are dealt by a hash of id and text."""
    h = F.xxhash64("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_bytes(batches):
            found = Tokens.of(batch)
            classes = _classes(found.words, shared.value)[1].astype(np.int16)[found.codes]
            own = [c.tobytes() for c in np.split(classes, found.starts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("h"), pa.array(own, pa.binary())],
                                             ["part", "h", "classes"])

    dealt = training.select(F.pmod(h, F.lit(parts)).alias("part"), h.alias("h"), "text")
    return map_partition(dealt, run, "part long, h long, classes binary")


def _one_round(encoded: DataFrame, shared, begin, number: int, parts: int) -> DataFrame:
    """``(part, weight, loss, flat)``: the parameters of each part after its
    documents, times its tokens, and the objective summed over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, trainer, own = shared.value, None, None
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal held, size
            if held:
                a, b, t = (np.concatenate(x) for x in zip(*held))
                order = trainer.rng.permutation(len(t))
                for i in range(0, len(t), BATCH):
                    pick = order[i:i + BATCH]
                    trainer.step(a[pick], b[pick], t[pick])
            held, size = [], 0

        def result() -> pa.RecordBatch:
            flush()
            flat = (trainer.p.pack().astype(np.float64) * trainer.tokens).tobytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([own], pa.int64()), pa.array([float(trainer.tokens)]), pa.array([trainer.loss]), pa.array([flat], pa.binary())],
                ["part", "weight", "loss", "flat"])

        for batch in batches:
            for part, classes in zip(batch.column("part").to_pylist(), batch.column("classes").to_pylist()):
                if part != own:
                    if trainer is not None:
                        yield result()
                    own, trainer = part, Trainer(begin.value, lex, (number << 32) + part)
                t = np.frombuffer(classes, dtype=np.int16)
                held.append((*contexts(t, lex.top), t))
                size += len(t)
                if size >= 100 * BATCH:
                    flush()
        if trainer is not None:
            yield result()

    # the columns of the sort fix the order of a part's documents, wherever they were read
    placed = encoded.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "h", "classes")
    return map_partition(placed, run, "part long, weight double, loss double, flat binary")


def _average(rows: DataFrame, n_classes: int) -> tuple[Parameters, float] | None:
    """The parts' parameters averaged by tokens, and the objective of a token."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, weight, loss, total = None, 0.0, 0.0, None
        for batch in batches:
            for part, w, x, flat in zip(*(batch.column(c).to_pylist() for c in ("part", "weight", "loss", "flat"))):
                got = np.frombuffer(flat)
                first = part if first is None else first
                weight, loss, total = weight + w, loss + x, got.copy() if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([weight]), pa.array([loss]),
                                              pa.array([total.tobytes()], pa.binary())], ["part", "weight", "loss", "flat"])

    dealt = rows.repartitionById(COMBINERS, F.pmod("part", F.lit(COMBINERS)).cast("int")).sortWithinPartitions("part")
    sums = map_partition(dealt, combine, "part long, weight double, loss double, flat binary").collect()  # COMBINERS rows at most
    if not sums:
        return None
    sums.sort(key=lambda r: r["part"])
    weight = sum(r["weight"] for r in sums)
    flat = sum(np.frombuffer(r["flat"]) for r in sums) / weight
    return Parameters.unpack(flat, n_classes), sum(r["loss"] for r in sums) / weight


def train(training: DataFrame, lex: Lexicon, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE,
          part_tokens: int = PART_TOKENS) -> Parameters:
    """Average of the parts' parameters after each round over all rows ``(doc_id,
    text)`` of ``training``, until a round's objective is not below the one before
    by the share ``tolerance``.  Rows equal in id and text are in one part, which
    streams over them."""
    spark = training.sparkSession
    shared, now, before = spark.sparkContext.broadcast(lex), start(lex), None
    parts = max(1, -(-lex.total // part_tokens))
    encoded = materialize(encode(parallel(training.select("doc_id", "text")), shared, parts), "training-classes")
    for number in range(max_rounds):
        begin = spark.sparkContext.broadcast(now)
        got = _average(_one_round(encoded, shared, begin, number, parts), lex.n_classes)
        begin.unpersist()
        if got is None:
            break
        now, objective = got
        if before is not None and objective > (1 - tolerance) * before:
            break
        before = objective
    return now


@dataclass
class Scorer:
    """The trained model: log P(t | a, b) = (first[a] + second[b]) . target[t] + bias[t] - norm[a, b]."""
    first: np.ndarray       # R C1: classes x dim
    second: np.ndarray      # R C2
    target: np.ndarray
    bias: np.ndarray
    norm: np.ndarray        # classes x classes, the model's only large table

    @staticmethod
    def of(p: Parameters, block: int = 256) -> Scorer:
        first, second = p.context @ p.first, p.context @ p.second
        b = second @ p.target.T
        b_max = b.max(axis=1)
        b = np.exp(b - b_max[:, None]).T.copy()
        norm = np.empty((len(p.bias), len(p.bias)), dtype=np.float32)
        for i in range(0, len(norm), block):
            a = first[i:i + block] @ p.target.T + p.bias
            a_max = a.max(axis=1, keepdims=True)
            norm[i:i + block] = np.log(np.exp(a - a_max) @ b) + a_max + b_max
        return Scorer(*(x.astype(np.float32) for x in (first, second, p.target, p.bias)), norm)

    def __call__(self, classes: np.ndarray, end: int) -> np.ndarray:
        """log10 probability of each class of one text after the two before it."""
        return self.of_context(*contexts(classes, end), classes)

    def of_context(self, a: np.ndarray, b: np.ndarray, classes: np.ndarray) -> np.ndarray:
        raw = np.einsum("ij,ij->i", self.first[a] + self.second[b], self.target[classes]) + self.bias[classes]
        return (raw - self.norm[a, b]) * np.float32(np.log10(np.e))


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every
    row of ``docs``, learning from ``training``.

    Null and empty texts are one end token.  Without training tokens every word
    has the same smoothed probability.  Repeated rows repeat their result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    counts = materialize(corpus_counts(parallel(training.select("text"))), "word-counts")
    lex = lexicon(counts)
    shared = spark.sparkContext.broadcast(lex)
    tables = spark.sparkContext.broadcast(Scorer.of(train(training, lex)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = shared.value, tables.value
        log_count = np.log10(np.append(words.counts, 1 - SMOOTH) + SMOOTH)    # last: 0 for words to be joined
        counted = np.append(words.counts > 0, False)
        log_class, log_all = words.log_class(), words.log_all()
        row_id = TaskContext.get().partitionId() << 40
        for batch in _by_bytes(batches):
            found = Tokens.of(batch)
            at, of_word = _classes(found.words, words)
            # of each distinct word: what it adds to the base, and to the score beside its class's probability
            base = log_count[at]
            within = np.where(of_word > words.top, base - log_class[of_word], 0)
            per_text = lambda x: np.add.reduceat(x, found.starts)
            model = within[found.codes]
            classes = of_word[found.codes]
            a, b = batch_contexts(classes, found.starts, words.top)
            for i in range(0, len(classes), SCORE_BLOCK):
                block = slice(i, i + SCORE_BLOCK)
                model[block] += table.of_context(a[block], b[block], classes[block])
            n_tokens = np.diff(found.starts, append=len(found.codes))
            row, code, n = _word_counts(found, at < 0)    # the words that not every task holds are joined
            rare = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([found.words.take(pa.array(code)), pa.array(n.astype(np.int32))], ["word", "n"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(row_id + np.arange(batch.num_rows)), pa.array(n_tokens),
                 pa.array(per_text(counted[at][found.codes].astype(np.int64))),
                 pa.array(per_text(base[found.codes]) - n_tokens * log_all), pa.array(per_text(model)), rare],
                ["doc_id", "row_id", "n_tokens", "known", "base", "model", "rare"])
            row_id += batch.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    partial = materialize(map_partition(
        parallel(docs.select("doc_id", "text")), run, f"doc_id {kind}, row_id long, n_tokens long, known long, base double, "
        "model double, rare array<struct<word: binary, n: int>>"), "partial-scores")
    rare = partial.select("row_id", F.explode("rare").alias("r")).select("row_id", "r.word", "r.n")
    seen = counts.filter(F.col("n") < lex.cutoff).select("word", F.col("n").alias("c"))
    joined = rare.join(seen, "word", "left")
    extra = joined.groupBy("row_id").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("more"))
    out = partial.drop("rare").join(extra, "row_id", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                      F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"),
                      (F.col("model") + more).alias("score"))


def op10_lm_score(spark, sf_dir) -> DataFrame:
    """Contract query: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, docs.filter(id_remainder(FOLDS) != HELD_OUT))
    return scored.select("doc_id", (id_remainder(FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")
