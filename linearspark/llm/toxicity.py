"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is read in windows of about ``WINDOW_WORDS`` words, equally long to a
word; signs at both ends of a word go.  A window is the bag of the character
n-grams of its words (with their borders), hashed to buckets and filled up to
``LEAST_GRAMS`` with empty ones, so that a few n-grams alone, or one short word
said again and again, do not decide; the mean of the buckets' embeddings goes
through a linear softmax with two classes.
Embeddings and softmax are trained jointly in numpy.  Only documents carry
labels, so windows start with the label of their document.  In each round, each
half of the documents is judged by a model of the other half, and the windows
of toxic documents that do not stand out among those of clean documents become
clean ones.  The score of a text is that of its two highest windows, through a
logistic curve fitted on those judgements.

Training data are a bounded sample, ``MAX_DOCS`` labelled documents of each
class and ``MAX_WINDOWS`` windows of each; scores cover every window of every
text.  The softmax is linear in the mean, so scoring needs one weight per
bucket, which is what is broadcast (``BUCKETS`` floats).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linearspark.llm.common import id_remainder, map_batches, parallel, read_table, strings

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4, 5)
WINDOW_WORDS = 8
LEAST_GRAMS = 60
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"
MAX_DOCS = 1000
MAX_WINDOWS = 96
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
STEPS, BATCH = 2000, 64      # least gradient steps of a fit, windows of each
RATE, DECAY = 50.0, 1e-5      # first learning rate of the embeddings; their shrinkage per step and rate
CLEAN_SHARE = 0.995           # of the windows of clean documents lie below the bar for toxic windows


@dataclass
class Model:
    weights: np.ndarray   # per bucket: its embedding times the difference of the two class vectors
    bias: float
    slope: np.ndarray     # logistic curve from a document's two highest windows to its score
    offset: float

    def score(self, highest: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(highest @ self.slope + self.offset, -30, 30)))


def words_of(text: str) -> list[str]:
    """Lower-case words without the signs at their ends; words of signs alone go."""
    return [w for w in (part.strip(SIGNS) for part in text.lower().split()) if w]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, window of each n-gram, first window of each text + end)`` over
    all texts; a text without words has no window."""
    parts, n_words = [], []
    for text in texts:
        found = words_of(text)
        n_words.append(len(found))
        if found:
            parts.append(" " + " ".join(found) + " ")
    n_words = np.array(n_words, dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(-(-n_words // WINDOW_WORDS))])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    chars = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = chars == 32
    # number of the word that a character is in, over all texts: a word starts after a space
    start = np.zeros(len(chars), dtype=bool)
    start[1:] = space[:-1] & ~space[1:]
    full = n_words > 0
    words = n_words[full]
    within = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
    share = np.repeat(np.diff(first)[full], words)
    window_of_word = np.repeat(first[:-1][full], words) + within * share // np.repeat(words, words)
    word = np.cumsum(start) - 1
    buckets, windows = [], []
    for n in GRAMS:
        if len(chars) < n:
            continue
        size = len(chars) - n + 1
        mixed = np.full(size, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        inside = np.zeros(size, dtype=bool)
        for i in range(n):
            mixed = (mixed ^ chars[i:i + size]) * np.uint32(0x01000193)
            if 0 < i < n - 1:
                inside |= space[i:i + size]
        at = np.nonzero(~inside)[0]
        mixed = mixed[at]
        mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        buckets.append((mixed >> np.uint32(16)).astype(np.int64) % BUCKETS)
        windows.append(window_of_word[word[at + 1]])
    return np.concatenate(buckets), np.concatenate(windows), first


def _train_windows(ids: list[np.ndarray], target: np.ndarray, rng, embed, out, bias, steps: int) -> None:
    """``steps`` joint gradient steps (at least one pass) on minibatches of
    windows, in place.  Rates fall linearly; a bucket moves with the number of windows that hold it, so rare
    n-grams stay near zero."""
    batches = max(1, len(ids) // BATCH)
    epochs = -(-steps // batches)
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(ids)), batches):
            size = np.array([len(ids[i]) for i in batch])
            bag = np.maximum(size, LEAST_GRAMS)
            flat = np.concatenate([ids[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), size)
            at = np.concatenate([[0], np.cumsum(size)[:-1]])
            mean = np.add.reduceat(embed.take(flat, axis=0), at, axis=0) / bag[:, None]
            logits = mean @ out + bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(batch)), target[batch]] -= 1.0
            grad = prob.astype(np.float32)
            grad_out = mean.T @ grad
            # the two columns of ``grad`` are opposite, so a bucket's gradient is a multiple of one vector
            pull = np.bincount(flat, weights=(grad[:, 1] / bag)[owner], minlength=BUCKETS)
            bucket = np.flatnonzero(np.bincount(flat, minlength=BUCKETS) > 0)
            grad_embed = pull[bucket, None].astype(np.float32) * (out[:, 1] - out[:, 0])
            moved = embed.take(bucket, axis=0) - np.clip(rate * grad_embed, -0.5, 0.5)
            embed[bucket] = moved * np.float32(1 - DECAY * rate)
            out -= np.clip(0.01 * grad_out, -0.1, 0.1)
            bias -= 0.002 * grad.sum(axis=0)


def train(texts: list[str], labels: list[int], seed: int = 1, rounds: int = 3, steps: int = STEPS) -> Model:
    """Fit on labelled texts.  Without both classes every score is the share of toxic ones."""
    label = np.array(labels, dtype=np.int64)
    toxic = label.mean() if len(label) else 0.0
    plain = Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, np.zeros(2), float(np.log((toxic + 1e-3) / (1 - toxic + 1e-3))))
    if not 0 < toxic < 1:
        return plain
    rng = np.random.default_rng(seed)
    ids, doc = [], []
    for i, text in enumerate(texts):
        bucket, window, first = ngrams([text])
        if not first[-1]:
            continue
        order = np.argsort(window, kind="stable")
        cut = np.split(bucket[order].astype(np.int32), np.nonzero(np.diff(window[order]))[0] + 1)
        take = rng.permutation(len(cut))[:MAX_WINDOWS]
        ids += [cut[j] for j in take]
        doc += [i] * len(take)
    if not ids:
        return plain
    doc = np.array(doc)
    half = rng.permutation(len(label))[doc] % 2
    margin = np.zeros(len(ids))
    target = label[doc]
    for turn in range(rounds):
        for part in (0, 1):        # windows are judged by a model that has not seen their document
            weights, bias = _fit_windows([x for x, h in zip(ids, half) if h != part], target[half != part], rng, steps)
            margin[half == part] = [weights[x].sum() / max(len(x), LEAST_GRAMS) + bias for x, h in zip(ids, half) if h == part]
        held, tops = two_highest(margin, doc)
        highest = np.full(len(label), -np.inf)
        highest[held] = tops[:, 0]
        # a toxic document keeps its highest window and those that stand out among the clean documents' windows
        bar = np.quantile(margin[label[doc] == 0], CLEAN_SHARE)
        target = ((label[doc] == 1) & ((margin > bar) | (margin == highest[doc]))).astype(np.int64)
    slope, offset = _logistic(tops, label[held])
    weights, bias = _fit_windows(ids, target, rng, steps)
    return Model(weights.astype(np.float32), bias, slope, offset)


def _fit_windows(ids: list[np.ndarray], target: np.ndarray, rng, steps: int) -> tuple[np.ndarray, float]:
    """Weight of each bucket and bias, of the second class against the first."""
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    if len(ids):
        _train_windows(ids, target, rng, embed, out, bias, steps)
    return embed @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def two_highest(margin: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The owners in order, and the highest and second highest margin of each (of one alone: it, twice)."""
    order = np.lexsort((margin, owner))
    owners, size = np.unique(owner, return_counts=True)
    last = np.cumsum(size) - 1
    return owners, margin[order][np.stack([last, last - (size > 1)], axis=1)]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """Damped Newton fit of ``P(y = 1) = 1 / (1 + exp(-(a x + b)))`` with smoothed
    targets; ``a`` is never negative."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([((x - centre) / scale).T, np.ones((1, len(x)))])
    w = np.array([1.0] * x.shape[1] + [0.0])
    ridge = np.array([1e-2] * x.shape[1] + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w @ z, -30, 30)))
        hess = (z * (p * (1 - p))) @ z.T + np.eye(len(w)) * 1e-2
        w = w + np.clip(np.linalg.solve(hess, z @ (goal - p) - ridge * w), -2, 2)
        w[:-1] = np.maximum(w[:-1], 0.0)
    slope = w[:-1] / scale
    return slope, float(w[-1] - slope @ centre)


def highest_windows(texts: list[str], model: Model) -> np.ndarray:
    """Margins of the two highest windows of each text (no words: those of an empty bag)."""
    bucket, window, first = ngrams(texts)
    out = np.full((len(texts), 2), model.bias, dtype=np.float64)
    if not first[-1]:
        return out
    total = np.bincount(window, weights=model.weights[bucket], minlength=first[-1])
    margin = total / np.maximum(np.bincount(window, minlength=first[-1]), LEAST_GRAMS) + model.bias
    full, out_full = two_highest(margin, np.repeat(np.arange(len(texts)), np.diff(first)))
    out[full] = out_full
    return out


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Train on at most ``max_docs`` labelled documents of each class, in the
    order of a hash of their ids, without those of the held-out fold."""
    known = labels.filter(F.col("toxic").isin(0, 1) & (id_remainder(FOLDS) != HELD_OUT)).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")).filter(F.col("doc_id").isNotNull())
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = [known.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs) for c in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))       # 2 * max_docs rows at most

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        """At most MAX_WINDOWS runs of words of each text, evenly spread."""
        texts = []
        for text in strings(batch, "text"):
            found = words_of(text)
            runs = [found[i:i + WINDOW_WORDS] for i in range(0, len(found), WINDOW_WORDS)]
            step = max(1, -(-len(runs) // MAX_WINDOWS))
            texts.append(" ".join(w for run in runs[::step] for w in run))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("toxic")],
                                          ["doc_id", "text", "toxic"])

    labelled = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_batches(labelled, windows, f"doc_id {kind}, text string, toxic int").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs``.  Null and empty texts get
    the score of an empty bag; repeated rows repeat their score."""
    src = parallel(docs.select("doc_id", "text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        got = m.score(np.concatenate([highest_windows(part, m) for part in _slices(strings(batch, "text"))]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got)], ["doc_id", "score"])

    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")


def _slices(texts: list[str], chars: int = 1 << 19) -> list[list[str]]:
    """Runs of texts of about ``chars`` characters: bounds the arrays made at once."""
    out, size = [[]], 0
    for text in texts:
        if size > chars:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text)
    return out


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_docs))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model.value
        got = m.score(np.concatenate([highest_windows(part, m) for part in _slices(strings(batch, "text"))]))
        return batch.filter(pa.array(got < threshold))

    return map_batches(parallel(docs), run, docs.schema)


def op8_toxicity(spark, sf_dir) -> DataFrame:
    """Contract query: doc_id, held_out, score, predicted."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (id_remainder(FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
