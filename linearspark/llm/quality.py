"""Quality rules: a decision list learned from labelled text statistics.

Sequential covering in the manner of IREP: grow a conjunction of thresholds by
information gain on two thirds of the labelled rows, prune its last conditions
on the other third, keep it while it is precise there, drop the rows it covers
and go on.  The list becomes one ordered Spark conditional expression over
columns of statistics, evaluated on every document inside the JVM.

The rules are fitted on a bounded sample (``MAX_LABELLED`` labelled rows); the
statistics cover the whole text of every document.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linearspark.llm.common import map_batches, parallel, read_table, text_hash, utf8
from linearspark.session import materialize

MAX_LABELLED = 20_000
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
MAX_CONDITIONS, MAX_RULES = 4, 12
MIN_PRECISION = 0.8
CUTS = 48                       # candidate thresholds per statistic and condition

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper",
          "n_distinct", "n_long", "n_ends", "n_bytes")


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that the text has twice or more."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    count = Counter(grams)
    covered, last = 0, 0
    for i, gram in enumerate(grams):
        if count[gram] > 1:
            covered += i + window - max(i, last)
            last = i + window
    return covered


def text_counts(text: bytes) -> tuple[int, ...]:
    """The counts of ``COUNTS`` for one text."""
    words = text.split()
    seen, dup, n_lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            n_lines += 1
            dup += line in seen
            seen.add(line)
    return (len(words), len(b"".join(words).decode("utf-8")), len(text) - len(text.translate(None, SYMBOLS)), dup,
            repeat_words(words), n_lines, len(text) - len(text.translate(None, b"0123456789")),
            len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), len(set(words)),
            sum(len(w) > 20 for w in words), sum(text.count(c) for c in (b".", b"!", b"?")), len(text))


def statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, th, counts...)`` for every row; a null text counts as empty."""
    src = parallel(docs).select("doc_id", text_hash().alias("th"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.array([text_counts(t) for t in utf8(batch, "text")], dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("th"), *(pa.array(rows[:, i].copy()) for i in range(len(COUNTS)))],
            ["doc_id", "th", *COUNTS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(src, run, f"doc_id {kind}, th long, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """The statistics that conditions test, from the count columns; never null."""
    def per(a: str, b: str) -> Column:
        return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1))

    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": per("word_chars", "n_words"),
        "symbols_per_word": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "words_per_line": per("n_words", "n_lines"),
        "digit_share": per("n_digits", "n_bytes"),
        "upper_share": per("n_upper", "n_bytes"),
        "distinct_share": per("n_distinct", "n_words"),
        "long_share": per("n_long", "n_words"),
        "ends_per_word": per("n_ends", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] < self.threshold

    def column(self, columns: dict[str, Column]) -> Column:
        c = columns[self.feature]
        return c >= F.lit(self.threshold) if self.at_least else c < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), dtype=bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the threshold of the highest information gain until the rule is pure."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < MAX_CONDITIONS and bad[inside].sum() and not bad[inside].all():
        base = np.log2(bad[inside].mean())
        best = (1e-9, None)
        for name, values in x.items():
            cuts = np.unique(np.quantile(values[inside], np.linspace(0, 1, CUTS + 2)[1:-1]))
            cuts = np.unique(np.concatenate([cuts, np.quantile(values[inside & bad], (0.02, 0.1, 0.9, 0.98))]))
            above = values[inside][:, None] >= cuts
            p_up, n_up = above[bad[inside]].sum(axis=0), above.sum(axis=0)
            p_all, n_all = bad[inside].sum(), inside.sum()
            for at_least, p, n in ((True, p_up, n_up), (False, p_all - p_up, n_all - n_up)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(n, 1)) - base), 0)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], Condition(name, at_least, float(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def _worth(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    got = covers(rule, x)
    p, n = bad[got].sum(), (~bad[got]).sum()
    return (p - n) / max(p + n, 1)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 1) -> list[Rule]:
    """Ordered rules for ``bad`` rows.  Without rows of both kinds there are none."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    rng = np.random.default_rng(seed)
    for _ in range(MAX_RULES):
        if not bad[left].any() or bad[left].all():
            break
        prune = rng.random(len(bad)) < 1 / 3
        grow_x, grow_bad = {k: v[left & ~prune] for k, v in x.items()}, bad[left & ~prune]
        prune_x, prune_bad = {k: v[left & prune] for k, v in x.items()}, bad[left & prune]
        rule = _grow(grow_x, grow_bad)
        while len(rule) > 1 and _worth(rule[:-1], prune_x, prune_bad) >= _worth(rule, prune_x, prune_bad):
            rule = rule[:-1]
        got = covers(rule, prune_x) if rule else np.zeros(0, dtype=bool)
        if not got.sum() or prune_bad[got].mean() < MIN_PRECISION:
            break
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def decision(rules: list[Rule]) -> Column:
    """The list as an ordered conditional: false for the first rule that holds, else true."""
    columns = features()
    out = None
    for rule in rules:
        hold = rule[0].column(columns)
        for condition in rule[1:]:
            hold = hold & condition.column(columns)
        out = F.when(hold, F.lit(False)) if out is None else out.when(hold, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn from at most ``max_labelled`` labelled documents, in the order of a
    hash of their ids (labels other than 0 and 1, and null ids, are left out)."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    columns = features()
    rows = stats.join(known, "doc_id").select("doc_id", "quality", *[c.alias(f"f_{k}") for k, c in columns.items()])
    first = lambda df: df.orderBy(F.xxhash64("doc_id"), *df.columns).limit(max_labelled).collect()
    n = rows.count()
    share = (max_labelled + 8 * max_labelled ** 0.5) / max(n, 1)
    # hashes below the bound hold about max_labelled rows, so the tasks together send few more than are kept
    got = first(rows.filter(F.xxhash64("doc_id") < int(-2 ** 63 + 2 ** 64 * share))) if share < 1 else []
    rows = got if len(got) == max_labelled else first(rows)
    table = np.array([r[2:] for r in rows], dtype=np.float64).reshape(len(rows), len(columns))
    return learn({k: table[:, i] for i, k in enumerate(columns)}, np.array([r["quality"] == 0 for r in rows], dtype=bool))


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, th, counts..., base_failed, kept)`` for every row of ``docs``.

    A null or empty text has no words and fails the base.  Without labels of
    both kinds the list is empty and the base alone decides.  Repeated rows
    repeat their result; other columns are ignored.
    """
    stats = materialize(statistics(docs), "statistics")
    rules = fit(stats, labels, max_labelled)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & decision(rules))


def op2_quality_rules(spark, sf_dir) -> DataFrame:
    """Contract query: doc_id, the five counts, base_failed, kept."""
    found = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
