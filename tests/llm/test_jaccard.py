"""Jaccard join against all pairs, in plain Python."""

import random

import pytest

from linearspark.llm import jaccard as J
from linearspark.session import materialize

from .conftest import SF


def shingles(text, k=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()


def all_pairs(rows, percent=85):
    """``(doc_id, size, smallest id reachable)`` by comparing every pair of texts."""
    texts = list({t for _, t in rows})
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for w in s:
            by.setdefault(w, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for w in s for j in by[w] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for doc_id, t in rows:
        c = find(texts.index(t))
        if sets[texts.index(t)] and doc_id is not None:
            least[c] = min(least.get(c, doc_id), doc_id)
    return sorted((repr(d), len(sets[texts.index(t)]), repr(least.get(find(texts.index(t))) if sets[texts.index(t)] else d)) for d, t in rows)


def got(docs):
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in J.similar_documents(docs).collect())


def test_odd_documents(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert got(odd_docs) == all_pairs(rows)


def test_empty_table(no_docs):
    assert got(no_docs) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_around_the_threshold(spark, seed):
    """Copies with every rate of change, common passages, subsets, short texts."""
    dice = random.Random(seed)
    word = lambda: f"w{dice.randrange(4000)}"
    passages = [[word() for _ in range(40)] for _ in range(3)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(dice.choice([3, 4, 5, 9, 30, 60, 200]))] + dice.choice(passages)[:dice.choice([0, 10, 40])]
        for _ in range(dice.choice([1, 4, 40])):
            own = list(base)
            for _ in range(dice.randint(0, 1 + len(own) // 40)):
                at = dice.randrange(len(own))
                own[at:at + dice.randint(0, 1)] = [word()] * dice.randint(0, 2)
            texts.append(" ".join(own))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(docs) == all_pairs(rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == all_pairs(rows)


def test_prefix_bounds():
    for n in range(1, 400):
        assert J.prefix_size(n) == n - -(-85 * n // 100) + 1
        assert J.index_size(n) == n - -(-170 * n // 185) + 1


def test_small_buckets_are_joined_once(spark, monkeypatch):
    """Sets that share tokens by twos and threes never enter the rounds; a large group does."""
    dice = random.Random(3)
    rounds = []

    def kept(df, name="cut"):
        df = materialize(df, name)
        if name == "named-postings":
            rounds.append(df.select("sid").distinct().count())
        return df

    def near(base, n):
        texts = []
        for i in range(n):
            own = list(base)
            own[dice.randrange(len(own))] = f"x{dice.random()}"
            texts.append(" ".join(own))
        return texts

    monkeypatch.setattr(J, "materialize", kept)
    base = lambda: [f"w{dice.random()}" for _ in range(80)]
    texts = [t for _ in range(60) for t in near(base(), dice.choice([2, 3]))]
    rows = list(enumerate(texts))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == all_pairs(rows)
    assert rounds == []
    rows += [(len(rows) + i, t) for i, t in enumerate(near(base(), 30))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == all_pairs(rows)
    assert rounds and max(rounds) <= 30
