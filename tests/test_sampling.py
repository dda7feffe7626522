import pytest
from pyspark.sql import functions as F

from linearspark.operators import sampling as SP


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(0, 5000).select(F.col("id"), (F.col("id") % 3).cast("int").alias("y"))


def test_exact_size_repeatable(spark, ids):
    a = SP.sample_exact(ids, 123, seed=4, step=2)
    b = SP.sample_exact(ids, 123, seed=4, step=2)
    assert a.count() == 123
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect())
    c = SP.sample_exact(ids, 123, seed=4, step=3)
    assert sorted(r.id for r in a.collect()) != sorted(r.id for r in c.collect())


def test_sample_too_large(spark, ids):
    with pytest.raises(SP.SampleTooLarge):
        SP.sample_exact(ids, 5001, seed=1)


def test_histogram_equals_topk(spark, ids):
    h = SP.with_hash(ids, 9, 0)
    top = {r.id for r in h.orderBy("_h", "id").limit(777).collect()}
    assert SP.balanced_bits(10 ** 11) == 19 and SP.balanced_bits(5000) == 16
    for bits in (4, 8, 16, 21):
        hist = {r.id for r in SP.flag_first_n(h, 777, bits=bits).filter("_in").collect()}
        assert hist == top


def test_split_disjoint_complete(spark, ids):
    s = SP.ratio_split(ids, 0.9, seed=1)
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts == {"train": 4500, "test": 500}
    assert s.select("id").distinct().count() == 5000


def test_group_samples(spark, ids):
    g = SP.group_samples(ids, 50, seed=2, groups=4)
    sizes = {r["worker"]: r["count"] for r in g.groupBy("worker").count().collect()}
    assert sizes == {0: 50, 1: 50, 2: 50, 3: 50}
    assert g.select("worker", "id").distinct().count() == 200


def test_holdout(spark, ids):
    val = SP.holdout_ids(ids, 0.1, seed=7)
    train, v = SP.holdout_split(ids, val)
    assert (train.count(), v.count()) == (4500, 500)
    assert train.join(v, "id").count() == 0


def test_prefilter_topk_exact(spark, ids):
    h = SP.with_hash(ids, 3, 1)
    plain = {r.id for r in h.orderBy("_h", "id").limit(123).collect()}
    assert {r.id for r in SP.top_n(h, 123, 5000).collect()} == plain
    assert SP.candidates(h, 123, 5000).count() < 1000          # far fewer rows reach the merge
    g1 = SP.group_samples(ids, 40, seed=2, groups=3)
    g2 = SP.group_samples(ids, 40, seed=2, groups=3, n_rows=5000)
    assert sorted(map(tuple, g1.collect())) == sorted(map(tuple, g2.collect()))


def test_group_samples_fallback_is_exact(spark, ids):
    """Force the short-candidate path: the histogram cutoff gives the same rows."""
    a = SP.group_samples(ids, 60, seed=4, groups=3, n_rows=5000)
    b = SP.group_samples(ids, 60, seed=4, groups=3, n_rows=10 ** 9)   # threshold far too low -> fallback
    c = SP.group_samples(ids, 60, seed=4, groups=40)                   # many groups: histogram path
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {g: n for g, n in c.groupBy("worker").count().collect()} == {g: 60 for g in range(40)}
    with pytest.raises(SP.SampleTooLarge):
        SP.group_samples(ids, 6000, seed=1, groups=2)


def test_duplicate_ids(spark, ids):
    assert SP.duplicate_ids(ids) == 0
    assert SP.duplicate_ids(ids.unionByName(ids.limit(3))) == 3
