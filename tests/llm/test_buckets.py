import itertools
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from querndal.llm.buckets import cool_pairs, hot_keys, meeting_pairs
from querndal.llm.near_dup import near_duplicate_pairs
from querndal.llm.similar_vectors import scheme, similar_pairs, unit


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def rows_of(sizes):
    return [(key, 1000 * key + i, i) for key, n in sizes.items() for i in range(n)]


def test_over_full_keys_are_handed_on_whole(spark, small_batches):
    """Over many small batches: a key is either paired in full or handed on in full."""
    sizes = {1: 1, 2: 5, 3: 30, 4: 6, 5: 100, 6: 2, 7: 7, 8: 8}
    df = spark.createDataFrame(rows_of(sizes), "key bigint, id bigint, s bigint")
    got = cool_pairs(df, None, 6).collect()
    full = defaultdict(list)
    for r in got:
        if r.b is None:
            full[r.key].append(r.a)
    assert {k: len(set(v)) for k, v in full.items()} == {k: n for k, n in sizes.items() if n > 6} and all(len(v) == len(set(v)) for v in full.values())
    pairs = Counter((r.a, r.b) for r in got if r.b is not None)
    assert set(pairs.values()) == {1} and set(pairs) == {(1000 * k + i, 1000 * k + j) for k, n in sizes.items() if n <= 6 for i, j in itertools.combinations(range(n), 2)}


@pytest.mark.parametrize("finer_from", [0, 20, 100])
def test_every_level_keeps_all_pairs_of_equal_finer_keys(spark, finer_from):
    """Finer keys that split nothing end in blocks; no pair is lost or repeated."""
    df = spark.createDataFrame(rows_of({1: 40, 2: 3, 3: 15}), "key bigint, id bigint, s bigint")

    def verify(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        p, q = left["id"].to_numpy(), right["id"].to_numpy()
        i, j = np.nonzero(np.triu(np.ones((len(p), len(q))), 1) if same else np.ones((len(p), len(q))))
        return pd.DataFrame({"a": np.minimum(p[i], q[j]), "b": np.maximum(p[i], q[j])})

    always = lambda a, b: np.ones(len(a), bool)
    got = [tuple(r) for r in meeting_pairs(df, df.select("id"), always, lambda hot: hot.selectExpr("key", "id", "0L as s"), verify, 10, 4, finer_from).collect()]
    assert len(got) == len(set(got)) and set(got) == {(1000 * k + i, 1000 * k + j) for k, n in ((1, 40), (2, 3), (3, 15)) for i, j in itertools.combinations(range(n), 2)}


def test_all_hot_keys_are_found(spark):
    """More hot keys than a short list would hold, all above the bound, beside many single rows."""
    df = spark.range(1_200 * 60).selectExpr("id % 1200 as key").unionAll(spark.range(100_000, 110_000).selectExpr("id as key"))
    assert sorted(hot_keys(df, 50)) == list(range(1200))


def test_copies_fill_no_buckets(spark):
    """Many texts of many copies beside a family of near-duplicates in a hot band: copies are one row to pair, and the family is found whole."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(30))
    rows = [(100 * k + c, text(k)) for k in range(30) for c in range(40)]
    base = [f"f{i}" for i in range(80)]
    rows += [(10_000 + k, " ".join([*base[:40], f"x{k}", *base[40:]])) for k in range(30)]
    df = spark.createDataFrame(rows, "ord bigint, docs string")
    got = {tuple(r) for r in near_duplicate_pairs(df, "ord", "docs", threshold=0.6, hot=25, block=8).collect()}
    want = {(100 * k + i, 100 * k + j) for k in range(30) for i, j in itertools.combinations(range(40), 2)} | {(10_000 + i, 10_000 + j) for i, j in itertools.combinations(range(30), 2)}
    assert got == want


def test_a_third_of_all_rows_in_one_dense_cluster(spark):
    """Different vectors, all at about 0.93 from each other, beside unrelated ones: found by blocks, with nearly full recall."""
    rng = np.random.default_rng(0)
    center = rng.standard_normal(64)
    x = np.concatenate([center + rng.standard_normal((600, 64)) * 0.25, rng.standard_normal((1200, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "ord bigint, embeds array<float>")
    got = {tuple(r) for r in similar_pairs(df, "ord", "embeds", 64, hot=100, block=64).collect()}
    s = np.round(unit(x[:600].ravel(), 64) @ unit(x[:600].ravel(), 64).T, 6)
    np.fill_diagonal(s, -1)
    want = {(min(i, j), max(i, j)) for i in range(600) for j in np.argsort(-s[i], kind="stable")[:5].tolist() if s[i, j] >= 0.9}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_the_scheme_grows_with_the_rows():
    sizes = [scheme(n) for n in (0, 1000, 200_000, 2_000_000, 200_000_000)]
    assert sizes[0] == sizes[1] == sizes[2] and sizes == sorted(sizes) and sizes[4][0] < 60
