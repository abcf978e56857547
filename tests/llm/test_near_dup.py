import itertools
import random

import numpy as np
import pytest

from querndal.llm.near_dup import least_matches, near_duplicate_pairs
from querndal.llm.tokens import Tokens


def brute(rows, threshold, width=5, least=20):
    sets = {}
    for i, t in rows:
        if t is not None:
            k = Tokens([t.lower()])
            g, _ = k.shingles(width)
            if k.counts()[0] >= least:
                sets[i] = set(g.tolist())
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=3, groups=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(25, 90))]
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i, rows[0][1]), (i + 1, rows[0][1].upper()), (i + 2, None), (i + 3, ""), (i + 4, "too short to count"), (i + 5, " ".join(word() for _ in range(30000)))]
    return rows


@pytest.mark.parametrize("hot", [2048, 3])
def test_equals_brute_force(spark, hot):
    """Both ways of handling a bucket give the pairs of a comparison of all texts."""
    rows = corpus()
    df = spark.createDataFrame([(i, t, t, 7) for i, t in rows], "ord bigint, docs string, text string, id int")
    got = [tuple(r) for r in near_duplicate_pairs(df, "ord", "docs", threshold=0.6, hot=hot, block=4).collect()]
    assert len(got) == len(set(got))
    want = brute(rows, 0.6)
    assert set(got) <= want and len(want - set(got)) <= 0.01 * len(want)


def test_one_group_of_a_third_of_all_rows(spark):
    """Different texts of one template: all share buckets, all are pairs, and none is lost."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:100] + [f"x{k}"] + base[100:])) for k in range(60)] + [(100 + k, " ".join(f"{rng.random():.6f}" for _ in range(30))) for k in range(120)]
    df = spark.createDataFrame(rows, "ord bigint, docs string")
    got = {tuple(r) for r in near_duplicate_pairs(df, "ord", "docs", threshold=0.6, hot=20, block=16).collect()}
    assert got == {(a, b) for a in range(60) for b in range(a + 1, 60)}


def test_empty_table(spark):
    assert near_duplicate_pairs(spark.createDataFrame([], "ord bigint, docs string"), "ord", "docs").count() == 0


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(0)
    table = least_matches(0.6, 1e-4)
    assert list(table) == sorted(table) and table[-1] < 0.6 * 96
    lost = 0
    for _ in range(2000):
        m = np.cumsum(rng.random(96) < 0.6)[15::16]
        lost += (m < np.array(table)).any()
    assert lost <= 20
