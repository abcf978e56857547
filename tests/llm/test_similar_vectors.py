import numpy as np
import pytest

from querndal.llm.similar_vectors import crossing_order, similar_pairs, similar_vectors, unit


def brute(ids, x, k, least):
    s = np.round(unit(x.ravel(), x.shape[1]) @ unit(x.ravel(), x.shape[1]).T, 6)
    out = set()
    for i in range(len(ids)):
        others = [j for j in range(len(ids)) if j != i]
        for j in sorted(others, key=lambda j: (-s[i, j], ids[j]))[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def clustered(seed=0, groups=60):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        c = rng.standard_normal(64)
        for _ in range(rng.integers(1, 8)):
            rows.append((c + rng.standard_normal(64) * rng.uniform(0.05, 0.45)) * rng.uniform(0.1, 9))
    rows += [rows[0], rows[0] * 2, rows[5]]
    return np.array(rows, np.float32)


@pytest.mark.parametrize("hot", [2048, 3])
def test_recall_against_brute_force(spark, hot):
    x = clustered()
    ids = list(range(0, 3 * len(x), 3))
    rows = [(i, v.tolist(), [0.0]) for i, v in zip(ids, x, strict=True)] + [(1, None, None), (2, [], None), (4, [1.0] * 48, None), (5, [0.0] * 64, None), (7, [float("nan")] * 64, None), (8, [float("inf")] + [1.0] * 63, None), (10, [None] + [1.0] * 63, None)]
    df = spark.createDataFrame(rows, "ord bigint, embeds array<float>, v array<double>")
    got = {tuple(r) for r in similar_pairs(df, "ord", "embeds", 64, hot=hot, block=8).collect()}
    want = brute(ids, x, 5, 0.9)
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(want)


def test_a_third_of_all_rows_holds_one_vector(spark):
    """Each copy has the five smallest other ids as neighbours."""
    rng = np.random.default_rng(1)
    one = rng.standard_normal(64)
    rows = [(i, one.tolist()) for i in range(40)] + [(100 + i, rng.standard_normal(64).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "ord bigint, embeds array<float>")
    got = {}
    for r in similar_vectors(df, "ord", "embeds", 64).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert set(got) == set(range(40))
    for i, near in got.items():
        assert [n for _, n in sorted(near)] == [j for j in range(7) if j != i][:5]


def test_empty_table(spark):
    assert similar_pairs(spark.createDataFrame([], "ord bigint, embeds array<float>"), "ord", "embeds", 64).count() == 0


def test_crossing_order():
    order = crossing_order(8, 40)
    assert order[0] == () and order[1] == (0,) and len(set(order)) == 40
    assert all(15 - x not in s for s in order for x in s)
