import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from querndal.operators import fuse, rag
from querndal.operators import retrieve as R
from querndal.operators.evals import lcs, rouge_l


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    x[7] = x[3]
    x[9] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)]
    df = spark.createDataFrame(rows, "ord bigint, vector array<float>").repartition(3).cache()
    q = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 3, 20)], "query_id bigint, vector array<float>")
    return x.astype(float), df, q


def test_nearest(vectors):
    x, df, q = vectors
    got = {}
    for r in R.nearest(df, q, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.ord, r.score))
        assert 0 <= r.score_norm <= 1
    for i, rows in got.items():
        with np.errstate(invalid="ignore"):
            s = np.round(x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i]), 6)
        want = sorted((j for j in range(60) if j != 9), key=lambda j: (-s[j], j))[:5]
        assert [o for _, o, _ in sorted(rows)] == want
    assert R.nearest(df.limit(0), q, 5).count() == 0 and R.nearest(df, q.limit(0), 5).count() == 0
    l2 = R.nearest(df, q, 1, "l2").collect()
    assert {(r.query_id, r.ord, r.score) for r in l2} == {(0, 0, 1.0), (3, 3, 1.0), (20, 20, 1.0)}


def test_marginal_relevance(vectors):
    x, df, q = vectors
    pool = df.where("ord < 30 and ord <> 9").crossJoin(q.withColumnRenamed("vector", "query_vector"))
    plain = {(r.query_id, r["rank"]): r.ord for r in R.nearest(df.where("ord < 30"), q, 4).collect()}
    one = {(r.query_id, r["rank"]): r.ord for r in R.marginal_relevance(pool, 4, weight=1.0).collect()}
    assert one == plain
    every = R.marginal_relevance(pool, 99).where("query_id = 3").collect()
    assert sorted(r.ord for r in every) == [i for i in range(30) if i != 9]


def test_mmr_and_custom_functions_see_every_row(spark):
    x = np.random.default_rng(1).standard_normal((300, 8)).astype(np.float32)
    chunks = spark.createDataFrame([(i, f"text {i}", v.tolist()) for i, v in enumerate(x)] + [(300, "zero", [0.0] * 8), (301, "none", None)], "ord bigint, text string, vector array<float>").repartition(3).cache()
    q = chunks.where("ord in (0, 3, 20)").select(F.col("ord").alias("query_id"), "text", "vector")
    places = lambda df: {(r.query_id, r.place): r.ord for r in df.collect()}
    pool = chunks.where("ord < 300").crossJoin(q.select("query_id", F.col("vector").alias("query_vector")))
    assert places(rag.search(chunks, q, "mmr", 5)) == {(r.query_id, r["rank"]): r.ord for r in R.marginal_relevance(pool, 5).collect()}
    assert R.mmr(chunks.where("ord < 3"), q, 9).count() == 9 and R.mmr(chunks.limit(0), q, 3).count() == 0 and R.mmr(chunks, q.limit(0), 3).count() == 0
    far = lambda v, m, k: list(np.argsort(-((m - v) ** 2).sum(1), kind="stable")[:k])
    every = np.vstack([x, np.zeros((1, 8))]).astype(float)
    assert places(rag.search(chunks, q, far, 4)) == {(i, n + 1): o for i in (0, 3, 20) for n, o in enumerate(far(every[i], every, 4))}
    assert R.custom(chunks.limit(0), q, far, 3).count() == 0 and R.custom(chunks, q.limit(0), far, 3).count() == 0


def test_auto_rerank_takes_all_rows_within_the_threshold(spark):
    near = [[1.0, 0.001 * i] for i in range(25)]
    rows = [(i, f"other {i}", v) for i, v in enumerate(near + [[-1.0, 0.1]] * 175)]
    rows[24] = (24, "asked words", near[24])
    chunks = spark.createDataFrame(rows, "ord bigint, text string, vector array<float>")
    q = spark.createDataFrame([(0, "asked words", [1.0, 0.0])], "query_id bigint, text string, vector array<float>")
    out = rag.search(chunks, q, "auto_rerank", 4).orderBy("place").collect()
    assert [r.ord for r in out] == [24, *range(24)]
    more = chunks.unionByName(chunks.where("ord > 124").withColumns({"ord": F.col("ord") + 200, "text": F.concat("text", F.lit(" more"))}))
    assert [r.ord for r in rag.search(more, q, "auto_rerank", 4).orderBy("place").collect()][0] == 0


def test_svm_ranks_the_query_first(vectors):
    _, df, q = vectors
    rows = R.exemplar_svm(df.where("ord <> 7"), q, 3).collect()
    assert {(r.query_id, r.ord) for r in rows if r["rank"] == 1} == {(0, 0), (3, 3), (20, 20)}
    assert all(0 <= r.score_norm <= 1 for r in rows)


def test_svm_takes_any_number_of_queries(vectors, monkeypatch):
    _, df, q = vectors
    few = {tuple(r) for r in R.exemplar_svm(df, q, 3).collect()}
    many = q.sparkSession.range(300).join(q.where("query_id = 20").select("vector")).select(F.col("id").alias("query_id"), "vector")
    rows = R.exemplar_svm(df, many, 1).collect()
    assert {r.query_id for r in rows} == set(range(300)) and {r.ord for r in rows} == {20}
    monkeypatch.setattr(R, "SVM_SLICE", 1)
    assert {tuple(r) for r in R.exemplar_svm(df, q, 3).collect()} == few


def test_bm25_and_tfidf(spark):
    texts = ["the cat sat", "the cat the cat", "a dog", "", "the dog sat on the cat mat"]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "ord bigint, text string")
    queries = spark.createDataFrame([(1, "cat sat"), (2, "zebra"), (3, None)], "query_id bigint, text string")
    words = [t.split() for t in texts]
    n, avg = len(words), np.mean([len(w) for w in words])
    df = Counter(t for w in words for t in set(w))
    idf = {t: math.log((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    floor = 0.25 * np.mean(list(idf.values()))
    score = [sum((idf[t] if idf[t] >= 0 else floor) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in ("cat", "sat")) for w in words]
    got = {r.ord: r.score for r in R.lexical(docs, queries, 10).collect()}
    assert set(got) == {0, 1, 4} and all(abs(got[o] - score[o]) < 1e-5 for o in got)
    tfidf = R.lexical(docs, queries, 10, "tfidf").collect()
    assert [r.ord for r in sorted(tfidf, key=lambda r: r["rank"])][0] == 0 and all(0 <= r.score <= 1 for r in tfidf)
    assert R.lexical(docs.limit(0), queries, 3).count() == 0


def test_dispatch():
    assert R.retrievers("MERGE") == ("mmr", "svm", "tfidf") and R.retrievers("rerank:Some/Model") == ("rerank:Some/Model",)
    with pytest.raises(ValueError):
        R.retrievers("nothing")


def test_rerank(spark):
    pool = spark.createDataFrame([(1, "a b", 0, "b"), (1, "a b", 1, "a b c"), (1, "a b", 2, "z")], "query_id bigint, query string, ord bigint, text string")
    assert [(r.ord, r["rank"]) for r in R.rerank(pool, R.overlap_scorer, 0.4).orderBy("rank").collect()] == [(1, 1), (0, 2)]


def test_fusion_under_a_budget(spark):
    rows = [(1, 0, 1, 0, "one two"), (1, 0, 2, 1, "shared doc"), (1, 1, 1, 2, "shared doc"), (1, 1, 2, 3, "three four five")]
    ranked = spark.createDataFrame(rows, "query_id bigint, retriever_idx int, rank int, ord bigint, text string")
    out = fuse.round_robin(ranked, 4).orderBy("place").collect()
    assert [r.text for r in out] == ["one two", "shared doc"] and out[-1].total_words == 4
    assert [r.text for r in fuse.concatenated(ranked, 2).orderBy("place").collect()] == ["one two", "shared doc"]


def test_auto_puts_strong_words_first(spark):
    schema = "query_id bigint, ord bigint, score double, rank int, text string"
    knn = spark.createDataFrame([(1, 0, 0.9, 1, "a"), (1, 1, 0.8, 2, "b"), (1, 2, 0.7, 3, "c")], schema)
    bm25 = spark.createDataFrame([(1, 2, 80.0, 1, "c"), (1, 1, 71.0, 2, "b"), (1, 0, 70.5, 3, "a")], schema)
    assert [r.text for r in fuse.auto(knn, bm25, 99).orderBy("place").collect()] == ["c", "b", "a"]


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_rouge():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.choice(list("abcd"), rng.integers(0, 30)).tolist() for _ in range(2))
        assert lcs(a, b) == slow_lcs(a, b)
    assert rouge_l("the cat", "The cat") == 1.0 and rouge_l(None, "x") == 0.0 and rouge_l("這是書", "這是筆") == pytest.approx(0.667)
    assert isinstance(pd.Series([rouge_l("a", "b")])[0], float)
