"""Retrievers: a stated query set against all chunks, each giving (query_id, ord, score, rank).

Chunks are scored where they lie: each task scores its batches against the queries and keeps a running list of the k best a query, so
that only k rows a query and task are shuffled. The query set is broadcast in slices of at most ``SLICE`` queries, or of words, one pass a slice.
Ties go to the smaller ``ord`` after scores are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..runtime import cut
from .aggregates import top_by

#: Most queries, and most distinct query words, of one broadcast.
SLICE, WORDS = 2048, 200_000
#: Most queries whose SVMs are solved together.
SVM_SLICE = 256
#: Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25


def _slices(queries: DataFrame, columns: list[str], size: int = SLICE) -> Iterator[list]:
    n = max(1, -(-queries.count() // size))
    for i in range(n):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else queries
        if rows := part.select("query_id", *columns).orderBy("query_id").collect():
            yield rows


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k best rows of each column, ties by ascending id; NaN never counts."""
    s = np.where(np.isnan(scores), -np.inf, scores)
    if len(s) > k:
        least = -np.partition(-s, k - 1, axis=0)[k - 1]
        row, col = np.nonzero((s >= least) & (s > -np.inf))
    else:
        row, col = np.nonzero(s > -np.inf)
    order = np.lexsort((ids[row], -s[row, col], col))
    row, col = row[order], col[order]
    first = np.searchsorted(col, col)
    keep = np.arange(len(col)) - first < k
    return row[keep], col[keep]


class Best:
    """The k best rows of each of ``n`` queries over all batches of a task; ties by ascending id."""

    def __init__(self, k: int, n: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.col, self.ids, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.lo, self.hi = np.full(n, np.inf), np.full(n, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of a batch (rows by queries); NaN never counts."""
        if not len(scores):
            return
        some = ~np.isnan(scores)
        self.lo = np.minimum(self.lo, np.where(some, scores, np.inf).min(0))
        self.hi = np.maximum(self.hi, np.where(some, scores, -np.inf).max(0))
        with np.errstate(invalid="ignore"):
            row, col = best_rows(np.where(scores >= self.least, scores, np.nan), ids, self.k)
        self.put(col, ids[row], scores[row, col])

    def put(self, col: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        col, ids, score = np.concatenate([self.col, col]), np.concatenate([self.ids, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, col))
        place = np.arange(len(order)) - np.searchsorted(col[order], col[order])
        kept = order[place < self.k]
        self.col, self.ids, self.score = col[kept], ids[kept], score[kept]
        full = order[place == self.k - 1]
        self.least[col[full]] = score[full]


def _merge(parts: list[DataFrame], k: int) -> DataFrame:
    return top_by(reduce(DataFrame.unionAll, parts), "query_id", k)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", dim: int | None = None) -> DataFrame:
    """k nearest chunks ``(ord, vector)`` of each query ``(query_id, vector)`` by ``cosine`` or ``l2`` (score 1 / (1 + squared distance)).

    ``score_norm`` scales a query's scores over all chunks to [0, 1]. Null vectors and zero vectors (for cosine) are never found.
    """
    found = []
    for rows in _slices(queries.where("vector is not null"), ["vector"]):
        q = np.array([r[1] for r in rows], np.float64)
        ids = np.array([r[0] for r in rows], np.int64)
        shared = chunks.sparkSession.sparkContext.broadcast((q, ids))
        width = q.shape[1] if dim is None else dim

        def score(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
            q, ids = shared.value
            best = Best(k, len(q))
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = q / np.linalg.norm(q, axis=1, keepdims=True)
                for order, v in _matrices(batches, width, 4096):
                    if metric == "cosine":
                        s = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ unit.T
                    else:
                        s = 1 / (1 + np.maximum((v * v).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * v @ q.T, 0))
                    best.add(np.round(s, 6), order)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[best.col], best.ids, best.score, best.lo[best.col], best.hi[best.col])], ["query_id", "ord", "score", "lo", "hi"])

        sized = chunks.select(F.col("ord").cast("bigint"), F.col("vector")).where(F.col("vector").isNotNull() & (F.size("vector") == width))
        found.append(sized.mapInArrow(score, "query_id bigint, ord bigint, score double, lo double, hi double"))
    if not found:
        return chunks.sparkSession.createDataFrame([], "query_id bigint, ord bigint, score double, score_norm double, rank int")
    every = reduce(DataFrame.unionAll, found)
    bounds = every.groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    scaled = (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(1e-6))
    return top_by(every.select("query_id", "ord", "score"), "query_id", k).join(bounds, "query_id").select("query_id", "ord", "score", F.round(scaled, 6).alias("score_norm"), "rank")


def document_frequency(docs: DataFrame, words: str = "words") -> DataFrame:
    """Number of documents that hold each word."""
    return docs.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def lexical(docs: DataFrame, queries: DataFrame, k: int, scheme: str = "bm25", tokenizer: Callable = tokens) -> DataFrame:
    """k best documents ``(ord, text)`` of each query ``(query_id, text)`` by ``bm25`` or ``tfidf``; documents without a common word are never found.

    BM25 (Okapi): idf ln((N - df + 0.5) / (df + 0.5)), negative ones replaced by 0.25 times the mean idf of all words. TF-IDF: words of two
    or more letters, idf ln((1 + N) / (1 + df)) + 1, cosine of the weighted counts.
    """
    spark = docs.sparkSession
    split = (lambda c: F.filter(tokenizer(c), lambda w: F.char_length(w) >= 2)) if scheme == "tfidf" else tokenizer
    worded = docs.select(F.col("ord").cast("bigint").alias("ord"), split(F.col("text")).alias("words")).where(F.col("words").isNotNull())
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), split(F.col("text")).alias("words")).where(F.size("words") > 0)
    # One pass counts each word's documents and, under a word that no text holds, the documents and their words.
    every = F.concat(F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("term"), F.lit(0).alias("length"))), F.array(F.struct(F.lit("\n").alias("term"), F.size("words").alias("length"))))
    counted = cut(worded.select(F.explode(every).alias("x")).groupBy("x.term").agg(F.count(F.lit(1)).alias("df"), F.sum("x.length").alias("length")))
    whole = counted.where(F.col("term") == "\n").first()
    n, length = (whole["df"], whole["length"] / whole["df"]) if whole else (0, 0.0)
    df = counted.where(F.col("term") != "\n").select("term", "df")
    if scheme == "bm25":
        idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        floor = EPSILON * (df.agg(F.avg(idf)).first()[0] or 0.0) if n else 0.0
        weight = F.when(idf < 0, F.lit(floor)).otherwise(idf)
    else:
        weight = F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1
    weighted = df.select("term", weight.alias("weight"))
    if scheme == "tfidf":
        counts = worded.select("ord", F.explode("words").alias("term")).groupBy("ord", "term").agg(F.count(F.lit(1)).alias("tf"))
        norms = counts.join(weighted, "term").groupBy("ord").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("weight"), 2))).alias("scale"))
        worded = worded.join(norms, "ord")
    else:
        worded = worded.withColumn("scale", F.lit(1.0))
    terms = asked.select(F.explode("words").alias("term")).distinct()
    known = cut(weighted.join(terms, "term"))
    n_words = known.count()
    found = [
        _lexical_slice(worded, table, rows, k, scheme, length)
        for rows in _slices(asked, ["words"], SLICE if n_words <= WORDS else max(1, SLICE * WORDS // n_words))
        if (table := _weights_of(known, rows, n_words))
    ]
    if not found:
        return spark.createDataFrame([], "query_id bigint, ord bigint, score double, rank int")
    return _merge(found, k)


def _weights_of(known: DataFrame, rows: list, n_words: int) -> dict[str, float]:
    """Weights of the words of some queries: all of ``known`` where they are few, else those of these queries by a join."""
    if n_words > WORDS:
        words = sorted({w for r in rows for w in r["words"]})
        known = known.join(known.sparkSession.createDataFrame([(w,) for w in words], "term string"), "term")
    return {r["term"]: r["weight"] for r in known.collect()}


def _lexical_slice(worded: DataFrame, table: dict[str, float], rows: list, k: int, scheme: str, length: float) -> DataFrame:
    """The best documents of each task for some queries, by postings of the queries' words: ``(query_id, ord, score)``."""
    names = sorted({w for r in rows for w in r["words"] if w in table})
    place = {w: i for i, w in enumerate(names)}
    idf = np.array([table[w] for w in names])
    code = np.array([place[w] * len(rows) + j for j, r in enumerate(rows) for w in r["words"] if w in place], np.int64)
    code, times = np.unique(code, return_counts=True)
    term, query = code // len(rows), code % len(rows)
    weight = times * idf[term]
    if scheme == "tfidf":
        size = np.sqrt(np.bincount(query, weight**2, minlength=len(rows)))
        weight = weight * idf[term] / np.where(size == 0, 1, size)[query]
    starts = np.searchsorted(term, np.arange(len(names) + 1))
    shared = worded.sparkSession.sparkContext.broadcast((names, starts, query, weight, np.array([r[0] for r in rows], np.int64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, query, weight, ids = shared.value
        known, best = pa.array(names, pa.string()), Best(k, len(ids))
        step = max(16, 2_000_000 // len(ids))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                lists, order, scale = part.column(1), part.column(0).to_numpy(), part.column(2).to_numpy()
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                term = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                code, tf = np.unique(doc[term >= 0] * np.int64(len(names) + 1) + term[term >= 0], return_counts=True)
                doc, term = code // (len(names) + 1), code % (len(names) + 1)
                w = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / length)) if scheme == "bm25" else tf / scale[doc]
                n = starts[term + 1] - starts[term]
                at = np.repeat(starts[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                cell = np.repeat(doc, n) * len(ids) + query[at]
                # Documents without a common word stay NaN, which never counts.
                s = np.full(len(order) * len(ids), np.nan)
                s[cell] = 0.0
                s += np.bincount(cell, weight[at] * np.repeat(w, n), minlength=len(s))
                best.add(np.round(s, 6).reshape(len(order), len(ids)), order)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.col]), pa.array(best.ids), pa.array(best.score)], ["query_id", "ord", "score"])

    return worded.select("ord", "words", "scale").mapInArrow(score, "query_id bigint, ord bigint, score double")


def marginal_relevance(pool: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """MMR over a ranked pool ``(query_id, query_vector, ord, vector)`` of bounded size: k rows a query as ``(query_id, ord, score, rank)``.

    First the row of the highest cosine, then again and again the row that maximises
    weight * cosine - (1 - weight) * largest cosine with a chosen row. The running maximum makes it O(k n d).
    """

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord", kind="stable")
        v = np.stack(group["vector"].to_numpy()).astype(np.float64)
        v /= np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) == 0, 1, n)
        q = np.asarray(group["query_vector"].iloc[0], np.float64)
        relevance = np.round(v @ (q / (np.linalg.norm(q) or 1)), 6)
        best = int(np.argmax(relevance))
        chosen, scores, near = [best], [relevance[best]], np.round(v @ v[best], 6)
        open_ = np.ones(len(v), bool)
        open_[best] = False
        while len(chosen) < min(k, len(v)):
            value = np.where(open_, np.round(weight * relevance - (1 - weight) * near, 6), -np.inf)
            i = int(np.argmax(value))
            chosen.append(i)
            scores.append(value[i])
            open_[i] = False
            near = np.maximum(near, np.round(v @ v[i], 6))
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "ord": group["ord"].to_numpy()[chosen], "score": scores, "rank": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    return pool.groupBy("query_id").applyInPandas(choose, "query_id bigint, ord bigint, score double, rank int")


def above(chunks: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """Every chunk ``(ord, vector)`` whose cosine with a query ``(query_id, vector)`` is at least ``least``: ``(query_id, ord, score, rank)``."""
    found = []
    for rows in _slices(queries.where("vector is not null"), ["vector"]):
        q, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows], np.int64)
        shared = chunks.sparkSession.sparkContext.broadcast((q, ids))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, ids = shared.value
            with np.errstate(divide="ignore", invalid="ignore"):
                unit = q / np.linalg.norm(q, axis=1, keepdims=True)
                for order, v in _matrices(batches, q.shape[1]):
                    s = np.round((v / np.linalg.norm(v, axis=1, keepdims=True)) @ unit.T, 6)
                    row, col = np.nonzero(s >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[col]), pa.array(order[row]), pa.array(s[row, col])], ["query_id", "ord", "score"])

        found.append(_of_width(chunks, q.shape[1]).mapInArrow(score, "query_id bigint, ord bigint, score double"))
    if not found:
        return chunks.sparkSession.createDataFrame([], "query_id bigint, ord bigint, score double, rank int")
    return _merge(found, 2**31 - 1)


def _of_width(chunks: DataFrame, width: int) -> DataFrame:
    return chunks.select(F.col("ord").cast("bigint").alias("ord"), F.col("vector")).where(F.col("vector").isNotNull() & (F.size("vector") == width))


def _matrices(batches: Iterator[pa.RecordBatch], width: int, rows: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``ord`` and vectors of the batches, a few rows at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            part = batch.slice(low, rows)
            yield part.column(0).to_numpy(), part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def mmr(chunks: DataFrame, queries: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """MMR over all chunks ``(ord, vector)`` for each query ``(query_id, vector)``: k rows a query as ``(query_id, ord, score, rank)``.

    The rule of ``marginal_relevance`` in k rounds: in each, every task finds its best row a query where it lies, and the best of all tasks is
    chosen; only that row and its vector go to the driver. Null and zero vectors are never found. A slice's chosen vectors are broadcast
    again each round, so slices get smaller as k grows.
    """
    spark = chunks.sparkSession
    asked = queries.where("vector is not null")
    first = asked.select(F.size("vector")).first()
    schema = "query_id bigint, ord bigint, score double, rank int"
    if first is None or k < 1:
        return spark.createDataFrame([], schema)
    width = first[0]
    x = _of_width(chunks, width).persist()
    out = []
    for rows in _slices(asked, ["vector"], max(1, min(SLICE, 2**22 // (k * width)))):
        q, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows], np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        chosen, taken = np.zeros((0, *unit.shape)), np.zeros((0, len(q)), np.int64)
        for rank in range(1, k + 1):
            shared = spark.sparkContext.broadcast((unit, chosen, taken))

            def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                unit, chosen, taken = shared.value
                top, at, vectors = np.full(len(unit), -np.inf), np.zeros(len(unit), np.int64), np.zeros(unit.shape)
                for order, v in _matrices(batches, width):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        v = v / np.linalg.norm(v, axis=1, keepdims=True)
                    s = np.round(v @ unit.T, 6)
                    if len(chosen):
                        near = np.round(v @ chosen[0].T, 6)
                        for c in chosen[1:]:
                            near = np.maximum(near, np.round(v @ c.T, 6))
                        s = np.round(weight * s - (1 - weight) * near, 6)
                        for t in taken:
                            s[order[:, None] == t[None]] = np.nan
                    row, col = best_rows(s, order, 1)
                    better = (s[row, col] > top[col]) | ((s[row, col] == top[col]) & (order[row] < at[col]))
                    row, col = row[better], col[better]
                    top[col], at[col], vectors[col] = s[row, col], order[row], v[row]
                got = np.flatnonzero(top > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(at[got]), pa.array(top[got]), pa.array(list(vectors[got]), pa.list_(pa.float64()))], ["q", "ord", "score", "v"])

            found = x.mapInArrow(best, "q int, ord bigint, score double, v array<double>").groupBy("q").agg(F.max_by(F.struct("ord", "score", "v"), F.struct("score", -F.col("ord"))).alias("r")).select("q", "r.*").collect()
            if not found:
                break
            # A query without any row left keeps NaN here, which is never found again.
            new, ords = np.full(unit.shape, np.nan), np.full(len(q), -1, np.int64)
            for r in found:
                new[r[0]], ords[r[0]] = r[3], r[1]
                out.append((int(ids[r[0]]), r[1], r[2], rank))
            chosen, taken = np.concatenate([chosen, new[None]]), np.concatenate([taken, ords[None]])
            shared.unpersist()
    x.unpersist()
    return spark.createDataFrame(out, schema)


def exemplar_svm(chunks: DataFrame, queries: DataFrame, k: int, c: float = 0.1, rounds: int = 12) -> DataFrame:
    """k best chunks of each query by a linear SVM whose only positive is the query and whose negatives are all chunks.

    Squared hinge with balanced class weights, solved by Newton steps: each round sums, in each task, the
    curvature and gradient of the rows within the margin (a (d+1) x (d+1) matrix a query), and the driver solves that small system. No
    row leaves its task. Scores are decision values, ``score_norm`` scales them over all chunks and the query. Each slice of ``SVM_SLICE``
    queries is solved on its own.
    """
    spark = chunks.sparkSession
    x = chunks.select(F.col("ord").cast("bigint"), "vector").where("vector is not null").persist()
    n = x.count()
    found = [_svm_slice(x, n, rows, k, c, rounds) for rows in _slices(queries.where("vector is not null"), ["vector"], SVM_SLICE)] if n else []
    if not found:
        x.unpersist()
        return spark.createDataFrame([], "query_id bigint, ord bigint, score double, score_norm double, rank int")
    every = reduce(DataFrame.unionAll, found)
    bounds = every.groupBy("query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return top_by(every.select("query_id", "ord", "score"), "query_id", k).join(bounds, "query_id").select("query_id", "ord", "score", F.round((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6), 6).alias("score_norm"), "rank")


def _svm_slice(x: DataFrame, n: int, q_rows: list, k: int, c: float, rounds: int) -> DataFrame:
    """The best rows of each batch of the ``n`` chunks for some queries: ``(query_id, ord, score, lo, hi)``."""
    spark = x.sparkSession
    normal = lambda v: v / np.where((m := np.linalg.norm(v, axis=-1, keepdims=True)) == 0, 1, m)
    q = np.hstack([normal(np.array([r[1] for r in q_rows], np.float64)), np.ones((len(q_rows), 1))])
    ids, d = np.array([r[0] for r in q_rows], np.int64), q.shape[1]
    positive, negative = c * (n + 1) / 2, c * (n + 1) / (2 * n)
    w = np.zeros_like(q)

    def features(batch: pa.RecordBatch) -> np.ndarray:
        v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, d - 1)
        return np.hstack([normal(v), np.ones((batch.num_rows, 1))])

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(w)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            w = shared.value
            total = np.zeros((len(w), d, d + 1))
            for batch in batches:
                v = features(batch)
                inside = (v @ w.T) > -1  # negatives within the margin
                for j in range(len(w)):
                    a = v[inside[:, j]]
                    total[j, :, :d] += a.T @ a
                    total[j, :, d] -= a.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w), dtype=np.int32)), pa.array([t.tobytes() for t in total], pa.binary())], ["q", "m"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for j, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total[j] = total[j] + np.frombuffer(m) if j in total else np.frombuffer(m)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["q", "m"])

        # Each query's matrices of all tasks meet in one task as they stream by; one matrix a query comes back.
        total = np.zeros((len(q), d, d + 1))
        for r in x.mapInArrow(sums, "q int, m binary").repartition("q").mapInArrow(add, "q int, m binary").collect():
            total[r[0]] = np.frombuffer(r[1]).reshape(d, d + 1)
        new = np.zeros_like(w)
        for j in range(len(q)):
            h, g = 2 * negative * total[j, :, :d], 2 * negative * total[j, :, d]
            if q[j] @ w[j] < 1:
                h, g = h + 2 * positive * np.outer(q[j], q[j]), g + 2 * positive * q[j]
            new[j] = np.linalg.solve(h + np.eye(d), g)
        done = np.abs(new - w).max() < 1e-9
        w = new
        if done:
            break
    shared = spark.sparkContext.broadcast((w, (q * w).sum(1)))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, own = shared.value
        best = Best(k, len(w))
        for batch in batches:
            if batch.num_rows:
                best.add(np.round(features(batch) @ w.T, 6), batch.column(0).to_numpy())
        c = best.col
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[c], best.ids, best.score, np.minimum(best.lo, own)[c], np.maximum(best.hi, own)[c])], ["query_id", "ord", "score", "lo", "hi"])

    return x.mapInArrow(decide, "query_id bigint, ord bigint, score double, lo double, hi double")


def rerank(pool: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], threshold: float | None = None) -> DataFrame:
    """A pool ``(query_id, query, ord, text)`` ranked anew by ``scorer(query, text)`` (higher is better); rows below the threshold are dropped."""
    score = F.pandas_udf(lambda q, t: scorer(q, t).round(6), "double")
    scored = pool.select("query_id", "ord", score("query", "text").alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return top_by(scored, "query_id", 2**31 - 1)


def rerank_reduce(pool: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], k: int) -> DataFrame:
    """The k rows of each query's pool that ``scorer`` ranks best."""
    return rerank(pool, scorer).where(F.col("rank") <= k)


def svm_above(chunks: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """Of each query's k best rows by ``exemplar_svm`` those with a ``score_norm`` of at least ``least``."""
    return exemplar_svm(chunks, queries, k).where(F.col("score_norm") >= least)


def custom(chunks: DataFrame, queries: DataFrame, search: Callable[[np.ndarray, np.ndarray, int], list[int]], k: int) -> DataFrame:
    """``search(query vector, matrix, k) -> row numbers`` over all chunks ``(ord, vector)`` in order of ``ord``; its order is the rank.

    The function sees every vector at once, so each task holds the whole matrix: it is sent to at most as many tasks as the session has slots,
    each with its share of the queries ``(query_id, vector)``.
    """
    schema, found = "query_id bigint, ord bigint, rank int", []
    for rows in _slices(queries.where("vector is not null"), ["vector"]):
        q, ids = np.array([r[1] for r in rows], np.float64), np.array([r[0] for r in rows], np.int64)
        n, spark = min(len(rows), chunks.sparkSession.sparkContext.defaultParallelism), chunks.sparkSession
        shared = spark.sparkContext.broadcast((q, ids))

        def run(t, *, shared=shared, n=n):
            q, ids = shared.value
            t = t.combine_chunks().sort_by("ord")
            order, part = t.column("ord").to_numpy(), t.column("part")[0].as_py()
            m = np.asarray(t.column("vector").combine_chunks().flatten()).astype(np.float64).reshape(len(order), -1)
            got = [(i, order[np.asarray(list(search(q[i], m, k))[:k], np.int64)]) for i in range(part, len(q), n)]
            sizes = [len(o) for _, o in got]
            return pa.table({"query_id": np.repeat(ids[[i for i, _ in got]], sizes), "ord": np.concatenate([o for _, o in got]), "rank": np.concatenate([np.arange(1, s + 1, dtype=np.int32) for s in sizes])})

        copies = _of_width(chunks, q.shape[1]).select("ord", "vector", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
        found.append(copies.groupBy("part").applyInArrow(run, schema))
    return reduce(DataFrame.unionAll, found) if found else chunks.sparkSession.createDataFrame([], schema)


def overlap_scorer(query: pd.Series, text: pd.Series) -> pd.Series:
    """Deterministic stand-in for a cross-encoder: share of the query's words that the text holds."""
    sets = [(set(a.lower().split()), set(b.lower().split())) for a, b in zip(query.fillna(""), text.fillna(""), strict=True)]
    return pd.Series([len(a & b) / (len(a) or 1) for a, b in sets], dtype="float64")


#: Retrievers of each search type.
SEARCH_TYPES = {"merge": ("mmr", "svm", "tfidf"), "auto": ("knn", "bm25"), "auto_rerank": ("knn", "bm25"), "mmr": ("mmr",), "svm": ("svm",), "tfidf": ("tfidf",), "knn": ("knn",), "bm25": ("bm25",), "faiss": ("l2",), "meta": ("l2",), "facebook": ("l2",), "rerank": ("rerank",)}


def retrievers(search_type: str | Callable) -> tuple:
    """Names of the retrievers of a search type; a callable is a custom one. Unknown names raise ValueError."""
    if callable(search_type):
        return (search_type,)
    name, _, model = search_type.lower().partition(":")
    if name not in SEARCH_TYPES:
        raise ValueError(f"unknown search type: {search_type}")
    return (f"rerank:{search_type.partition(':')[2]}",) if name == "rerank" and model else SEARCH_TYPES[name]
