"""Rank fusion: several ranked lists into one context, by text, under a word budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count

Counter = Callable[[Column], Column]


def _first_by_text(ranked: DataFrame, order: list[str]) -> DataFrame:
    """Of each query's equal texts the first in ``order``."""
    rows = F.struct(*[F.col(c) for c in ranked.columns if c not in ("query_id", "text")])
    return ranked.groupBy("query_id", "text").agg(F.min_by(rows, F.struct(*order)).alias("r")).select("query_id", "text", "r.*")


def _within(ranked: DataFrame, order: list[str], budget: int, size: Counter = word_count) -> DataFrame:
    """The prefix of each query's list whose tokens (words, unless ``size`` counts others) fit the budget; as counts are never negative, that is what stopping at the first overflow gives."""
    w = Window.partitionBy("query_id").orderBy(*order)
    counted = ranked.withColumn("n_words", size(F.col("text")))
    total = counted.withColumns({"total_words": F.sum("n_words").over(w.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(w)})
    return total.where(F.col("total_words") <= budget)


def round_robin(ranked: DataFrame, budget: int, size: Counter = word_count) -> DataFrame:
    """``(query_id, retriever_idx, rank, ord, text)``: rank by rank and retriever by retriever, each text once, within the budget."""
    order = ["rank", "retriever_idx", "ord"]
    return _within(_first_by_text(ranked, order), order, budget, size)


def concatenated(ranked: DataFrame, k: int) -> DataFrame:
    """Retriever by retriever, each text once, the first k."""
    order = ["retriever_idx", "rank", "ord"]
    w = Window.partitionBy("query_id").orderBy(*order)
    return _first_by_text(ranked, order).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def auto(knn: DataFrame, bm25: DataFrame, budget: int, bm25_least: float = 70.0, boost: int = 2, size: Counter = word_count) -> DataFrame:
    """At most ``boost`` BM25 rows with a score of at least ``bm25_least``, then kNN order; each text once, within the budget.

    ``knn`` and ``bm25``: (query_id, ord, score, rank, text). The kNN threshold of the rule changes nothing, as prefix and rest are in order.
    """
    top = bm25.where((F.col("score") >= bm25_least) & (F.col("rank") <= boost))
    both = top.select("query_id", F.lit(0).alias("tier"), "rank", "ord", "text").unionAll(knn.select("query_id", F.lit(1), "rank", "ord", "text"))
    order = ["tier", "rank", "ord"]
    return _within(_first_by_text(both, order), order, budget, size)


def auto_rerank(knn: DataFrame, bm25: DataFrame, reranked: DataFrame, budget: int, pool: int, knn_least: float = 0.9, bm25_least: float = 70.0, boost: int = 2, size: Counter = word_count) -> DataFrame:
    """As auto, but of kNN only the rows of at least ``knn_least`` if they are fewer than ``pool``, else the reranked ones of them."""
    good = knn.where(F.col("score") >= knn_least)
    few = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < pool).select("query_id")
    kept = good.join(few, "query_id", "left_semi").select("query_id", "rank", "ord", "text").unionAll(
        reranked.join(good.select("query_id", "ord"), ["query_id", "ord"], "left_semi").join(few, "query_id", "left_anti").select("query_id", "rank", "ord", "text")
    )
    top = bm25.where((F.col("score") >= bm25_least) & (F.col("rank") <= boost))
    both = top.select("query_id", F.lit(0).alias("tier"), "rank", "ord", "text").unionAll(kept.select("query_id", F.lit(1), "rank", "ord", "text"))
    order = ["tier", "rank", "ord"]
    return _within(_first_by_text(both, order), order, budget, size)
