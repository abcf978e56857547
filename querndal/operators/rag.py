"""Composite operators: search, answer, ask over documents, self-ask, references, memory."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_category, is_blank, word_count
from ..runtime import cut
from . import fuse, prompts
from . import retrieve as R
from .aggregates import first_by_text, reference_texts
from .chunking import n_words, pack_documents, split_reference
from .models import answer, embed
from .windows import short_prefix


def search(chunks: DataFrame, queries: DataFrame, search_type: str = "auto", k: int = 20, budget: int = 3000, bm25_least: float = 70.0, knn_least: float = 0.9, scorer: Callable[[pd.Series, pd.Series], pd.Series] = R.overlap_scorer, size: Callable[[Column], Column] = word_count) -> DataFrame:
    """The context of each query: ``(query_id, ord, text, place, total_words)``.

    ``chunks``: (ord, text, vector), ``queries``: (query_id, text, vector). Retrieves with the search type's retrievers and fuses them by text under the
    budget of tokens, which ``size`` counts. MMR, custom functions and rerankers look at all chunks; ``auto_rerank`` at all within ``knn_least``.
    """
    texts = chunks.select("ord", "text")
    names = R.retrievers(search_type)
    lists: dict = {}
    asked_text = queries.select("query_id", F.col("text").alias("query"))

    for name in names:
        if callable(name):
            lists[name] = R.custom(chunks, queries, name, k)
        elif search_type == "auto_rerank" and name == "knn":
            lists[name] = R.above(chunks, queries, knn_least)
        elif name in ("knn", "l2"):
            lists[name] = R.nearest(chunks, queries, k, "cosine" if name == "knn" else "l2")
        elif name in ("bm25", "tfidf"):
            lists[name] = R.lexical(texts, queries.select("query_id", "text"), k, name)
        elif name == "mmr":
            lists[name] = R.mmr(chunks, queries, k)
        elif name == "svm":
            lists[name] = R.exemplar_svm(chunks, queries, k)
        else:
            lists[name] = R.rerank(texts.crossJoin(asked_text), scorer).where(F.col("rank") <= k)
    full = {n: df.join(texts, "ord") for n, df in lists.items()}
    if search_type == "auto":
        out = fuse.auto(full["knn"], full["bm25"], budget, bm25_least, size=size)
    elif search_type == "auto_rerank":
        again = R.rerank(full["knn"].select("query_id", "ord", "text").join(asked_text, "query_id"), scorer).join(texts, "ord")
        n = chunks.where(F.exists("vector", lambda x: x != 0)).count()
        out = fuse.auto_rerank(full["knn"], full["bm25"], again, budget, max(10, n // 10), knn_least, bm25_least, size=size)
    else:
        ranked = None
        for i, name in enumerate(names):
            part = full[name].select("query_id", F.lit(i).alias("retriever_idx"), "rank", "ord", "text")
            ranked = part if ranked is None else ranked.unionAll(part)
        out = fuse.round_robin(ranked, budget, size)
    return out.select("query_id", "ord", "text", "place", "total_words")


def contexts(found: DataFrame, splitter: str = "\n----------------\n") -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("place", "text")))
    return found.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), splitter).alias("context"), F.count(F.lit(1)).alias("n_chunks"))


def rag(chunks: DataFrame, queries: DataFrame, model: str | Callable = "stub:first_sentence", **options) -> DataFrame:
    """``(query_id, answer, n_chunks)`` from retrieved context; queries without any context are asked without."""
    found = contexts(search(chunks, queries, **options))
    prompt = F.concat(F.lit("Answer from the context.\n\nQuestion: "), F.col("text"), F.lit("\n\n"), F.coalesce("context", F.lit("")))
    joined = queries.select("query_id", "text").join(found, "query_id", "left")
    return joined.select("query_id", answer(prompt, model).alias("answer"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def self_ask(chunks: DataFrame, queries: DataFrame, followups: Callable[[str], list[str]], model: str | Callable = "stub:first_sentence", embedder: str | Callable = "stub:hash", **options) -> DataFrame:
    """Each query's follow-up questions answered in one plan over all of them, then the query from those answers: ``(query_id, answer, n_followups)``."""
    ask = F.pandas_udf(lambda s: s.map(lambda q: list(followups(q))), "array<string>")
    asked = queries.select("query_id", F.posexplode(ask("text")).alias("no", "text"))
    keyed = asked.select(F.xxhash64("query_id", "no").alias("query_id"), F.col("query_id").alias("parent"), "no", "text").withColumn("vector", embed(F.col("text"), embedder))
    keyed = cut(keyed)  # embedded once for both uses
    got = rag(chunks, keyed.select("query_id", "text", "vector"), model, **options).join(keyed.select("query_id", "parent", "no", F.col("text").alias("question")), "query_id")
    pairs = F.sort_array(F.collect_list(F.struct("no", F.concat(F.col("question"), F.lit("\n"), F.col("answer")).alias("qa"))))
    notes = got.groupBy(F.col("parent").alias("query_id")).agg(F.array_join(F.transform(pairs, lambda x: x["qa"]), "\n").alias("notes"), F.count(F.lit(1)).alias("n_followups"))
    prompt = F.concat(F.lit("Answer from these notes.\n\n"), F.col("text"), F.lit("\n\n"), F.coalesce("notes", F.lit("")))
    return queries.select("query_id", "text").join(notes, "query_id", "left").select("query_id", answer(prompt, model).alias("answer"), F.coalesce("n_followups", F.lit(0)).alias("n_followups"))


def ask(
    docs: DataFrame,
    by: str,
    order: str,
    text: str,
    prompt: str,
    model: str | Callable = "stub:first_sentence",
    budget: int = 3000,
    most: int = 10,
    judge: str | Callable | None = None,
    size: Callable[[Column], Column] = word_count,
    count: Callable[[str], int] = n_words,
) -> DataFrame:
    """Ask each group's documents: bins under the budget are asked in parallel; of several answers the prefix within the budget is concluded.

    Of more than ``most`` answers only the relevant ones stay: those that the ``judge`` grades with a yes, without a judge those that say anything. ``size`` and
    ``count`` count tokens of answers and of documents.
    """
    bins = pack_documents(docs, by, order, text, budget, count=count)
    answers = bins.select(by, "bin", answer(F.concat(F.lit(prompt + "\n\n"), F.col("text")), model).alias("answer"))
    counts = answers.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    joined = answers.join(counts, by)
    kept = joined.where(F.col("n") <= most).unionByName(relevant_answers(joined.where(F.col("n") > most), "answer", F.lit(prompt), judge))
    fit = short_prefix(kept, by, ["bin"], size(F.col("answer")), budget)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bin", "answer"))), lambda x: x["answer"]), "\n")
    return fit.groupBy(by).agg(joined.alias("notes"), F.max("n").alias("n_bins")).select(by, F.when(F.col("n_bins") == 1, F.col("notes")).otherwise(answer(F.concat(F.lit("Conclude.\n\n"), F.col("notes")), model)).alias("answer"), "n_bins")


def relevant_answers(answers: DataFrame, answer_col: str, question: Column, judge: str | Callable | None = None) -> DataFrame:
    """Rows whose answer a judge grades with a yes as relevant to the question; without a judge, rows whose answer is not blank."""
    if judge is None:
        return answers.where(~is_blank(F.col(answer_col)))
    grade = answer(prompts.grader(F.col(answer_col), question), judge)
    return answers.withColumn("_grade", grade).where(F.lower("_grade").contains("yes")).drop("_grade")


def references(chunks: DataFrame, response: str, judge: str | Callable, budget: int = 3000) -> DataFrame:
    """Parts of each reference that the judge calls relevant to a response: ``(ref, parts)``."""
    pieces = split_reference(reference_texts(chunks), "text", budget)
    graded = pieces.select("ref", "part", answer(F.concat(F.lit(f"Does the text support the response?\n\n{response}\n\n"), F.col("text")), judge).alias("grade"))
    return graded.where(F.lower("grade").contains("yes")).groupBy("ref").agg(F.sort_array(F.collect_set("part")).alias("parts"))


def memory_entries(turns: DataFrame, categorise: str | Callable = lambda x: "general", embedder: str | Callable = "stub:hash") -> DataFrame:
    """Memory rows of ``(ord, prompt, response, at)``: text of both sides, its category and vector."""
    text = F.concat(F.lit("User: "), F.coalesce("prompt", F.lit("")), F.lit("\nAI: "), F.coalesce("response", F.lit("")))
    rows = turns.where(~is_blank(F.col("prompt")) | ~is_blank(F.col("response"))).select("ord", "at", text.alias("text"))
    return rows.withColumns({"category": clean_category(answer(F.col("text"), categorise)), "vector": embed(F.col("text"), embedder)})


def search_memory(memory: DataFrame, queries: DataFrame, k: int = 3) -> DataFrame:
    """The k nearest memory texts of each query, each text once.

    Equal texts have equal vectors; they are merged before the search, so that copies take no place of other texts.
    """
    once = first_by_text(memory.where("vector is not null").select("ord", "text", "vector"), "text")
    near = R.nearest(once.select("ord", "vector"), queries, k, "l2").join(once.select("ord", "text"), "ord")
    return fuse.concatenated(near.select("query_id", F.lit(0).alias("retriever_idx"), "rank", "ord", "text"), k)


def web_answer(spark, engine: str, prompt: str, model: str | Callable = "stub:first_sentence", count: int = 5, budget: int = 3000) -> DataFrame:
    """Ask over the results of a registered search engine."""
    from ..sources.sinks import search_web

    hits = search_web(spark, engine, prompt, count).select(F.lit(1).alias("ask"), F.xxhash64("url").alias("at"), "text")
    return ask(hits, "ask", "at", "text", prompt, model, budget)


def register_search(spark, view: str, name: str = "chunk_search") -> None:
    """SQL table function ``name(q STRING, k INT)`` over a view (ord, text): the k rows that hold most of the query's words."""
    words = "array_distinct(regexp_extract_all(lower({}), '[\\\\p{{L}}\\\\p{{M}}\\\\p{{N}}_]+', 0))"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(q STRING, k INT) RETURNS TABLE(ord BIGINT, hits INT)
      RETURN SELECT ord, hits FROM (SELECT ord, hits, row_number() OVER (ORDER BY hits DESC, ord) AS n FROM (
        SELECT ord, size(array_intersect({words.format('text')}, {words.format('q')})) AS hits FROM {view}) WHERE hits > 0) WHERE n <= k""")
