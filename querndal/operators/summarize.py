"""Summaries by injected models: map-reduce rounds and a sequential fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .chunking import _fold, chunk_documents, n_words
from .models import answer, model


def map_reduce(docs: DataFrame, id_col: str, text_col: str, name: str | Callable, budget: int = 300, size: int = 500, overlap: int = 50, most_rounds: int = 12, failures: int = 5) -> DataFrame:
    """``(id, summary, rounds)``: consecutive chunks are packed into calls under the budget and each call is summarised, until one is left.

    Each round is one plan over all documents; the rounds are few as each shrinks what is left. If ``failures`` rounds bring no fewer
    parts, the parts are joined.
    """
    parts = chunk_documents(docs, id_col, text_col, size, overlap).select(id_col, F.col("chunk_no").alias("n"), F.col("chunk").alias("t"))
    call = F.concat(F.lit("Summarise this text.\n\n"), F.col("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    rounds, stalled, before = 0, 0, -1
    while True:
        packed = _pack(parts, id_col, kind, budget)
        parts = cut(packed.withColumn("t", answer(call, name)).select(id_col, "n", "t"))
        rounds += 1
        total, many = parts.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
        stalled = stalled + 1 if total == before else 0
        if many == 0 or rounds >= most_rounds or stalled >= failures:
            break
        before = total
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), "\n")
    return parts.groupBy(id_col).agg(joined.alias("summary")).withColumn("rounds", F.lit(rounds))


def _pack(parts: DataFrame, by: str, kind: str, budget: int) -> DataFrame:
    def close(s: dict) -> list:
        if not s["t"]:
            return []
        out = [(s["n"], "\n".join(s["t"]))]
        s.update(n=s["n"] + 1, t=[], size=0)
        return out

    def step(s: dict, row: tuple) -> list:
        n = n_words(row[1])
        out = close(s) if s["t"] and s["size"] + n >= budget else []
        s["t"].append(row[1] or "")
        s["size"] += n
        return out

    return _fold(parts, by, "n", ["t"], lambda: {"n": 0, "t": [], "size": 0}, step, close, f"`{by}` {kind}, n int, t string")


def refine(docs: DataFrame, id_col: str, text_col: str, name: str | Callable, size: int = 500, overlap: int = 50) -> DataFrame:
    """``(id, summary)``: each chunk refines the summary so far; documents run in parallel, chunks stream."""
    call = model(name)
    kind = docs.schema[id_col].dataType.simpleString()

    def step(s: dict, row: tuple) -> list:
        s["t"] = call(f"Refine this summary with the text.\n\n{s['t']}\n\n{row[1]}")
        return []

    return _fold(chunk_documents(docs, id_col, text_col, size, overlap), id_col, "chunk_no", ["chunk"], lambda: {"t": ""}, step, lambda s: [(s["t"],)], f"`{id_col}` {kind}, summary string")
