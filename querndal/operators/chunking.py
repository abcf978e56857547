"""Chunking and packing of texts.

Packers are sequential by definition. Rows are sorted within partitions by group and order and streamed through a fold, so a group of
any size passes with constant memory and is never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

#: Where the recursive splitter may cut, coarsest first.
SEPARATORS = ("\n", " ", ",", ".", "。", "!")


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the first separator of the list that occurs, else at the next.

    Separators stay at the head of what follows them. Small parts are merged up to ``size``, a piece begins with up to
    ``overlap`` characters of whole parts of the one before. A run without any separator may be longer.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")
    sep = next((s for s in separators if s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep else ()
    if sep:
        head, *others = text.split(sep)
        parts = [x for x in [head, *(sep + o for o in others)] if x]
    else:
        parts = [text] if text else []
    out: list[str] = []
    held: list[str] = []
    total = 0

    def emit() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for p in parts:
        if len(p) > size:
            emit()
            held, total = [], 0
            out += split_recursive(p, size, overlap, rest) if rest else [p.strip()] * bool(p.strip())
            continue
        if total + len(p) > size and held:
            emit()
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    emit()
    return out


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``(id, chunk_no, chunk)``; null and blank texts have no chunks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, c) for i, t in enumerate(batch.column(1).to_pylist()) for k, c in enumerate(split_recursive(t, size, overlap))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], [id_col, "chunk_no", "chunk"])

    return docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(chunks, f"`{id_col}` {kind}, chunk_no int, chunk string")


def _fold(rows: DataFrame, by: str, order: str, columns: list[str], start: Callable, step: Callable, finish: Callable, schema: str) -> DataFrame:
    """Stream the rows of each group in order through ``step(state, row) -> rows out``."""
    picked = rows.select(by, order, *columns).repartition(by).sortWithinPartitions(by, order)
    names = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]
    types = picked.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        key, state, out, first = None, None, [], True
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first or row[0] != key:
                    if not first:
                        out += [(key, *r) for r in finish(state)]
                    key, state, first = row[0], start(), False
                out += [(key, *r) for r in step(state, row[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(names))], schema=arrow)
            out = []
        if not first:
            out = [(key, *r) for r in finish(state)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], arrow.field(i).type) for i in range(len(names))], schema=arrow)

    return picked.mapInArrow(run, schema)


def n_words(text: str | None) -> int:
    return len((text or "").split())


def halve(text: str, most: int, count: Callable[[str], int] = n_words) -> list[str]:
    """Slices of one fixed width: the text's length divided by 2, 4, 8, ... until the first slice fits ``most`` tokens."""
    parts = 2
    while count(text[: len(text) // parts]) > most:
        parts *= 2
    width = max(1, len(text) // parts)
    return [text[i : i + width] for i in range(0, len(text), width)]


def halves(text: Column, most: int, count: Callable[[str], int] = n_words) -> Column:
    """``halve`` of each text over ``most`` tokens, others whole, in Arrow batches; null for null."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else halve(t, most, count) if count(t) > most else [t])

    return run(text)


def pack_documents(docs: DataFrame, by: str, order: str, text: str, budget: int, piece_limit: int | None = None, count: Callable[[str], int] = n_words) -> DataFrame:
    """Greedy bins of consecutive texts: ``(by, bin, text, n_tokens)``.

    A text is added to the bin while it fits; one over the budget is cut by ``halve`` (pieces up to ``piece_limit`` tokens) and closes the bin.
    Blank bins are left out. ``count`` counts tokens.
    """
    kind = docs.schema[by].dataType.simpleString()
    limit = piece_limit or budget

    def close(s: dict) -> list:
        t = "".join(s["parts"])
        s["parts"], s["size"] = [], 0
        if not t.strip():
            return []
        s["bin"] += 1
        return [(s["bin"] - 1, t, count(t))]

    def step(s: dict, row: tuple) -> list:
        t = row[1] or ""
        n = count(t)
        out = []
        if s["size"] + n > budget:
            out += close(s)
            if n > budget:
                for piece in halve(t, limit, count):
                    s["parts"] = [piece]
                    out += close(s)
                return out
        s["parts"].append(t + "\n")
        s["size"] += n
        return out

    return _fold(docs, by, order, [text], lambda: {"parts": [], "size": 0, "bin": 0}, step, close, f"`{by}` {kind}, bin int, text string, n_tokens bigint")


def pack_calls(chunks: DataFrame, by: str, order: str, text: str, budget: int, carried: int = 0, count: Callable[[str], int] = n_words) -> DataFrame:
    """``(by, call, n_chunks, n_tokens)``: consecutive chunks while the total, with ``carried`` tokens, stays under the budget.

    A chunk that alone reaches the budget is a call of its own.
    """
    kind = chunks.schema[by].dataType.simpleString()

    def close(s: dict) -> list:
        if not s["n"]:
            return []
        out = [(s["call"], s["n"], s["size"])]
        s.update(call=s["call"] + 1, n=0, size=0)
        return out

    def step(s: dict, row: tuple) -> list:
        n = count(row[1] or "")
        out = close(s) if s["n"] and carried + s["size"] + n >= budget else []
        s["n"] += 1
        s["size"] += n
        return out

    return _fold(chunks, by, order, [text], lambda: {"call": 0, "n": 0, "size": 0}, step, close, f"`{by}` {kind}, call int, n_chunks int, n_tokens bigint")


def split_reference(refs: DataFrame, text: str, budget: int, size: Callable[[Column], Column] = word_count) -> DataFrame:
    """A text with at least ``budget`` tokens becomes two halves by characters (``half`` 0 and 1), others stay whole (``half`` 0)."""
    n = F.char_length(text)
    middle = F.floor(n / 2).cast("int")
    halves = F.when(size(F.col(text)) >= budget, F.array(F.substring(F.col(text), F.lit(1), middle), F.substring(F.col(text), middle + 1, n))).otherwise(F.array(F.col(text)))
    return refs.select(*[c for c in refs.columns if c != text], F.posexplode(halves).alias("half", text))


def format_context(rows: DataFrame, by: str, order: str, text: str, splitter: str = "\n----------------\n") -> DataFrame:
    """Texts of each group in order, joined by a splitter."""
    parts = F.sort_array(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["t"]), splitter).alias("context"))


def chunks_per_call(language: Column, max_input: Column, summary_len: Column, chunk_size: Column) -> Column:
    """How many chunks fit one summary call: at least 2; a token holds two characters in Chinese, else one."""
    per = F.when(language.contains("chinese"), F.lit(2)).otherwise(F.lit(1))
    return F.greatest(F.lit(2), F.floor((per * max_input - summary_len) / chunk_size)).cast("bigint")


def call_count(chunks: Column, per_call: Column) -> Column:
    """Calls until one summary is left: the sum of ceil(chunks / per_call) over all rounds (64 rounds hold any BIGINT)."""
    start = F.struct(chunks.cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("calls"))
    after = lambda a: F.ceil(a["n"] / per_call).cast("bigint")
    step = lambda a, _: F.struct(F.when(a["n"] > 1, after(a)).otherwise(a["n"]).alias("n"), (a["calls"] + F.when(a["n"] > 1, after(a)).otherwise(F.lit(0).cast("bigint"))).cast("bigint").alias("calls"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda a: a["calls"])
