"""Token counters, the parameter of every budget: of a Column for windows, of a string for packers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import default_tokenizer_file
from .text import han_tokens, word_count


def words(text: Column) -> Column:
    """Runs of non-white-space; the default of all budgets."""
    return word_count(text)


def characters(text: Column) -> Column:
    return F.coalesce(F.char_length(text), F.lit(0))


def han_words(text: Column) -> Column:
    """Words, and each character of Chinese or Japanese."""
    return F.coalesce(F.size(han_tokens(text)), F.lit(0))


def of_callable(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """A counter of strings as one of Columns, in Arrow batches; null counts 0."""

    def counter(text: Column) -> Column:
        @F.pandas_udf("int")
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: 0 if t is None else count(t)).astype("int32")

        return run(text)

    return counter


def tokenizer(name: str = "byte_bpe_50k.json", path: str | None = None) -> Callable[[Column], Column]:
    """Counts the tokens of a public tokenizer's file, loaded once a task; null and empty texts count 0."""
    place = path or default_tokenizer_file(name)

    def counter(text: Column) -> Column:
        @F.pandas_udf("int")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(place)
            for s in parts:
                yield pd.Series([len(e.ids) for e in model.encode_batch(["" if t is None else t for t in s], add_special_tokens=False)], dtype="int32", index=s.index)

        return run(text)

    return counter
