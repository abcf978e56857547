"""Injected models: callables over text, registered by ``type:name``, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import inspect
import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_models: dict[str, Callable[[str], str]] = {}
_embedders: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def first_sentence(prompt: str) -> str:
    """Stand-in model: the last paragraph's first sentence, at most 200 characters."""
    last = (prompt or "").strip().split("\n\n")[-1]
    for mark in ("。", ". ", "! ", "? ", "\n"):
        if mark in last:
            return last.split(mark)[0].strip()[:200] + mark.strip()
    return last[:200]


def hash_vectors(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Stand-in embedder: signed feature hashing of words, unit length; the zero vector for blank text."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        for w in (t or "").replace("\n", " ").lower().split():
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            v[h[0] % dim] += 1 if h[1] & 1 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32).tolist())
    return out


def register_model(name: str, call: Callable[[str], str]) -> None:
    _models[name] = call


def register_embedder(name: str, call: Callable[[list[str]], list[list[float]]]) -> None:
    _embedders[name] = call


register_model("stub:first_sentence", first_sentence)
register_embedder("stub:hash", hash_vectors)


def model(name: str | Callable) -> Callable[[str], str]:
    """A registered or given model; unknown names raise ValueError."""
    if callable(name):
        return name
    if name not in _models:
        raise ValueError(f"unknown model: {name}")
    return _models[name]


def embedder(name: str | Callable) -> Callable:
    if callable(name):
        return name
    if name not in _embedders:
        raise ValueError(f"unknown embedder: {name}")
    return _embedders[name]


def retried(call: Callable, tries: int = 3, pause: float = 0.0) -> Callable:
    """The call, repeated on errors; the last error is raised."""

    def run(x):
        for i in range(tries):
            try:
                return call(x)
            except Exception:
                if i == tries - 1:
                    raise
                time.sleep(pause)

    return run


def answer(prompt: Column, name: str | Callable, tries: int = 3) -> Column:
    """Model answers of a prompt column, one iterator a task so that a model loads once."""
    call = retried(model(name), tries)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda x: None if x is None else call(x))

    return run(prompt)


def embed(text: Column, name: str | Callable, tries: int = 2) -> Column:
    """Vectors of a text column, line feeds as spaces; null for null."""
    call = retried(embedder(name), tries)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            there = s.notna()
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            if there.any():
                out[there] = pd.Series(call([x.replace("\n", " ") for x in s[there]]), index=s.index[there])
            yield out

    return run(text)


def translate(text: Column, language: str, name: str | Callable) -> Column:
    """A model's translation of each text; null for null."""
    from . import prompts

    return F.when(text.isNotNull(), answer(prompts.translation(text, language), name))


def to_json_object(text: Column, keys: list[str], name: str | Callable) -> Column:
    """The first JSON object in a model's answer, as text; null where there is none."""
    from ..functions.json_text import extract_object
    from . import prompts

    return extract_object(answer(prompts.json_form(text, keys), name))


class Tool(NamedTuple):
    """A function as a tool: for agents by name, description and arguments, for SQL as a function of that name."""

    name: str
    description: str
    call: Callable

    def explained(self) -> str:
        """Description with the names and types of the arguments."""
        args = ", ".join(f"{p.name}:{getattr(p.annotation, '__name__', p.annotation) if p.annotation is not p.empty else 'value'}" for p in inspect.signature(self.call).parameters.values())
        return f"{self.description}, args: {{{args}}}"

    def register(self, spark: SparkSession, returns: str = "string") -> None:
        """Make it a SQL function, called for whole Arrow batches."""
        call = self.call
        spark.udf.register(self.name, F.pandas_udf(lambda *columns: pd.Series([call(*row) for row in zip(*columns, strict=True)]), returns, F.PandasUDFType.SCALAR))


def tool(call: Callable, description: str, name: str | None = None) -> Tool:
    return Tool(name or call.__name__, description, call)


def explain_tools(tools: list[Tool]) -> dict[str, str]:
    return {t.name: t.explained() for t in tools}
