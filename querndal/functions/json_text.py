"""JSON out of model output: clean parts by the parser, the rest after small repairs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_single = re.compile(r"(?<=[{\[,:\s])'([^'\"]*)'(?=\s*[,:}\]])")


def _spans(text: str) -> list[str]:
    """Outermost balanced {...} parts, quotes respected."""
    out, depth, start, quote, skip = [], 0, 0, "", False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif quote:
            if c == "\\":
                skip = True
            elif c == quote:
                quote = ""
        elif c == '"' and depth:
            quote = c
        elif c == "{":
            start = i if not depth else start
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def _parse(part: str) -> str | None:
    for s in (part, re.sub(r",\s*([}\]])", r"\1", _single.sub(r'"\1"', part)).replace("True", "true").replace("False", "false").replace("None", "null")):
        try:
            value = json.loads(s)
        except ValueError:
            continue
        return json.dumps(value, ensure_ascii=False, sort_keys=True) if isinstance(value, dict) else None
    return None


def find_objects(text: str | None) -> list[str]:
    """All JSON objects of a text as canonical JSON; what can't be repaired is left out."""
    return [x for x in map(_parse, _spans(text or "")) if x is not None]


def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(find_objects)


def extract_objects(text: Column) -> Column:
    """All JSON objects of a text; an empty array for null."""
    return F.pandas_udf(_objects, "array<string>")(text)


def extract_object(text: Column) -> Column:
    """The first JSON object of a text, else null."""
    return F.try_element_at(extract_objects(text), F.lit(1))


_arithmetic = re.compile(r"[\d\s.+*/()%-]+")


def calculate(expression: str) -> float | None:
    """Value of a plain arithmetic expression (+ - * / % and brackets); null for anything else. Nothing is evaluated as code."""
    if not _arithmetic.fullmatch(expression or "") or "**" in expression or "//" in expression:
        return None
    found = re.findall(r"\d+\.?\d*|\.\d+|[()+*/%-]", expression)
    at = 0

    def peek() -> str:
        return found[at] if at < len(found) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return found[at - 1]

    def atom() -> float:
        c = take()
        if c == "(":
            v = total()
            if take() != ")":
                raise ValueError(expression)
            return v
        return -atom() if c == "-" else atom() if c == "+" else float(c)

    def product() -> float:
        v = atom()
        while peek() in ("*", "/", "%") and peek():
            op, w = take(), atom()
            v = v * w if op == "*" else v / w if op == "/" else v % w
        return v

    def total() -> float:
        v = product()
        while peek() in ("+", "-") and peek():
            op, w = take(), product()
            v = v + w if op == "+" else v - w
        return v

    try:
        v = total()
        return v if at == len(found) else None
    except (ValueError, IndexError, ZeroDivisionError, RecursionError):
        return None
