"""Filters over a chunk table: by file, keyword, id and a small predicate language over a metadata map.

All are narrow except the joins with key sets, for which Catalyst picks the side to broadcast from its size.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename

COMPARATORS = {"eq": "=", "ne": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}
TYPES = {"integer": "bigint", "int": "bigint", "float": "double", "string": "string", "str": "string"}


def by_file(chunks: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose source has one of the file names, with any path and either slash on both sides; null sources never match."""
    wanted = sorted({re.sub(r".*/", "", n.replace("\\", "/")) for n in names})
    return chunks.where(basename(F.col("source")).isin(wanted))


def by_keyword(chunks: DataFrame, keywords: list[str], text: str = "docs") -> DataFrame:
    """Rows that contain a keyword (case-sensitive), each once, with ``keyword_no`` of the first keyword it contains."""
    first = F.coalesce(*[F.when(F.col(text).contains(F.lit(k)), F.lit(i)) for i, k in enumerate(keywords)], F.lit(None).cast("int"))
    return chunks.withColumn("keyword_no", first).where("keyword_no is not null")


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("ids").distinct(), "ids", "left_semi")


def pop_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is not among ``ids``; rows without an id stay."""
    return chunks.join(ids.select("ids").where("ids is not null"), "ids", "left_anti")


def drop_file(chunks: DataFrame, name: str) -> DataFrame:
    """All rows but those of one file, by its exact name; rows without a source stay."""
    return chunks.where(~F.coalesce(basename(F.col("source")) == re.sub(r".*/", "", name.replace("\\", "/")), F.lit(False)))


@dataclass(frozen=True)
class Leaf:
    op: str
    attribute: str
    value: str


@dataclass(frozen=True)
class Node:
    op: str  # and, or
    parts: tuple


def parse(expression: str) -> Leaf | Node | None:
    """``and(...)``, ``or(...)``, ``eq(attr, value)`` and the like, in any case; values hold no comma. ``NO_FILTER`` and blank: None."""
    s = expression.strip()
    if not s or s.upper() == "NO_FILTER":
        return None
    m = re.fullmatch(r"(\w+)\s*\((.*)\)", s, re.S)
    if not m:
        raise ValueError(f"not a filter: {expression}")
    op, body = m.group(1).lower(), m.group(2)
    if op in ("and", "or"):
        parts, depth, start = [], 0, 0
        for i, c in enumerate(body + ","):
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                parts.append(parse(body[start:i]))
                start = i + 1
        if any(p is None for p in parts):
            raise ValueError(f"empty part in: {expression}")
        return Node(op, tuple(parts))
    fields = [x.strip().strip("\"'") for x in body.split(",")]
    if op not in COMPARATORS or len(fields) != 2 or not fields[0]:
        raise ValueError(f"not a comparison: {expression}")
    return Leaf(op, *fields)


def loosen(tree: Leaf | Node | None) -> Leaf | Node | None:
    """Every ``and`` on the way from the root becomes ``or``; parts of an ``or`` stay as they are."""
    if isinstance(tree, Node) and tree.op == "and":
        return Node("or", tuple(loosen(p) for p in tree.parts))
    return tree


def leaves(tree: Leaf | Node | None) -> list[Leaf]:
    return [] if tree is None else [tree] if isinstance(tree, Leaf) else [x for p in tree.parts for x in leaves(p)]


def checked_schema(fields: list[dict]) -> dict[str, str]:
    """Attribute types by name; entries without name, description or type are dropped."""
    return {f["name"]: TYPES.get(str(f["type"]).lower(), "string") for f in fields if isinstance(f, dict) and {"name", "description", "type"} <= f.keys()}


def predicate(tree: Leaf | Node | None, metadata: Column, types: dict[str, str]) -> Column:
    """The tree as a Column that is never null: a missing or unusable value fails every comparison, ``ne`` too.

    ``eq`` on strings is a case-insensitive substring test.
    """
    if tree is None:
        return F.lit(True)
    if isinstance(tree, Node):
        out = predicate(tree.parts[0], metadata, types)
        for p in tree.parts[1:]:
            q = predicate(p, metadata, types)
            out = (out & q) if tree.op == "and" else (out | q)
        return out
    kind = types.get(tree.attribute, "string")
    raw = F.try_element_at(metadata, F.lit(tree.attribute))
    if kind == "string":
        if tree.op == "eq":
            return F.coalesce(F.lower(raw).contains(F.lower(F.lit(tree.value))), F.lit(False))
        left, right = raw, F.lit(tree.value)
    else:
        left, right = F.trim(raw).try_cast(kind), F.lit(tree.value).try_cast(kind)
    tests = {"eq": left == right, "ne": left != right, "gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}
    return F.coalesce(tests[tree.op], F.lit(False))


def matched_fields(tree: Leaf | Node | None, metadata: Column, types: dict[str, str]) -> Column:
    """Names of the attributes of all leaves that hold, in order, repeats kept."""
    parts = [F.when(predicate(x, metadata, types), F.lit(x.attribute)) for x in leaves(tree)]
    return F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")


def by_metadata(chunks: DataFrame, expression: str, fields: list[dict], loose: bool = False, metadata: str = "metadatas", parser: Callable[[str], Leaf | Node | None] = parse) -> DataFrame:
    """Rows that satisfy the expression, with their ``matched_fields``. ``parser`` may read another language into the same trees."""
    tree, types = parser(expression), checked_schema(fields)
    if loose:
        tree = loosen(tree)
    return chunks.where(predicate(tree, F.col(metadata), types)).withColumn("matched_fields", matched_fields(tree, F.col(metadata), types))


def read_model_filter(output: str) -> tuple[str, str]:
    """Query and filter of a model's JSON answer ``{query, filter}``; what can't be read is empty, which filters nothing."""
    m = re.search(r"\{.*\}", output or "", re.S)
    try:
        found = json.loads(m.group()) if m else {}
    except ValueError:
        found = {}
    clean = lambda x: re.sub(" {2,}", " ", str(x or "").replace("\\", "").replace('"', ""))
    return clean(found.get("query")), clean(found.get("filter"))


def self_query(chunks: DataFrame, prompt: str, fields: list[dict], model, loose: bool = False) -> tuple[DataFrame, str]:
    """Ask ``model(prompt, fields)`` for query and filter, apply the filter; returns rows and query."""
    query, expression = read_model_filter(model(prompt, fields))
    try:
        parse(expression)
    except ValueError:
        expression = ""
    return by_metadata(chunks, expression, fields, loose), query
