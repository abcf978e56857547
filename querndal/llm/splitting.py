"""Problem 4: cut oversized texts into overlapping pieces at natural boundaries.

The pieces of a text are a path through its boundary positions. With ``s`` a piece's start and ``e`` its end,

    V(s) = min over e of  cost(s, e) + carry * V(max(s + 1, e - overlap))

over all boundaries ``e`` in the window (s + size div 2, s + size], or s + size itself where the window has none. V is computed from the right for every
start that any path may reach, in stretches of starts that don't depend on each other, as arrays.

``cost`` is the penalty of the kind of boundary at ``e`` plus the imbalance (how far the piece stays below the limit).

* ``BALANCED``: penalties and squared imbalance of the whole text are minimised together (``carry`` = 1).
* ``LEXICOGRAPHIC``: a better kind outweighs any imbalance, and an earlier piece all later ones. As no two ends of one start cost the same,
  the order of whole paths is that of their first differing piece, which leaves no weight for V: ``carry`` = 0. Then each piece
  takes the best kind of its window, as far right as possible, which is the rule of ``p4_found``.

Edge cases: null and not oversized texts give no rows; a size that is missing, not digits only, zero or too
large for BIGINT counts as 1000, such an overlap as 100; an overlap so large that the next piece would not
start later is cut down so that it starts one character later. Offsets count code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import code_points

#: Unicode White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE = np.zeros(0x110000, bool)
_SPACE[WHITE_SPACE] = True


def boundary_kinds(text: str) -> np.ndarray:
    """Kind (0 best to 3) of the cut before each position 0..len(text)."""
    cp, _ = code_points([text])
    kinds = np.full(len(cp) + 1, 3, np.uint8)
    space = _SPACE[cp]
    kinds[1:][space] = 2
    stop = np.isin(cp, [ord(c) for c in ".!?"])
    stop[:-1] &= space[1:]
    stop[-1:] = False
    kinds[1:][stop | np.isin(cp, [ord(c) for c in "。！？"])] = 1
    kinds[1:][cp == 10] = 0
    return kinds


class Costs(NamedTuple):
    """``kinds``: penalty by kind of boundary; ``imbalance`` and ``power`` of the unused share of the size; ``carry``: weight of what follows."""

    kinds: tuple[float, float, float, float]
    imbalance: float
    power: int
    carry: float


BALANCED = Costs((0.0, 1.0, 3.0, 9.0), 2.0, 2, 1.0)
#: Unused shares stay under 1, so kinds decide first.
LEXICOGRAPHIC = Costs((0.0, 1.0, 2.0, 3.0), 1.0, 1, 0.0)


def _starts(ends: np.ndarray, n: int, size: int, overlap: int) -> np.ndarray:
    """All positions at which a piece may start, ascending: the beginning, behind each boundary, and behind forced cuts."""
    if overlap > size // 2:  # a next start may be the one right behind
        return np.arange(n)
    found = np.unique(np.concatenate([[0], ends - overlap]))
    found = new = found[(found >= 0) & (found < n)]
    while len(new):
        bare = np.searchsorted(ends, new + size // 2, "right") == np.searchsorted(ends, new + size, "right")
        new = np.setdiff1d((new + size - overlap)[bare & (n - new > size)], found)
        found = np.union1d(found, new)
    return found


def cut_pieces(text: str, size: int, overlap: int, costs: Costs = LEXICOGRAPHIC) -> list[tuple[int, int]]:
    """Pieces ``(start, end)`` of one text under the recursion above."""
    n = len(text)
    if n <= size:
        return [(0, n)] if n else []
    kinds = boundary_kinds(text)
    ends = np.flatnonzero(kinds < 3)
    s = _starts(ends, n, size, overlap)
    best, to = np.zeros(len(s)), np.full(len(s), n, np.int64)
    last = n - s <= size  # the piece takes the rest
    best[last] = costs.imbalance * (1 - (n - s[last]) / size) ** costs.power
    penalty = np.array(costs.kinds)
    low, high = np.searchsorted(ends, s + size // 2, "right"), np.searchsorted(ends, s + size, "right")
    # Starts nearer together than the shortest way to a next start don't depend on each other. Stretches have bounded numbers of (start, end).
    reach = max(1, size // 2 + 1 - overlap) if costs.carry else n
    options = np.cumsum(np.maximum(high - low, 1))
    b = int(np.searchsorted(s, n - size))
    while b:
        a = int(np.searchsorted(s, s[b - 1] - reach, "right"))
        a = min(b - 1, max(a, int(np.searchsorted(options, options[b - 1] - 500_000))))
        count = np.maximum(high[a:b] - low[a:b], 1)
        heads = np.cumsum(count) - count
        owner = np.repeat(np.arange(b - a), count)
        at = low[a:b][owner] + np.arange(len(owner)) - heads[owner]
        forced = (high[a:b] == low[a:b])[owner]
        e = np.where(forced, s[a:b][owner] + size, ends[np.minimum(at, len(ends) - 1)] if len(ends) else 0)
        v = penalty[kinds[e]] + costs.imbalance * (1 - (e - s[a:b][owner]) / size) ** costs.power
        if costs.carry:
            v = v + costs.carry * best[np.searchsorted(s, np.maximum(s[a:b][owner] + 1, e - overlap))]
        least = np.minimum.reduceat(v, heads)
        best[a:b] = least
        to[a:b] = np.maximum.reduceat(np.where(v == least[owner], e, -1), heads)  # of equal ones the furthest
        b = a
    out, x = [], 0
    while True:
        e = int(to[np.searchsorted(s, x)])
        out.append((x, e))
        if e == n:
            return out
        x = max(x + 1, e - overlap)


def digits_or(value: Column, default: int, least: int) -> Column:
    """A whole number of digits 0-9 after trimming spaces, at least ``least``; else ``default``."""
    number = F.when(F.trim(value).rlike("^[0-9]+$"), F.trim(value).try_cast("bigint"))
    return F.when(number >= least, number).otherwise(F.lit(default)).cast("bigint")


def split_oversized(docs: DataFrame, id_col: str, text_col: str, size: Column, overlap: Column, costs: Costs = LEXICOGRAPHIC) -> DataFrame:
    """Pieces of every text longer than its size: ``(id, piece_no, start_at, end_at)``.

    Narrow: one scan of the two columns, lengths compared in the JVM, only oversized texts reach Python.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, no, a, b = batch.column(0), [], [], [], []
            for i, (text, s, o) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                for k, (x, y) in enumerate(cut_pieces(text, s, o, costs)):
                    at.append(i)
                    no.append(k)
                    a.append(x)
                    b.append(y)
                if len(at) > 100_000:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(v, pa.int32()) for v in (no, a, b))], [id_col, "piece_no", "start_at", "end_at"])
                    at, no, a, b = [], [], [], []
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(v, pa.int32()) for v in (no, a, b))], [id_col, "piece_no", "start_at", "end_at"])

    sized = docs.select(F.col(id_col), F.col(text_col).alias("text"), size.alias("size"), overlap.alias("overlap"))
    return sized.where(F.char_length("text") > F.col("size")).mapInArrow(pieces, f"`{id_col}` {kind}, piece_no int, start_at int, end_at int")
