"""Pairs of rows that share a hash bucket, whatever the buckets' sizes.

Buckets arrive as ``(key, id, sketch...)``. Three ways, by the size of a key; none of them leaves a pair out that shares a key:

1. Most keys are small. Their rows are shuffled once by key and streamed through numpy, which emits the pairs that pass a cheap
   test on the sketches. A key that turns out to hold more than ``hot`` rows is not paired: its rows are handed on as they stream by.
2. Keys that a frequent-items sketch (merged from partial sketches, nothing is shuffled for it) reports with over ``hot`` rows
   never reach that shuffle. Rows of both kinds of hot keys get finer keys (``finer``: more rows of the signature or more
   projections beside the hot key) and are paired as in 1.
3. Rows of finer keys that are still over-full, and of hot keys that finer keys would only multiply, are dealt into blocks, and each pair of blocks is a group of bounded size
   that is verified where it stands and emits survivors only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Keys tracked by the frequent-items sketch, which bounds what it sends to the driver. A key it misses holds under about 3.5 / TRACKED of the
#: rows: more than one task may pair, but no more than it can stream by.
TRACKED = 16_384


def hot_keys(rows: DataFrame, least: int) -> list[int]:
    """Keys with at least ``least`` rows among those that the frequent-items sketch tracks."""
    top = rows.agg(F.expr(f"approx_top_k(key, {TRACKED}, {TRACKED})").alias("top")).first()[0]
    return [x["item"] for x in top or [] if x["item"] is not None and x["count"] >= least]


def group_pairs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of equal neighbours in a sorted array, in bounded blocks."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    left = np.repeat(starts + size, size) - np.arange(len(key)) - 1  # members behind each row
    total = np.cumsum(left)
    low = 0
    while low < len(key):
        done = total[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(total, done + 2_000_000, "right")))
        n = left[low:high]
        i = np.repeat(np.arange(low, high), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        low = high


def cool_pairs(rows: DataFrame, test: Callable[[np.ndarray, np.ndarray], np.ndarray] | None, hot: int) -> DataFrame:
    """``(a, b, key)``: pairs a < b of all rows with one key (key is null), and each row of a key with more than ``hot`` rows (b is null).

    ``test`` gets the sketch columns of both sides, shaped (pairs, columns).
    """
    names = [c for c in rows.columns if c not in ("key", "id")]

    def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
        nothing = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), nothing if b is None else pa.array(b), nothing if key is None else pa.array(key)], ["a", "b", "key"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(2 + len(names))]
        open_key: int | None = None  # an over-full key of which rows may still come

        def of(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, ids = columns[:2]
            size = np.searchsorted(key, key, "right") - np.searchsorted(key, key)
            many = size > hot
            if many.any():
                yield out(ids[many], None, key[many])
            columns = [c[(size > 1) & ~many] for c in columns]
            key, ids = columns[:2]
            if not len(key):
                return
            sketch = np.stack(columns[2:], axis=1) if names else None
            for i, j in group_pairs(key):
                ok = ids[i] != ids[j]
                if test and names:
                    ok &= test(sketch[i], sketch[j])
                a, b = ids[i[ok]], ids[j[ok]]
                yield out(np.minimum(a, b), np.maximum(a, b), None)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns, strict=True)]
            if open_key is not None:
                n = int(np.searchsorted(now[0], open_key, "right"))
                if n:
                    yield out(now[1][:n], None, now[0][:n])
                    now = [c[n:] for c in now]
                if len(now[0]):
                    open_key = None
                else:
                    rest = now
                    continue
            edge = int(np.searchsorted(now[0], now[0][-1]))  # the last key may go on in the next batch
            rest = [c[edge:] for c in now]
            if edge:
                yield from of([c[:edge] for c in now])
            if len(rest[0]) > hot:
                open_key = int(rest[0][0])
                yield out(rest[1], None, rest[0])
                rest = [c[:0] for c in rest]
        if len(rest[0]):
            yield from of(rest)

    return rows.select("key", "id", *names).repartition("key").sortWithinPartitions("key").mapInArrow(pairs, "a bigint, b bigint, key bigint")


def hot_pairs(rows: DataFrame, payload: DataFrame, verify: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], block: int) -> DataFrame:
    """``(a, b)``: what ``verify(left, right, same)`` returns over all pairs of blocks of each key of ``(key, id)``; ``payload`` has one row for each id."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(payload, "id")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = dealt.withColumn("other", other).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "other")

    def work(group: pd.DataFrame) -> pd.DataFrame:
        own = group["own"].to_numpy()
        low, high = group["low"].iloc[0], group["high"].iloc[0]
        left = group[own == low]
        return verify(left, left if low == high else group[own == high], low == high)

    return spread.groupBy("key", "low", "high").applyInPandas(work, "a bigint, b bigint")


def meeting_pairs(
    rows: DataFrame,
    payload: DataFrame,
    test: Callable[[np.ndarray, np.ndarray], np.ndarray],
    finer: Callable[[DataFrame], DataFrame],
    verify: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame],
    hot: int,
    block: int,
    finer_from: int = 0,
) -> DataFrame:
    """``(a, b)``, a < b, distinct: the rows that share a key and pass ``test``, in hot keys a finer key and ``test`` or ``verify``.

    ``finer`` turns the hot keys' rows ``(key, id)`` into rows shaped as ``rows``. Hot keys of up to ``finer_from`` rows go to blocks at once, where
    comparing them costs less than finer keys.
    """

    def split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        keys = hot_keys(rows, hot)
        spark = rows.sparkSession
        listed = F.broadcast(spark.createDataFrame([(k,) for k in keys], "key bigint")) if keys else None
        met = cut(cool_pairs(rows.join(listed, "key", "left_anti") if keys else rows, test, hot))
        full = met.where("b is null")
        late = full.select("key", F.col("a").alias("id")) if full.limit(1).count() else None
        early = rows.join(listed, "key", "left_semi").select("key", "id") if keys else None
        hotter = early if late is None else late if early is None else early.unionAll(late)
        return met.where("b is not null").select("a", "b"), hotter

    pairs, hotter = split(rows)
    if hotter is not None and finer_from > hot:
        hotter = cut(hotter.distinct())
        huge = hotter.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > finer_from).select("key")
        pairs = pairs.unionAll(hot_pairs(hotter.join(huge, "key", "left_anti"), payload, verify, block))
        hotter = hotter.join(huge, "key", "left_semi")
        if not hotter.limit(1).count():
            hotter = None
    if hotter is not None:
        more, hottest = split(cut(finer(hotter.distinct())))
        pairs = pairs.unionAll(more)
        if hottest is not None:
            pairs = pairs.unionAll(hot_pairs(hottest.distinct(), payload, verify, block))
    return pairs.distinct()
