"""Problem 5: the k most similar vectors of every vector, by multiprobe p-stable hashing.

A table hashes a normalised vector to the cell of ``projections`` random directions, cut in steps of ``width``. Besides its own cell
each vector visits the perturbed cells that most likely hold its neighbours: its distances to the cell borders are sorted,
and sets of border crossings are taken in the order of their expected score. As every vector is both indexed and asked for,
all visit ``probes`` cells a table and two vectors meet if any of them agree. Candidates of all tables are merged; a sketch
of 128 random signs drops those that are clearly further than ``min_cosine``; the rest is ranked by exact cosines.

Equal vectors form a class and only its first row is hashed; of a class no more than k + 1 rows can be
neighbours of anyone, so a vector held by a third of all rows adds no more pairs than any other.

With 64 dimensions, 16 projections, width 2, 6 tables and 6 probes, the recall of pairs at 0.90 to 0.92 was 0.947, at 0.9 or above 0.994
(brute force over all 19,508 distinct vectors of scale 0.1); with 18 projections and 8 tables 0.924 and 0.993. The sketch loses one in 4,000 pairs at 0.9, fewer above.

Cells that many distinct vectors share are compared block by block, each vector keeping the k + 1 nearest of a block; cells of very many
are cut finer first, by fresh tables within the cell.

Edge cases: vectors that are null, of another length, with a null, NaN or infinite entry or all zero take no part;
cosines are taken in double precision and rounded to 6 places, ties go to the smaller id; no row is its own neighbour.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .buckets import meeting_pairs
from .tokens import U64, mix

SKETCH_WORDS = 2
#: Tables and projections for up to BASE_ROWS distinct vectors. One projection more leaves unrelated vectors in a common cell of width 2 with chance FAR, and
#: those at a cosine of 0.9 in a common visited cell with chance NEAR (0.82 for their own cells; 6 probes on both sides make it 0.88, as measured).
BASE_ROWS, BASE_TABLES, BASE_PROJECTIONS, FAR, NEAR = 200_000, 6, 16, 0.47, 0.88
#: Within a hot cell a pair at a cosine of 0.9 meets again with chance 1 - (1 - 0.82^10)^16 = 0.9, one at 0.95 with 0.99.
FINER_TABLES, FINER_PROJECTIONS = 16, 10
#: Blocks from which on a hot cell is cut finer: below, each row meets fewer blocks than finer tables would give it cells.
FINER_FROM = 16


@functools.cache
def crossing_order(m: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """Sets of ranks (0 the nearest of 2m borders) to cross, in ascending expected score; the first is empty."""
    j = np.arange(1, 2 * m + 1)
    far = 2 * m + 1 - j
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - far / (m + 1) + far * (far + 1) / (4 * (m + 1) * (m + 2)))
    out, heap = [()], [(float(cost[0]), (0,))]
    while len(out) < probes:
        score, chosen = heapq.heappop(heap)
        if not any(2 * m - 1 - x in chosen for x in chosen):  # never both borders of one direction
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - float(cost[last]) + float(cost[last + 1]), (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + float(cost[last + 1]), (*chosen, last + 1)))
    return tuple(out)


class Hasher:
    def __init__(self, dim: int, tables: int, projections: int, width: float, probes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.tables, self.m, self.width = tables, projections, width
        self.directions = rng.standard_normal((dim, tables * projections))
        self.shift = rng.random(tables * projections) * width
        self.factor = rng.integers(0, 2**63, tables * projections, dtype=U64) * U64(2) + U64(1)
        self.signs = rng.standard_normal((dim, 64 * SKETCH_WORDS))
        self.order = crossing_order(projections, probes)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """int64 matrix (vectors, tables * probes) of cell keys of unit vectors."""
        place = (x @ self.directions + self.shift) / self.width
        cell = np.floor(place)
        out = []
        for t in range(self.tables):
            part = slice(t * self.m, (t + 1) * self.m)
            f = self.factor[part]
            home = (cell[:, part].astype(np.int64).astype(U64) * f).sum(1, dtype=U64)
            down = place[:, part] - cell[:, part]
            border = np.argsort(np.concatenate([down, 1 - down], axis=1), axis=1, kind="stable")
            delta = np.where(border < self.m, U64(0) - f[border % self.m], f[border % self.m])
            for chosen in self.order:
                out.append(mix(home + delta[:, list(chosen)].sum(1, dtype=U64) + U64(t)))
        return np.stack(out, axis=1).astype(np.int64)

    def sketch(self, x: np.ndarray) -> np.ndarray:
        bits = np.packbits(x @ self.signs > 0, axis=1)
        return np.ascontiguousarray(bits).view(np.int64)


def unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column, dim: int) -> Column:
    """True for vectors of ``dim`` finite entries, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def most_bits(min_cosine: float, deviations: float = 3.5) -> int:
    """Differing sketch bits that a pair at ``min_cosine`` exceeds with a chance beyond ``deviations`` standard deviations."""
    n, p = 64 * SKETCH_WORDS, np.arccos(min_cosine) / np.pi
    return int(np.ceil(n * p + deviations * np.sqrt(n * p * (1 - p))))


def scheme(n: int) -> tuple[int, int]:
    """Tables and projections for ``n`` vectors. Cells get finer with n, so that what unrelated vectors share stays bounded, and tables more, so that recall stays.

    The grid gets so many projections more that FAR to their power makes up for n, and tables by NEAR to that power.
    """
    more = max(0, int(np.ceil(np.log(max(n, 1) / BASE_ROWS) / -np.log(FAR))))
    return int(np.ceil(BASE_TABLES * NEAR**-more)), BASE_PROJECTIONS + more


def hash_rows(vectors: DataFrame, hasher: Hasher, dim: int, prefix: str | None = None) -> DataFrame:
    """``(key, id, s0, s1)``: the cells of each of ``(id, v)``, together with the key that the column ``prefix`` holds, and its sketch."""
    shared = vectors.sparkSession.sparkContext.broadcast(hasher)
    columns = ["id", "v", *([prefix] if prefix else [])]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                x = unit(part.column("v").flatten().to_numpy(), dim)
                keys, sketch = shared.value.keys(x), shared.value.sketch(x)
                if prefix:
                    keys = mix(keys.view(U64) ^ mix(part.column(prefix).to_numpy().view(U64))[:, None]).view(np.int64)
                per = keys.shape[1]
                out = [keys.ravel(), np.repeat(part.column("id").to_numpy(), per), *(np.repeat(sketch[:, i], per) for i in range(SKETCH_WORDS))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], ["key", "id", "s0", "s1"])

    return vectors.select(*columns).mapInArrow(hashed, "key bigint, id bigint, s0 bigint, s1 bigint")


def _verify(dim: int, k: int, min_cosine: float):
    """Of two blocks of vectors each one's k + 1 nearest of the other block, as far as they reach ``min_cosine``."""

    def verify(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        p, q = left["id"].to_numpy(), right["id"].to_numpy()
        x, y = (unit(np.concatenate([*s["v"], np.zeros(0, np.float32)]), dim) for s in (left, right))
        p_order, q_order = np.argsort(p), np.argsort(q)  # of equal cosines the smaller id comes first
        p, x, q, y = p[p_order], x[p_order], q[q_order], y[q_order]
        found = []
        for one, u, two, v in ((p, x, q, y),) if same else ((p, x, q, y), (q, y, p, x)):
            for low in range(0, len(one), 512):
                cosine = np.round(u[low : low + 512] @ v.T, 6)
                cosine[one[low : low + 512, None] == two[None]] = -2
                if cosine.shape[1] > k + 1:
                    least = -np.partition(-cosine, k, axis=1)[:, k]
                    cosine[cosine < least[:, None]] = -2
                i, j = np.nonzero(cosine >= min_cosine)
                place = np.arange(len(i)) - np.searchsorted(i, i)
                order = np.lexsort((j, -cosine[i, j], i))
                kept = order[place <= k]
                found.append(np.stack([one[low + i[kept]], two[j[kept]]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])

    return verify


def similar_vectors(
    records: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 5, min_cosine: float = 0.9, tables: int | None = None, projections: int | None = None, width: float = 2.0, probes: int = 6, hot: int = 512, block: int = 2048
) -> DataFrame:
    """``(id, neighbour, cosine, rank)``: of every row its k most similar rows, as far as their cosine is at least ``min_cosine``.

    ``tables`` and ``projections`` follow from the number of distinct vectors (``scheme``) unless given.
    """
    vectors = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(usable(F.col("v"), dim))
    named = vectors.withColumns({"f1": F.xxhash64("v"), "f2": F.xxhash64(F.lit(1), "v")})
    w = Window.partitionBy("f1", "f2").orderBy("id")
    first = named.select("id", "f1", "f2").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    classes = cut(first.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("near")))
    unique = cut(vectors.join(classes.select(F.col("rep").alias("id")), "id", "left_semi"))
    auto = scheme(classes.count())
    tables, projections = tables or auto[0], projections or auto[1]
    rows = hash_rows(unique, Hasher(dim, tables, projections, width, probes), dim)
    limit = most_bits(min_cosine)

    def finer(hot: DataFrame) -> DataFrame:
        """Cells of hot cells: fresh tables of few projections, within the hot cell."""
        return hash_rows(hot.join(unique, "id"), Hasher(dim, FINER_TABLES, FINER_PROJECTIONS, width, 1, seed=12), dim, "key")

    near_bits = lambda a, b: np.bitwise_count((a ^ b).view(U64)).sum(1) <= limit
    candidates = meeting_pairs(rows, unique, near_bits, finer, _verify(dim, k, min_cosine), hot, block, FINER_FROM * block)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (unit(batch.column(c).flatten().to_numpy(), dim) for c in ("va", "vb"))
            cosine = np.round(np.einsum("ij,ij->i", x, y), 6)
            keep = pa.array(cosine >= min_cosine)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(cosine).filter(keep)], ["a", "b", "cosine"])

    both = candidates.join(unique.toDF("a", "va"), "a").join(unique.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
    ranked = both.mapInArrow(rank, "a bigint, b bigint, cosine double")
    ranked = cut(ranked)
    near = classes.select(F.col("rep").alias("other"), "near")
    sides = ranked.select(F.col("a").alias("rep"), F.col("b").alias("other"), "cosine").unionAll(ranked.select("b", "a", "cosine"))
    own = classes.where(F.size("near") > 1).select("rep", F.explode("near").alias("neighbour"), F.lit(1.0).alias("cosine"))
    pool = sides.join(near, "other").select("rep", F.explode("near").alias("neighbour"), "cosine").unionAll(own)
    # Classes with neighbours of other classes only still need their own first rows, which come before further ones at a cosine of 1.
    best = Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour")
    top = pool.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = top.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "neighbour", "cosine"))).alias("top"))
    owned = named.select("id", "f1", "f2").join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select("id", "rep").join(lists, "rep")
    others = F.slice(F.filter("top", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return owned.select("id", F.posexplode(others).alias("at", "x")).select("id", F.col("x.neighbour").alias("neighbour"), F.col("x.cosine").alias("cosine"), (F.col("at") + 1).alias("rank"))


def similar_pairs(records: DataFrame, id_col: str, vector_col: str, dim: int, **options) -> DataFrame:
    """``(a, b)``, a < b: rows of which at least one is among the other's neighbours. Options as in similar_vectors."""
    n = similar_vectors(records, id_col, vector_col, dim, **options)
    return n.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
