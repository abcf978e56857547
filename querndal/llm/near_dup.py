"""Problem 1: near-duplicate texts by MinHash bands and sequential Bayesian verification.

1. Texts with equal token sequences form a class; the rest works on one representative of each class.
2. Bands of MinHash signatures propose candidate pairs (``buckets``). Bucket rows carry the first batch of signature entries, so that the first
   step of 3 is taken where a pair is met. In a band that very many representatives share, a second band has to agree too.
3. A candidate's signatures are compared batch by batch. After n entries with m matches, the posterior of the
   similarity under a uniform prior bounds the chance that it reaches the threshold; below ``miss`` the pair is dropped.
4. Survivors are verified on their exact shingle sets. Only their texts are shingled again.

Miss chance: a pair at similarity s shares no band with chance (1 - s^rows)^bands, 0.0004 at 0.6 for 3 rows and 32 bands,
and 0.0014 if all its bands are hot and need one of 8 further bands as well; the
pruning adds at most ``miss``.

Edge cases: texts that are null or have under ``min_tokens`` tokens take no part; equal texts count as pairs;
other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .buckets import meeting_pairs
from .tokens import Tokens, band_keys, in_passes, minhash, mix, segment_hashes

HASHES, ROWS = 96, 3
#: Signature entries of one step of the verification.
STEP = 16
#: Bands that a hot band is combined with.
FURTHER = 8
#: Most ids of a Bloom filter.
FILTERED = 8_000_000


@functools.cache
def least_matches(threshold: float, miss: float, step: int = STEP, hashes: int = HASHES) -> tuple[int, ...]:
    """For each number of compared entries, the fewest matches whose posterior chance of reaching ``threshold`` is at least ``miss``.

    Entries are taken to have 8 bits, as in the sketch of bucket rows; full ones agree by chance even less.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(step, hashes + 1, step):
        for m in range(n + 1):
            like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p))
            if like[s >= threshold].sum() >= miss * like.sum():
                break
        out.append(m)
    return tuple(out)


def posterior_survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> np.ndarray:
    """Row numbers of the pairs of signatures (matrices) that no step prunes."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold, miss)):
        part = slice(k * STEP, (k + 1) * STEP)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def _matrix(column: pa.Array | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column.tolist()), np.uint16).reshape(-1, HASHES)


def signatures(texts: DataFrame, width: int, min_tokens: int) -> DataFrame:
    """``(id, f1, f2, signature)`` of every text with at least ``min_tokens`` tokens; f1, f2 name its class. Signature entries have 16 bits."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_passes(batch, "text"):
                t = Tokens([x.lower() for x in part.column("text").to_pylist()])
                grams, offsets = t.shingles(width)
                n = np.diff(offsets)
                rows = np.flatnonzero((t.counts() >= min_tokens) & (n > 0))
                inside = np.repeat(np.isin(np.arange(len(n)), rows), n)
                grams, starts = grams[inside], np.cumsum(n[rows]) - n[rows]
                m = minhash(grams, starts, HASHES).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(rows)),
                        *(pa.array(segment_hashes(g, starts).astype(np.int64)) for g in (grams, grams * np.uint64(0xD6E8FEB86659FD93))),
                        pa.array([x.tobytes() for x in m], pa.binary()),
                    ],
                    ["id", "f1", "f2", "signature"],
                )

    return texts.mapInArrow(sign, "id bigint, f1 bigint, f2 bigint, signature binary")


def _keyed(ids: pa.Array, m: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Bucket rows: each row's keys with its id and, as its sketch, the low bytes of its first STEP entries."""
    per = keys.shape[1]
    head = np.ascontiguousarray(m[:, :STEP].astype(np.uint8)).view(np.int64)
    columns = [keys.ravel(), np.repeat(ids.to_numpy(), per), np.repeat(head[:, 0], per), np.repeat(head[:, 1], per)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "s0", "s1"])


_ROW = "key bigint, id bigint, s0 bigint, s1 bigint"


def _bucket_rows(reps: DataFrame) -> DataFrame:
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("signature"))
            yield _keyed(batch.column("id"), m, band_keys(m, ROWS))

    return reps.select("id", "signature").mapInArrow(bands, _ROW)


def shingle_sets(texts: DataFrame, width: int, among: np.ndarray | None = None) -> DataFrame:
    """``(id, grams)``: the distinct shingle hashes of each text, ascending; with the Bloom filter ``among`` only of ids that pass it."""
    shared = texts.sparkSession.sparkContext.broadcast(among)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared.value is not None:
                at = _bits(batch.column("id").to_numpy(), len(shared.value))
                batch = batch.filter(pa.array((shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool).all(0)))
            for part in in_passes(batch, "text"):
                grams, offsets = Tokens([x.lower() for x in part.column("text").to_pylist()]).shingles(width)
                out = [np.unique(grams[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(out, pa.binary())], ["id", "grams"])

    return texts.mapInArrow(sets, "id bigint, grams binary")


def _bits(ids: np.ndarray, words: int) -> np.ndarray:
    """Bits of each id in a Bloom filter of ``words`` words, as a matrix (2, ids)."""
    h = mix(ids.view(np.uint64))
    return np.stack([h, mix(h + np.uint64(1))]) % np.uint64(64 * words)


def _sets_of(texts: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """``shingle_sets`` of at least the texts whose id is needed.

    Up to FILTERED ids a Bloom filter of 16 bits each (at most 16 MB) goes to the tasks, and no text is shuffled; more are joined by id.
    """
    n = needed.count()
    if n > FILTERED:
        return shingle_sets(texts.join(needed, "id", "left_semi"), width)
    words = max(1, n // 4)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_bits(batch.column("id").to_numpy(), words))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "mark"])

    among = np.zeros(words, np.uint64)
    for r in needed.mapInArrow(marks, "word bigint, mark bigint").groupBy("word").agg(F.bit_or("mark")).toLocalIterator():
        among[r[0]] = np.int64(r[1]).astype(np.uint64)
    return shingle_sets(texts, width, among)


def _exact(threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist(), strict=True)):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                keep.append(both >= threshold * (len(p) + len(q) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return check


def _first_step(threshold: float, miss: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The first step of the verification, on the sketches of bucket rows."""
    least = least_matches(threshold, miss)[0]

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = np.ascontiguousarray(a).view(np.uint8) == np.ascontiguousarray(b).view(np.uint8)
        return same.reshape(-1, STEP).sum(1) >= least

    return test


def _finer(reps: DataFrame, hot: DataFrame) -> DataFrame:
    """Bucket rows for hot bands: a band's key together with that of each of the FURTHER bands after it, so 2 * ROWS entries have to agree."""

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, key = _matrix(batch.column("signature")), batch.column("key").to_numpy()[:, None]
            bands = band_keys(m, ROWS)
            others = (np.argmax(bands == key, axis=1)[:, None] + np.arange(1, FURTHER + 1)) % bands.shape[1]
            both = mix(key.view(np.uint64) ^ mix(np.take_along_axis(bands, others, axis=1).view(np.uint64)))
            yield _keyed(batch.column("id"), m, both.view(np.int64))

    return hot.join(reps, "id").select("id", "key", "signature").mapInArrow(combined, _ROW)


def _verify(threshold: float, miss: float) -> Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame]:
    def verify(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        x, y, out = _matrix(left["signature"]), _matrix(right["signature"]), []
        p, q = left["id"].to_numpy(), right["id"].to_numpy()
        for i in range(len(p)):
            j = np.arange(i + 1 if same else 0, len(q))
            j = j[posterior_survivors(np.broadcast_to(x[i], (len(j), HASHES)), y[j], threshold, miss)]
            out.append(np.stack([np.minimum(p[i], q[j]), np.maximum(p[i], q[j])], axis=1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["a", "b"])

    return verify


def near_duplicate_classes(records: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, width: int = 5, min_tokens: int = 20, miss: float = 1e-4, hot: int = 2048, block: int = 1024) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``members(id, rep, copies)`` of every text that takes part, ``links(a, b)`` between representatives, a < b."""
    texts = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    signed = cut(signatures(texts, width, min_tokens))
    classes = signed.groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    members = signed.select("id", "f1", "f2").join(classes, ["f1", "f2"]).select("id", "rep", "copies")
    reps = cut(signed.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").drop("f1", "f2"))
    sig = reps.select("id", "signature")
    candidates = meeting_pairs(_bucket_rows(reps), sig, _first_step(threshold, miss), functools.partial(_finer, reps), _verify(threshold, miss), hot, block)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = pa.array(posterior_survivors(_matrix(batch.column("sa")), _matrix(batch.column("sb")), threshold, miss))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(alive) for c in ("a", "b")], ["a", "b"])

    both = candidates.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    alive = both.mapInArrow(prune, "a bigint, b bigint")
    alive = cut(alive)
    grams = _sets_of(texts, alive.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width)
    links = alive.join(grams.toDF("a", "grams_a"), "a").join(grams.toDF("b", "grams_b"), "b").select("a", "b", "grams_a", "grams_b").mapInArrow(_exact(threshold), "a bigint, b bigint")
    return members, links


def near_duplicate_pairs(records: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """``(a, b)``, a < b: every pair of rows at or above the threshold, copies expanded. Options as in near_duplicate_classes."""
    members, links = near_duplicate_classes(records, id_col, text_col, **options)
    links = cut(links)
    of = members.select("id", "rep")
    linked = links.join(of.toDF("x", "a"), "a").join(of.toDF("y", "b"), "b").select("x", "y")
    several = members.where("copies > 1").select("id", "rep")
    copies = several.toDF("x", "rep").join(several.toDF("y", "rep"), "rep").where("x < y").select("x", "y")
    return linked.unionAll(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
