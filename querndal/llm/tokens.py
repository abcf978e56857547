"""Vectorised tokens, shingles and MinHash over batches of texts.

A batch of texts is one array of code points, so that tokenising, hashing and MinHash are a few numpy
passes over the batch in place of a Python loop over tokens.

Token: one character in U+3040-30FF or U+3400-9FFF, or else a longest run of other letters and digits
(Unicode categories L and N), after lower-casing.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
OTHER, WORD, SINGLE = 0, 1, 2
#: Code points of one numpy pass; bounds a worker's memory whatever the Arrow batch holds.
PASS_CHARS = 1_000_000


@functools.cache
def char_classes() -> np.ndarray:
    """OTHER, WORD or SINGLE of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LN":
            out[c] = WORD
    out[0x3040:0x3100] = SINGLE
    out[0x3400:0xA000] = SINGLE
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.cache
def _char_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=U64) * U64(0x9E3779B97F4A7C15))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), U64(0x5851F42D4C957F2D), U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text starts (one more entry for the end)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    return cp, offsets


def segment_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each consecutive segment of ``values``; ``starts`` is increasing from 0, no segment is empty."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = np.diff(np.append(starts, len(values)))
    at = np.arange(len(values)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(values * powers(int(lengths.max()))[at], starts) + lengths.astype(U64))


class Tokens:
    """Tokens of a batch: ``hash`` of each, ``offsets`` by text, ``start`` in the joined code points."""

    def __init__(self, texts: list[str]):
        cp, offsets = code_points(texts)
        cls = char_classes()[cp]
        first = np.zeros(len(cp) + 1, bool)
        first[offsets] = True
        word = cls == WORD
        before = np.zeros(len(cp), bool)
        before[1:] = word[:-1]
        start = (cls == SINGLE) | (word & (~before | first[:-1]))
        chars = np.flatnonzero(cls)
        starts = np.flatnonzero(start[chars])
        self.start = chars[starts]
        self.hash = segment_hashes(_char_values()[cp[chars]], starts)
        self.offsets = np.searchsorted(self.start, offsets)
        self.char_offsets = offsets

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k tokens (repeats kept) and their offsets by text."""
        n = np.maximum(self.counts() - k + 1, 0)
        offsets = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=offsets[1:])
        at = np.repeat(self.offsets[:-1] - offsets[:-1], n) + np.arange(offsets[-1])
        p, h = powers(k), np.zeros(len(at), U64)
        for j in range(k):
            h += self.hash[at + j] * p[j]
        return mix(h), offsets


def in_passes(batch: pa.RecordBatch, column: str, most: int = PASS_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with at most about ``most`` bytes of text each; one longer text is a slice of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    ends, start, total = [], 0, 0
    for i, s in enumerate(sizes.tolist()):
        if total and total + s > most:
            ends.append((start, i))
            start, total = i, 0
        total += s
    if start < len(sizes):
        ends.append((start, len(sizes)))
    for a, b in ends:
        yield batch.slice(a, b - a)


@functools.cache
def _minhash_parameters(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets; the first n are the same whatever n."""
    drawn = np.random.default_rng(seed).integers(0, 2**63, (n, 2), dtype=U64)
    return drawn[:, 0] * U64(2) + U64(1), drawn[:, 1]


def minhash(values: np.ndarray, starts: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """uint32 matrix, segments by ``n`` hash functions; ``starts`` as in segment_hashes."""
    a, b = _minhash_parameters(n, seed)
    out = np.empty((n, len(starts)), np.uint32)
    if len(starts):
        for i in range(n):
            out[i] = np.minimum.reduceat(((values * a[i] + b[i]) >> U64(32)).astype(np.uint32), starts)
    return out.T


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """int64 matrix, one key for each band of ``rows`` signature entries; keys of different bands differ."""
    n, width = signatures.shape
    bands = width // rows
    s = signatures[:, : bands * rows].reshape(n, bands, rows).astype(U64)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), (n, bands)).copy()
    for j in range(rows):
        key = mix(key ^ (s[:, :, j] + U64(0x9E3779B97F4A7C15)))
    return key.astype(np.int64)


def list_array(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))
