"""Problem 7: evaluation items whose passages turn up in training texts.

The test items form a BM25 inverted index: of each token the blocks of items that hold it, with the best weight in the block, and the items with
their weights. Every training text is cut into overlapping passages, and each passage is a query over its distinct tokens,
answered as in block-max WAND, for many passages at once:

1. The pivot: a passage's tokens are taken in ascending order of their best weight in any item. As long as the sum stays under the
   least threshold of all items, an item that holds only these tokens can't be retrieved, so their postings are not opened.
2. The blocks in the postings of the other tokens are candidates. Their best weights there and the best weights of the unopened tokens anywhere
   bound what a block's items can score, more narrowly the block's best weights over all tokens; blocks whose bound stays under their lowest
   threshold are left.
3. The items of the other blocks are scored exactly, and all at or above their threshold are retrieved.
4. Verification: passage and item must share a run of ``run`` tokens.

An item's threshold is the least score that one of its own runs of ``run`` tokens reaches. A passage that
holds such a run scores at least that, and passages overlap by ``run`` - 1 tokens, so nothing is lost before the
verification.

Scale: texts are read once and not shuffled; the index, about 60 bytes a token of the items, is broadcast. Its size is checked: items beyond
``max_index_chars`` are handled in slices by hash, one pass each.

Edge cases: null, empty and short texts (under ``run`` tokens) on either side give no rows; repeated
items and documents are reported under each id; both texts are brought to NFKC and lower case.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Tokens, in_passes


def normal(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "").lower()


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), and to which range each belongs."""
    n = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(len(owner)), owner


def _place(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Where each code stands, or -1."""
    if not len(sorted_codes):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return np.where(sorted_codes[at] == codes, at, -1)


class ItemIndex:
    """Postings of the items' tokens with BM25 weights and block maxima, and each item's threshold.

    ``code`` is token * items + item in ascending order, ``block_code`` token * blocks + block; the postings of a token are the stretch
    that ``block_at`` gives. Items come in the order of their texts, so that like ones share blocks and maxima are tight.
    """

    def __init__(self, item_ids: list[int], texts: list[str | None], run: int, block: int = 16, k1: float = 1.2, b: float = 0.75):
        self.run, self.block = run, block
        t = Tokens([normal(x) for x in texts])
        long = np.flatnonzero(t.counts() >= run)
        self.items = np.array(item_ids, np.int64)[long]
        self.vocabulary, words = np.unique(t.hash, return_inverse=True)
        self.n, lengths = len(long), t.counts()[long]
        self.blocks = -(-self.n // block)
        at, item = _spans(t.offsets[long], t.offsets[long + 1])
        self.code, tf = np.unique(words[at].astype(np.int64) * max(self.n, 1) + item, return_counts=True)
        term, slot = self.code // max(self.n, 1), self.code % max(self.n, 1)
        df = np.bincount(term, minlength=len(self.vocabulary))
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        self.weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[slot] / (lengths.mean() if self.n else 1)))
        self.block_code, first = np.unique(term * max(self.blocks, 1) + slot // block, return_index=True)
        self.block_max = np.maximum.reduceat(self.weight, first) if len(first) else self.weight
        self.block_at = np.searchsorted(self.block_code, np.arange(len(self.vocabulary) + 1) * max(self.blocks, 1))
        self.best = np.zeros(len(self.vocabulary))
        np.maximum.at(self.best, term, self.weight)
        self.thresholds = np.full(self.blocks * block, np.inf)
        for j, i in enumerate(long):
            w = words[t.offsets[i] : t.offsets[i + 1]]
            runs = np.sort(np.lib.stride_tricks.sliding_window_view(w, run), axis=1).astype(np.int64)
            fresh = np.concatenate([np.ones((len(runs), 1), bool), np.diff(runs, axis=1) != 0], axis=1)
            scores = self.weight[np.searchsorted(self.code, runs * self.n + j)] * fresh
            self.thresholds[j] = scores.sum(1).min() * (1 - 1e-9)  # room for sums in another order
        self.block_least = self.thresholds.reshape(self.blocks, block).min(1) if self.n else self.thresholds
        grams, offsets = t.shingles(run)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        slot_of = np.full(len(texts), -1, np.int64)
        slot_of[long] = np.arange(self.n)
        self.gram_hash, self.gram_item = grams, slot_of[owner]
        order = np.lexsort((self.gram_item, self.gram_hash))
        self.gram_hash, self.gram_item = self.gram_hash[order], self.gram_item[order]

    def term_ids(self, hashes: np.ndarray) -> np.ndarray:
        at = _place(self.vocabulary, hashes)
        return np.where(at < 0, len(self.vocabulary), at)

    def retrieve(self, terms: np.ndarray, passage: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray]:
        """All (passage, item slot) whose score reaches the item's threshold; terms come with their passage, ascending, distinct."""
        got_p, got_i = [], []
        for low in range(0, passages, 4096):
            a, b = np.searchsorted(passage, [low, low + 4096])
            p, t = passage[a:b] - low, terms[a:b]
            if not len(p):
                continue
            order = np.lexsort((self.best[t], p))
            p, t = p[order], t[order]
            start = np.searchsorted(p, np.arange(4097))
            sums = np.cumsum(self.best[t])
            before = np.concatenate([[0.0], sums])[start[p]]
            opened = sums - before >= self.block_least.min() * (1 - 1e-9)  # from the pivot on
            at, owner = _spans(self.block_at[t[opened]], self.block_at[t[opened] + 1])
            pairs, pair = np.unique(p[opened][owner] * self.blocks + self.block_code[at] % self.blocks, return_inverse=True)
            cp, cb = pairs // self.blocks, pairs % self.blocks
            # What the opened postings say of a block, and at most the best weights of all other tokens.
            rest = np.bincount(p[~opened], self.best[t[~opened]], minlength=4096)
            near = np.bincount(pair, self.block_max[at], minlength=len(pairs)) + rest[cp] >= self.block_least[cb] * (1 - 1e-9)
            cp, cb = cp[near], cb[near]
            if not len(cp):
                continue
            at, owner = _spans(start[cp], start[cp + 1])
            found = _place(self.block_code, t[at] * self.blocks + cb[owner])
            bound = np.bincount(owner, np.where(found < 0, 0.0, self.block_max[found]), minlength=len(cp))
            keep = bound >= self.block_least[cb]
            cp, cb = cp[keep], cb[keep]
            if not len(cp):
                continue
            # The items of the blocks, from the postings of the passage's tokens.
            at, owner = _spans(start[cp], start[cp + 1])
            first = t[at] * self.n + cb[owner] * self.block
            lo = np.searchsorted(self.code, first)
            hi = np.searchsorted(self.code, np.minimum(first + self.block, (t[at] + 1) * self.n))
            at, term = _spans(lo, hi)
            key, pair = np.unique(cp[owner[term]] * self.n + self.code[at] % self.n, return_inverse=True)
            score = np.bincount(pair, self.weight[at], minlength=len(key))
            good = key[score >= self.thresholds[key % self.n]]
            got_p.append(good // self.n + low)
            got_i.append(good % self.n)
        return (np.concatenate(got_p), np.concatenate(got_i)) if got_p else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def leaks(self, texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(text number, item id) of all texts that share a run with an item, each once."""
        t = Tokens([normal(x) for x in texts])
        run, stride = self.run, width - self.run + 1
        n = t.counts()
        none = np.zeros(0, np.int64)
        if not self.blocks or not (n >= run).any():
            return none, none
        count = np.where(n >= run, np.maximum(1, -(-(n - width) // stride) + 1), 0)
        text_of = np.repeat(np.arange(len(texts)), count)
        first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        begin = t.offsets[text_of] + first * stride
        end = np.minimum(begin + width, t.offsets[text_of + 1])
        size = end - begin
        at, passage = _spans(begin, end)
        terms = self.term_ids(t.hash)[at]
        known = terms < len(self.vocabulary)
        code = np.unique(passage[known] * np.int64(len(self.vocabulary) + 1) + terms[known])
        p, slot = self.retrieve(code % (len(self.vocabulary) + 1), code // (len(self.vocabulary) + 1), len(size))
        # Verification: the runs of each retrieved passage against those of its item.
        grams, offsets = t.shingles(run)
        shift = offsets[text_of[p]] - t.offsets[text_of[p]]
        low, m = begin[p] + shift, np.maximum(size[p] - run + 1, 0)
        at, pair = _spans(low, low + m)
        wanted, have = slot[pair], grams[at]
        lo, hi = np.searchsorted(self.gram_hash, have), np.searchsorted(self.gram_hash, have, "right")
        hit = np.zeros(len(p), bool)
        for k in range(int((hi - lo).max(initial=0))):
            ok = np.flatnonzero(lo + k < hi)
            ok = ok[self.gram_item[lo[ok] + k] == wanted[ok]]
            hit[pair[ok]] = True
        found = np.unique(np.stack([text_of[p[hit]], slot[hit]]), axis=1)
        return found[0], self.items[found[1]]


def leaked_items(docs: DataFrame, items: DataFrame, run: int = 12, width: int = 48, max_index_chars: int = 20_000_000) -> DataFrame:
    """``(doc_id, item_id)`` of every document that shares at least ``run`` consecutive tokens with a test item."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("bigint"), "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    slices = max(1, -(-int(size) // max_index_chars))
    docs = docs.select("doc_id", "text").where("text is not null")

    def against(part: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == part).orderBy("text", "item_id").collect()
        index = spark.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], run))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in in_passes(batch, "text"):
                    text, item = index.value.leaks(x.column("text").to_pylist(), width)
                    yield pa.RecordBatch.from_arrays([x.column("doc_id").take(pa.array(text)), pa.array(item)], ["doc_id", "item_id"])

        return docs.mapInArrow(find, "doc_id bigint, item_id bigint")

    return reduce(DataFrame.unionAll, [against(i) for i in range(slices)])
