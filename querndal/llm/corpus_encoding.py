"""Problem 6: encode a corpus with a public byte-level BPE by corpus-level merge replay.

The words of many texts are laid out as one linked list of symbols. An inverted index from token pair to the
positions where it stands then replays the merges in rank order: a merge touches all its positions at
once, and only the pairs with a changed neighbour are looked up and indexed anew. Replaying by rank over
all words gives each word what merging its own lowest rank first gives it, as words share no symbols.

The replay runs over the distinct words of a stretch of a partition (``stretch_bytes``), so the corpus is read once and
never shuffled, and a word that recurs is merged once a stretch.

Edge cases: null and empty texts have the empty list; strings of special tokens are ordinary text; a text of any
length is encoded whole; rows keep their number, repeated ids included.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how the public byte-level BPE splits text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Merges:
    """The merge table of a tokenizer file: pair codes in ascending order with their ranks, and what each rank makes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_ids = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.base = np.int64(max(vocab.values()) + 1)
        code = self.left * self.base + self.right
        self.rank = np.argsort(code, kind="stable")
        self.code = code[self.rank]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where they don't merge."""
        code = a * self.base + b
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where((self.code[at] == code) & (a >= 0) & (b >= 0), self.rank[at], -1)


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words, one after another, and where each word's begin (with the end)."""
    if not words:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"\0".join([*words, b""]), np.uint8)  # one slot after each word stops merges
    symbol = merges.byte_ids[raw]
    stops = np.cumsum(sizes + 1) - 1
    symbol[stops] = -1
    after = np.arange(1, len(raw) + 1)
    before = np.arange(-1, len(raw) - 1)
    before[0] = len(raw) - 1  # a stop
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def post(at: np.ndarray) -> None:
        """Index the pairs that begin at these positions."""
        rank = merges.ranks(symbol[at].astype(np.int64), symbol[after[at]].astype(np.int64))
        at, rank = at[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        edges = np.flatnonzero(np.diff(rank)) + 1
        for r, places in zip(rank[np.concatenate([[0], edges])].tolist() if len(rank) else (), np.split(at, edges), strict=False):
            if r in index:
                index[r].append(places)
            else:
                index[r] = [places]
                heapq.heappush(queue, r)

    post(np.flatnonzero(symbol >= 0))
    while queue:
        r = heapq.heappop(queue)
        found = index.pop(r)
        at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
        left, right = merges.left[r], merges.right[r]
        at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
        if left == right and len(at) > 1:  # in a run of one symbol every second pair merges, from the left
            fresh = np.concatenate([[True], at[1:] != after[at[:-1]]])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        symbol[at] = merges.made[r]
        symbol[gone] = -2
        after[at] = after[gone]
        before[after[at]] = at
        touched = np.concatenate([at, before[at]])
        post(np.unique(touched[symbol[touched] >= 0]))
    kept = np.flatnonzero(symbol >= 0)
    bounds = np.concatenate([[0], np.searchsorted(kept, stops)])
    return symbol[kept], bounds


def encode_texts(texts: list[str | None], merges: Merges, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, one after another, and their offsets."""
    number: dict[str, int] = {}
    uses, counts = [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        found = [number.setdefault(w, len(number)) for w in pattern.findall(text or "")]
        counts[i + 1] = len(found)
        uses.append(np.array(found, np.int32))
    ids, bounds = replay([w.encode("utf-8", "surrogatepass") for w in number], merges)
    use = np.concatenate(uses) if uses else np.zeros(0, np.int32)
    n = np.diff(bounds)[use]
    ends = np.cumsum(n)
    out = ids[np.repeat(bounds[use] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    return out, np.concatenate([[0], ends])[np.cumsum(counts)]


def encode_corpus(docs: DataFrame, id_col: str, text_col: str, tokenizer_file: str, stretch_bytes: int = 16_000_000) -> DataFrame:
    """``(id, ids)`` of every row. The merge table (1 MB, fixed by the tokenizer) is broadcast; docs are scanned once."""
    table = docs.sparkSession.sparkContext.broadcast(Merges(tokenizer_file))
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, pattern, held, size = table.value, regex.compile(WORD_PATTERN), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            flat, offsets = encode_texts([x for b in held for x in b.column(1).to_pylist()], merges, pattern)
            row = 0
            for b in held:
                o = offsets[row : row + b.num_rows + 1]
                row += b.num_rows
                lists = pa.ListArray.from_arrays(pa.array((o - o[0]).astype(np.int32)), pa.array(flat[o[0] : o[-1]], pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], [id_col, "ids"])

        for batch in batches:
            for part in _by_size(batch, stretch_bytes):
                held.append(part)
                size += part.column(1).nbytes
                if size >= stretch_bytes:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>")


def _by_size(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    from .tokens import in_passes

    return in_passes(batch, batch.schema.names[1], most)
