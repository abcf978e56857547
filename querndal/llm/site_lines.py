"""Problem 3: lines that recur over the documents of one site.

1. Each line is masked (numbers, dates and names become one placeholder each); MinHash bands over its masked words are its
   locality-sensitive buckets, and the lines of a site that share a bucket form a cluster.
2. A cluster's document frequency is the number of rows that hold any of its lines. It is counted over all rows: a row gives each of
   its distinct buckets once, and counts are combined within a task before the shuffle.
3. The lines of clusters that are frequent in their site are what recurs. With ``exact``, as in ``p3_found``, only these lines are counted each for itself
   (lower case, digit runs as 0, white space runs as one space), and those stay that recur often enough alone. A name is told by its
   capital, in which equal lines may differ, so names stay unmasked there. Then equal lines share all buckets, one band
   finds their cluster, and it is never less frequent than the line: the exact count loses nothing.

Two lines whose masked words have a Jaccard similarity of s share a bucket with chance 1 - (1 - s^4)^8: 0.985 at 0.8, 0.4 at 0.5.

Scale: a line that a third of all rows share costs one counter a task. No line text is shuffled, and of the lines only
those of frequent clusters.

Edge cases: null ``docs`` count as rows of the site and have no lines; blank lines never recur; rows without a site
have no result; repeated rows count singly; a line twice in one row counts once and is reported at each place.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .splitting import _SPACE
from .tokens import U64, _char_values, band_keys, char_classes, code_points, in_passes, list_array, minhash, mix, segment_hashes

#: Month names of the languages of the sites; with a number beside them they are dates.
MONTHS = """january february march april may june july august september october november december
januar februar märz mai juni juli oktober dezember
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre""".split()
NAME, NUMBER, DATE = (U64(x) for x in (0xA11CE, 0x9A7E5, 0xDA7E))


def site_of(metadatas: Column) -> Column:
    """Host of ``url`` (lower case, no port, no leading ``www.``), else the directory of ``source``, else null."""
    url, source = (F.try_element_at(metadatas, F.lit(k)) for k in ("url", "source"))
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r":[0-9]*$", "")
    path = F.regexp_replace(F.translate(source, "\\", "/"), r"^\./", "")
    folder = F.regexp_extract(path, r"^(.*)/", 1)
    return F.when(url.isNotNull(), F.concat(F.lit("h:"), F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit("")))).otherwise(
        F.when(path.contains("/"), F.concat(F.lit("d:"), folder))
    )


@functools.cache
def _upper() -> np.ndarray:
    return np.array([unicodedata.category(chr(c)) in ("Lu", "Lt") for c in range(0x110000)])


@functools.cache
def _month_hashes() -> np.ndarray:
    return np.sort(np.concatenate([segment_hashes(_char_values()[code_points([m])[0]], np.array([0])) for m in MONTHS]))


def line_features(texts: list[str], hashes: int, rows: int, names: bool) -> tuple[np.ndarray, ...]:
    """Of all non-blank lines: text number, line number, key of the normalised line, band keys; ``names``: mask capitalised words, too."""
    lowered = [t.lower() for t in texts]
    cp, offsets = code_points(lowered)
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    feed = cp == 10
    first = np.zeros(len(cp), bool)
    first[offsets[:-1][offsets[:-1] < len(cp)]] = True
    first[1:] |= feed[:-1]
    line = np.cumsum(first) - 1
    space, digit = _SPACE[cp], (cp >= 48) & (cp <= 57)
    same_line = np.zeros(len(cp), bool)
    same_line[1:] = ~first[1:]
    again = np.zeros(len(cp), bool)
    again[1:] = (space[1:] & space[:-1]) | (digit[1:] & digit[:-1])
    ink = ~space
    ink_lines = line[ink]
    # A run of white space stays as one space if ink of its line is on both sides.
    seen = np.cumsum(ink)
    total = np.bincount(ink_lines, minlength=line[-1] + 1 if len(line) else 0)
    through = np.cumsum(total)
    inner = (seen > (through - total)[line]) & (seen < through[line]) if len(line) else space
    keep = (ink | (space & inner)) & ~(again & same_line)
    value = np.where(space, 32, np.where(digit, 48, cp))[keep]
    kept_line = line[keep]
    starts = np.flatnonzero(np.diff(kept_line, prepend=-1))
    key = segment_hashes(_char_values()[value], starts)
    lines = kept_line[starts]  # those with ink
    heads = np.flatnonzero(first)
    owner = text_of[heads[lines]] if len(lines) else lines
    number = lines - line[offsets[owner]] if len(lines) else lines
    # Words for the buckets, with numbers, dates and names masked.
    cls = char_classes()[cp]
    word = cls == 1
    start = (cls == 2) | word
    start[1:] &= ~(word[1:] & word[:-1] & same_line[1:])
    chars = np.flatnonzero(cls)
    at = np.flatnonzero(start[chars])
    words = segment_hashes(_char_values()[cp[chars]], at)
    begin = chars[at]
    word_line = line[begin]
    raw = code_points(texts)[0]
    named = _upper()[raw[begin]] if names and len(raw) == len(cp) else np.zeros(len(begin), bool)
    numeric = np.maximum.reduceat(digit[chars], at) if len(at) else np.zeros(0, bool)
    months = _month_hashes()
    dated = months[np.minimum(np.searchsorted(months, words), len(months) - 1)] == words
    words[named] = NAME
    words[dated] = DATE
    words[numeric] = NUMBER
    # Unmasked words make the set; the placeholders follow with their previous word. Lines without words use their key.
    pair = words.copy()
    pair[1:][word_line[1:] == word_line[:-1]] += mix(words[:-1])[word_line[1:] == word_line[:-1]]
    line_starts = np.flatnonzero(np.diff(word_line, prepend=-1))
    signature = np.tile((key & U64(0xFFFFFFFF)).astype(np.uint32)[:, None], (1, hashes))
    signature[np.searchsorted(lines, word_line[line_starts])] = minhash(mix(pair), line_starts, hashes)
    return owner, number, key.astype(np.int64), band_keys(signature, rows)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in columns sorted together."""
    fresh = np.zeros(len(columns[0]), bool)
    fresh[:1] = True
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(fresh)


def cluster_frequencies(docs: DataFrame, hashes: int, rows: int, names: bool) -> DataFrame:
    """``(site, bucket, n)``: in how many rows of ``(ord, docs, site)`` a site's bucket occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_passes(batch, "docs"):
                owner, _, _, bands = line_features(part.column("docs").to_pylist(), hashes, rows, names)
                of, bucket = np.repeat(owner, bands.shape[1]), bands.ravel()
                order = np.lexsort((bucket, of))
                once = order[_heads(of[order], bucket[order])]
                site, bucket = part.column("site").to_numpy()[of[once]], bucket[once]
                order = np.lexsort((bucket, site))
                site, bucket = site[order], bucket[order]
                head = _heads(site, bucket)
                yield pa.RecordBatch.from_arrays([pa.array(site[head]), pa.array(bucket[head]), pa.array(np.diff(np.append(head, len(site))))], ["site", "bucket", "n"])

    return docs.mapInArrow(count, "site bigint, bucket bigint, n bigint").groupBy("site", "bucket").agg(F.sum("n").alias("n"))


def distinct_lines(docs: DataFrame, hashes: int, rows: int, names: bool) -> DataFrame:
    """One row for each distinct line of a row: ``(ord, site, line_key, buckets, line_nos)``."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_passes(batch, "docs"):
                owner, number, key, bands = line_features(part.column("docs").to_pylist(), hashes, rows, names)
                order = np.lexsort((number, key, owner))
                owner, number, key, bands = owner[order], number[order], key[order], bands[order]
                head = _heads(owner, key)
                where = pa.array(owner[head])
                buckets = list_array(bands[head].ravel(), np.arange(len(head) + 1) * bands.shape[1], pa.int64())
                numbers = list_array(number.astype(np.int32), np.append(head, len(number)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("ord").take(where), part.column("site").take(where), pa.array(key[head]), buckets, numbers], ["ord", "site", "line_key", "buckets", "line_nos"])

    return docs.mapInArrow(lines, "ord bigint, site bigint, line_key bigint, buckets array<bigint>, line_nos array<int>")


def repeated_lines(records: DataFrame, min_rows: int = 5, min_share: float = 0.1, exact: bool = True, hashes: int = 32, rows: int = 4) -> DataFrame:
    """``(ord, line_no)`` of every line of ``docs`` that recurs in at least ``min_rows`` rows and ``min_share`` of its site's rows.

    With ``exact`` a line recurs that is equal to others, else one of a frequent cluster of near-duplicate lines.
    """
    sited = records.select("ord", "docs", site_of(F.col("metadatas")).alias("site")).where("site is not null").select("ord", "docs", F.xxhash64("site").alias("site"))
    share = F.lit(str(min_share)).cast("decimal(9,8)")
    sites = sited.groupBy("site").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).select("site", F.greatest(F.lit(min_rows), F.ceil(F.col("n") * share)).cast("bigint").alias("least"))
    docs = sited.where("docs is not null")
    features = (rows, rows, False) if exact else (hashes, rows, True)
    frequent = cut(cluster_frequencies(docs, *features).where(F.col("n") >= min_rows).join(sites, "site").where("n >= least").select("site", "bucket", "least"))
    found = distinct_lines(docs, *features).select("ord", "site", "line_key", "line_nos", F.explode("buckets").alias("bucket")).join(frequent, ["site", "bucket"])
    if not exact:
        return found.select("ord", F.explode("line_nos").alias("line_no")).distinct()
    found = cut(found.select("ord", "site", "line_key", "line_nos", "least"))
    wanted = found.groupBy("site", "line_key").agg(F.count(F.lit(1)).alias("df"), F.min("least").alias("least")).where("df >= least").select("site", "line_key")
    return found.join(wanted, ["site", "line_key"]).select("ord", F.explode("line_nos").alias("line_no"))


def strip_repeated_lines(records: DataFrame, repeated: DataFrame) -> DataFrame:
    """``(ord, docs, removed)``: every record without its repeated lines; ``removed`` counts them.

    At most one row of line numbers a record is joined, so the join is keyed by the unique ``ord``.
    """
    drop = repeated.groupBy("ord").agg(F.collect_set("line_no").alias("drop"))
    kept = F.expr("array_join(filter(split(docs, '\\n', -1), (line, i) -> drop is null or not array_contains(drop, i)), '\\n')")
    return records.select("ord", "docs").join(drop, "ord", "left").select("ord", kept.alias("docs"), F.coalesce(F.size("drop"), F.lit(0)).alias("removed"))
