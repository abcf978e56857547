"""Problem 8: sentence boundaries by a hidden-event n-gram language model.

Where a sentence may end (a *slot*: after an end mark with its closing quotes, outside quotes and brackets, or at a space
after Thai), a boundary event is or is not hidden between two words. The model holds, for every such place,

* the chance of an event after the left word, apart for words that begin a sentence themselves,
* the distribution of words after an event, and of words that continue a sentence.

It is trained on the corpus it is applied to, without labels: paragraph ends are certain events and paragraph beginnings words after an
event; all other slots count with their posterior in a few EM rounds. Forward-backward over each run of adjacent slots (an
abbreviation that follows a possible end begins a sentence or not) gives the posteriors that decide.
Words outside the model's vocabulary are taken by their shape. Counts cover all texts; the vocabulary keeps every word and pair from a
share of FLOOR of its kind on, which bounds what is broadcast by 1 / FLOOR entries at any size of the corpus.

Fixed by definition, not by the model: a blank line ends a sentence; quotes and brackets that are closed within their paragraph
hide what they hold; without an end mark (or a space after Thai) there is no slot, as a text without any end is one sentence.

The texts are read once: the same pass counts what the model learns from and keeps the slots, which are decided when the model is
there. All steps are linear in the text.

Edge cases: null, empty and blank texts give no rows; a paragraph without any end is one sentence; unclosed quotes are ordinary
characters; offsets count code points; repeated rows are repeated in the result.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .splitting import WHITE_SPACE
from .tokens import in_passes

_WS = "".join(map(chr, WHITE_SPACE))
_BREAKS = "\n\r\x0b\x0c\x85  "
#: End marks (the second list needs no space behind it), and quotes and brackets by their opening one.
MARKS, FREE_MARKS = ".!?…؟‼⁇⁈⁉", "。！？｡．।॥"
CLOSING = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "《": "》", "「": "」", "『": "』", "«": "»", "“": "”", "„": "“", '"': '"', "‚": "‘"}
_CLOSERS = "".join(dict.fromkeys(CLOSING.values()))
_CJK = "぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ"

_line_ends = re.compile(f"[{_BREAKS}][{_WS}]*")
_is_break = re.compile(f"\r\n|[{_BREAKS}]")
_bracket = re.compile("[" + re.escape("".join(CLOSING) + _CLOSERS) + "]")
_marks = re.compile(f"[{re.escape(MARKS + FREE_MARKS)}][{re.escape(MARKS + FREE_MARKS + _CLOSERS)}]*")
_THAI = "[\u0e00-\u0e7f]"
_thai = re.compile(_THAI)
_chunk = re.compile(f"[^{_WS}]+")
_thai_space = re.compile(f"[ \xa0\u3000]+(?=[^{_WS}])")
_address = re.compile(r"[/@\\]|www\.")
_marker = re.compile(rf"(?:[-*•–·#]+\d*|\(?\d{{1,3}}[.)]|\(?[A-Za-z][.)]|[^\W\d_]{{1,8}}(?: \d{{1,3}})?[:：])[{_WS}]+")
_STOPS_LEFT = frozenset(_WS + "".join(CLOSING) + _CLOSERS + "".join(c for c in map(chr, range(0x3040, 0xFFA0)) if re.match(f"[{_CJK}]", c)))
_FREE = frozenset(FREE_MARKS)
#: Right words: in scripts without spaces the first characters, else up to white space; what is longer than 64 characters is no word.
_RIGHT = rf"[{_CJK}]{{1,2}}|{_THAI}{{1,4}}|[^{_WS}{_CJK}\u0e00-\u0e7f]{{1,64}}"
_right_word = re.compile(_RIGHT)
_cjk = re.compile(f"[{_CJK}]")
_title = re.compile(r"[^\W\d_a-z][^\W\d_A-Z]* ")
_capital = re.compile(r"[¿¡„«“—\"(]*[^\W\d_a-z]")
_number = re.compile(r"0(?:[.,:]0)*\.")
_digits = re.compile(r"\d+")
MID, FIRST, ADJACENT = 0, 1, 2
#: Counts with which a left word's own ends outweigh those of words of its shape.
FEW = 3.0
#: Weight of the general distribution beside a left word's own counts.
BACKOFF = 20.0
#: Share of all slots or words from which a word or pair is kept.
FLOOR = 5e-7
#: The left word of a slot at a space after Thai.
THAI = "ก "


class Slot(NamedTuple):
    at: int  # where the sentence would end
    after: int  # where the next one would begin
    left: str
    flag: int  # left word: within a sentence, first of its paragraph, or right behind the previous slot
    right: str


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Spans between blank lines, without white space around them."""
    start = 0
    ends = [m.span() for m in _line_ends.finditer(text) if len(_is_break.findall(m.group())) > 1]
    for low, high in [*ends, (len(text), len(text))]:
        part = text[start:low]
        inner = part.strip(_WS)
        if inner:
            a = start + len(part) - len(part.lstrip(_WS))
            yield a, a + len(inner)
        start = high


def enclosed(p: str) -> list[tuple[int, int]]:
    """Outermost spans of quotes and brackets that are closed within the paragraph, as (first, last) character."""
    stack: list[tuple[str, int]] = []
    awaited: Counter = Counter()  # closing characters of the stack
    spans: list[tuple[int, int]] = []
    for m in _bracket.finditer(p):
        c, i = m.group(), m.start()
        if awaited[c]:
            while True:
                opening, at = stack.pop()
                awaited[CLOSING[opening]] -= 1
                if CLOSING[opening] == c:
                    break
            spans.append((at, i))
        elif c in CLOSING:
            stack.append((c, i))
            awaited[CLOSING[c]] += 1
    spans.sort()
    outer: list[tuple[int, int]] = []
    for a, b in spans:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _word(s: str) -> str:
    return _digits.sub("0", s if s.isascii() else unicodedata.normalize("NFKC", s))


def _right(p: str, at: int) -> str:
    m = _right_word.match(p, at)
    w = _word(m.group()) if m else ""
    return w.rstrip(".,;:!?…") or w


def _ink_before(p: str, at: int) -> int:
    """End of the last ink before a place."""
    while at and p[at - 1] in _WS:
        at -= 1
    return at


def _back_to(p: str, at: int, least: int, stops: Callable[[str], object]) -> int:
    """The furthest place before ``at`` and not before ``least`` that no stop separates from it."""
    while at > least and not stops(p[at - 1]):
        at -= 1
    return at


_not_closer = lambda c: c not in _CLOSERS


def _clusters(p: str) -> Iterator[tuple[int, int, bool]]:
    """Runs of end marks with the closing quotes and brackets around them."""
    done = 0
    for m in _marks.finditer(p):
        yield _back_to(p, m.start(), done, _not_closer), m.end(), False
        done = m.end()


def _thai_runs(p: str) -> list[tuple[int, int]]:
    """(end of the first Thai character, next word) of each run of ink that holds Thai and that a space follows."""
    out = []
    if _thai.search(p):
        for c in _chunk.finditer(p):
            if (t := _thai.search(p, *c.span())) and (space := _thai_space.match(p, c.end())):
                out.append((t.end(), space.end()))
    return out


class _Addresses:
    """Does the run of ink before a place hold a sign of an address? Asked in ascending order."""

    def __init__(self, p: str):
        self.p, self.at, self.run, self.found = p, 0, 0, False

    def before(self, a: int) -> bool:
        begin, low = _back_to(self.p, a, self.at, _WS.__contains__), max(self.run, self.at - 4)
        if begin > self.at or not self.at:
            self.run, self.found, low = begin, False, begin
        self.found = self.found or bool(_address.search(self.p, low, a))
        self.at = a
        return self.found


def _unspaced(p: str, a: int, b: int, addresses: _Addresses) -> bool:
    """May the end cluster p[a:b] end a sentence though no white space follows?"""
    if p[b - 1] in FREE_MARKS or p[b - 1] in "」』）】》" or not _FREE.isdisjoint(p[a:b]) or (a and _cjk.match(p[a - 1])):
        return True
    if p[b - 1] in '"”“»)' and re.match(r"[^\W_a-z]", p[b]):
        return True
    if not (_capital.match(p, b) and a > 1 and (p[a - 2 : a].islower() or p[a - 1].isdigit() and _title.match(p, b))):
        return False
    return not addresses.before(a)


def slots(p: str) -> tuple[list[Slot], Slot]:
    """The possible ends within a paragraph, and its certain end."""
    spans, out, k, n = enclosed(p), [], 0, len(p)
    m = _marker.match(p)
    body = m.end() if m else 0
    previous, last = -1, None
    addresses, thais, t = _Addresses(p), _thai_runs(p), 0
    places = _clusters(p)
    if thais:
        places = heapq.merge(places, ((a, b, True) for a, b in thais))
    for a, b, thai in places:
        if not thai and thais:  # a mark within a run of Thai ends nothing
            while t < len(thais) and thais[t][1] <= a:
                t += 1
            if t < len(thais) and thais[t][0] <= a:
                continue
        end = _ink_before(p, b) if thai else b
        while k < len(spans) and spans[k][1] < a:
            k += 1
        if k < len(spans) and spans[k][0] < end - 1 < spans[k][1]:
            # The cluster may go on beyond the closing quote, or stop right before it.
            continue
        if not thai and b < n and p[b] not in _WS and not _unspaced(p, a, b, addresses):
            continue
        opened = next((s for s in spans[max(k - 1, 0) : k + 1] if s[1] == end - 1 or a <= s[1] < end), None)
        if thai:
            left, start = THAI, a
        else:
            mark = p[a:b]
            start = _back_to(p, a, max(previous, 0), _STOPS_LEFT.__contains__)
            left = _word(p[start:a]) + mark
            if _number.match(left):
                ink = _ink_before(p, start)
                if ink:
                    # A number says little: ``for 7.`` ends, ``Am 7.`` goes on.
                    left = f"{_word(p[_back_to(p, ink, 0, _WS.__contains__) : ink])} {left}"
            if p[b - 1] in FREE_MARKS:
                left = mark
            if opened:
                ink = _ink_before(p, opened[0])
                begins = not ink or opened[0] == body or p[ink - 1] in MARKS + FREE_MARKS + _CLOSERS or opened[0] == previous
                left = ("^" if begins else ":" if p[ink - 1] in ":：" else "-") + mark
                start = opened[0]
        after = end
        while after < n and p[after] in _WS:
            after += 1
        flag = FIRST if start <= body else ADJACENT if start == previous else MID
        slot = Slot(end, after, left, flag, _right(p, after) if after < n else "")
        if after >= n:
            last = slot
        else:
            out.append(slot)
        previous = after
    if not last and p and _thai.search(p, _back_to(p, n, 0, _WS.__contains__)):
        last = Slot(n, n, THAI, MID, "")
    return out, last or Slot(n, n, "", MID, "")


def shape(w: str) -> str:
    """What a word outside the vocabulary counts as: its first characters' kinds and its end mark."""
    out = ""
    for c in w:
        k = unicodedata.category(c)
        k = "X" if k in ("Lu", "Lt") else "x" if k == "Ll" else "c" if k[0] in "LM" else "0" if k[0] == "N" else c
        if not out.endswith(k):
            out += k
    return "~" + (out if len(out) <= 6 else out[:3] + out[-3:])


class Model(NamedTuple):
    """Bigram tables around a slot.

    ``event``: chance of an event by left word and flag. ``after`` and ``within``: right words behind an event and without one.
    ``pairs`` and ``left_within``: right words without an event behind a given left word, smoothed by ``within``.
    """

    event: dict[tuple[str, int], float]
    after: dict[str, float]
    within: dict[str, float]
    pairs: dict[tuple[str, str], float]
    left_within: dict[str, float]
    prior: float

    def left(self, w: str) -> str:
        return w if (w, MID) in self.event or (w, FIRST) in self.event else shape(w)

    def right(self, w: str) -> str:
        return w if w in self.after else shape(w)

    def chance(self, left: str, flag: int) -> float:
        return self.event.get((left, flag), self.event.get((left, MID), self.prior))

    def likelihood(self, left: str, right: str) -> float:
        """How much likelier the right word is behind an event than without one."""
        rare = 1e-6
        within = (self.pairs.get((left, right), 0.0) + BACKOFF * self.within.get(right, rare)) / (self.left_within.get(left, 0.0) + BACKOFF)
        return min(max(self.after.get(right, rare) / within, 1e-4), 1e4)

    def posteriors(self, s: list[Slot]) -> list[float]:
        """Forward-backward over the two states (event or none) of each slot."""
        n = len(s)
        lefts = [self.left(x.left) for x in s]
        lik = [self.likelihood(w, self.right(x.right)) for w, x in zip(lefts, s, strict=True)]
        mid = [self.chance(w, FIRST if x.flag == FIRST else MID) for w, x in zip(lefts, s, strict=True)]
        first = [self.chance(w, FIRST) if x.flag == ADJACENT else m for w, x, m in zip(lefts, s, mid, strict=True)]
        fwd, back = [(0.0, 0.0)] * n, [(1.0, 1.0)] * n
        yes = 0.0
        for i in range(n):
            p = first[i] * yes + mid[i] * (1 - yes) if s[i].flag == ADJACENT else mid[i]
            a, b = p * lik[i], 1 - p
            yes = a / (a + b) if a + b else 0.0
            fwd[i] = (yes, 1 - yes)
        for i in range(n - 2, -1, -1):
            if s[i + 1].flag == ADJACENT:
                on, off = back[i + 1]
                a, b = (p * lik[i + 1] * on + (1 - p) * off for p in (first[i + 1], mid[i + 1]))
                back[i] = (a / (a + b), b / (a + b)) if a + b else (0.5, 0.5)
        return [f[0] * b[0] / ((f[0] * b[0] + f[1] * b[1]) or 1.0) for f, b in zip(fwd, back, strict=True)]


def scan(text: str | None) -> Iterator[tuple[int, int, list[Slot], Slot]]:
    """Paragraphs of a text with their slots and certain ends; slots count from the paragraph."""
    for a, b in paragraphs(text or ""):
        yield a, b, *slots(text[a:b])


def decide(a: int, b: int, s: list[Slot], model: Model) -> Iterator[tuple[int, int]]:
    """The sentences of a paragraph."""
    start = a
    for x, chance in zip(s, model.posteriors(s), strict=True):
        if chance >= 0.5:
            yield start, a + x.at
            start = a + x.after
    if start < b:
        yield start, b


def find_sentences(text: str | None, model: Model) -> list[tuple[int, int]]:
    return [x for a, b, s, _ in scan(text) for x in decide(a, b, s, model)]


_after_comma = re.compile(rf"[，、：](?=([{_CJK}]{{1,2}}))")
_NO_MID = frozenset(MARKS + FREE_MARKS + _CLOSERS + "".join(map(chr, range(0x0E00, 0x0E80))))


def _mid_words(p: str) -> list[str]:
    """Words that surely continue a sentence: those that follow neither an end mark, nor a closing quote or bracket, nor Thai."""
    words = p.split()
    out = [w for before, w in zip(words, words[1:], strict=False) if before[-1] not in _NO_MID]
    return out if p.isascii() else [w if w.isascii() else _right_word.match(w).group() for w in out] + _after_comma.findall(p)


_SCANNED = "at binary, after binary, flag binary, words string, spans binary, kind string, left string, f int, right string, n bigint"


def scanned(texts: DataFrame) -> DataFrame:
    """One pass over ``(id, text)``: a row with the slots of each text, and rows ``(kind, left, f, right, n)`` of what was counted (id is null)."""
    kind = texts.schema["id"].dataType.simpleString()

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        mids: Counter = Counter()
        schema: pa.Schema | None = None

        def counts() -> pa.RecordBatch:
            for w, n in mids.items():
                w = _word(w[:64])
                seen["mid", "", 0, w.rstrip(".,;:!?…") or w] += n
            rows = list(seen.items())
            columns = [pa.array([r[0][i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.string()))]
            seen.clear()
            mids.clear()
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in schema.types[:6]), *columns, pa.array([r[1] for r in rows], pa.int64())], schema=schema)

        for batch in batches:
            if schema is None:
                b = pa.binary()
                schema = pa.schema([("id", batch.schema.types[0]), ("at", b), ("after", b), ("flag", b), ("words", pa.string()), ("spans", b), ("kind", pa.string()), ("left", pa.string()), ("f", pa.int32()), ("right", pa.string()), ("n", pa.int64())])
            for part in in_passes(batch, "text"):
                kept: list[tuple] = []
                for text in part.column("text").to_pylist():
                    found, spans = [], []
                    for a, b, s, last in scan(text):
                        p = text[a:b]
                        seen.update([("slot", x.left, x.flag, x.right) for x in s])
                        if last.left:
                            seen["end", last.left, last.flag, ""] += 1
                        m = _marker.match(p)
                        seen["start", "", 0, _right(p, m.end() if m and m.end() < len(p) else 0)] += 1
                        mids.update(_mid_words(p))
                        found += s
                        spans += [a, b, len(s)]
                    at, after, flag = (np.array([x[i] for x in found], t).tobytes() for i, t in ((0, np.int32), (1, np.int32), (3, np.int8)))
                    kept.append((at, after, flag, "\0".join([w for x in found for w in (x.left.replace("\0", " "), x.right.replace("\0", " "))]), np.array(spans, np.int32).tobytes()))
                columns = [pa.array([k[i] for k in kept], t) for i, t in enumerate(schema.types[1:6])]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns, *(pa.nulls(part.num_rows, t) for t in schema.types[6:])], schema=schema)
                if len(seen) + len(mids) > 400_000:
                    yield counts()
        if schema is not None:
            yield counts()

    return texts.select("id", "text").mapInArrow(observe, f"id {kind}, {_SCANNED}")


def observations(found: DataFrame) -> DataFrame:
    """``(kind, left, flag, right, n)`` over all texts, from the counts of the tasks."""
    counted = found.where("kind is not null").select("kind", "left", F.col("f").alias("flag"), "right", "n")
    return counted.groupBy("kind", "left", "flag", "right").agg(F.sum("n").alias("n"))


def _shares(n: Counter) -> dict[str, float]:
    total = sum(n.values()) + 0.05 * (len(n) + 1)
    return {w: (x + 0.05) / total for w, x in n.items()}


def train(texts: DataFrame, rounds: int = 4) -> Model:
    """The hidden-event model of a corpus ``(text)``."""
    return fit(cut(observations(scanned(texts.select(F.lit(0).alias("id"), "text")))), rounds)


def fit(counts: DataFrame, rounds: int = 4) -> Model:
    """The model of counted ``observations``, by EM over the counted contexts.

    The event chance of a left word follows from how often it ends a paragraph, compared with all ends; EM, which would let it
    drift, moves it for rare words only.
    """
    spark = counts.sparkSession
    total_n = F.sum("n").alias("n")

    def frequent(df: DataFrame, *by: str) -> list:
        least = max(5.0, FLOOR * (df.agg(F.sum("n")).first()[0] or 0))
        return df.groupBy(*by).agg(total_n).where(F.col("n") >= least).collect()

    lefts, rights = ({r[0] for r in frequent(counts.where(F.col(c) != ""), c)} for c in ("left", "right"))
    names = spark.sparkContext.broadcast((lefts, rights))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ls, rs = names.value
        for b in batches:
            left = [w if not w or w in ls else shape(w) for w in b.column(1).to_pylist()]
            right = [w if not w or w in rs else shape(w) for w in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(left, pa.string()), b.column(2), pa.array(right, pa.string()), b.column(4)], ["kind", "left", "flag", "right", "n"])

    first_or_mid = F.when(F.col("flag") == FIRST, FIRST).otherwise(MID)
    mapped = cut(counts.mapInArrow(known, counts.schema).withColumn("flag", first_or_mid).groupBy("kind", "left", "flag", "right").agg(total_n))

    def sums(kind: str, *by: str) -> Counter:
        rows = mapped.where(F.col("kind") == kind).groupBy(*by).agg(total_n).collect()
        return Counter({(tuple(r[:-1]) if len(by) > 1 else r[0]): float(r[-1]) for r in rows})

    ends, total = sums("end", "left", "flag"), sums("slot", "left", "flag")
    n_ends = sum(ends.values())
    share = n_ends / (n_ends + sum(total.values()) or 1.0) or 1.0
    total.update(ends)
    like_n, like_ends = Counter(), Counter()  # by shape and end mark, for words with few counts
    for (w, flag), n in total.items():
        key = (w if w.startswith("~") else shape(w), flag)
        like_n[key] += n
        like_ends[key] += ends[w, flag]

    def from_ends(k: tuple[str, int]) -> float:
        key = (k[0] if k[0].startswith("~") else shape(k[0]), k[1])
        like = min((like_ends[key] + 0.1 * share) / (like_n[key] + 0.1) / share, 1.0)
        return min((ends[k] + FEW * share * like) / (total[k] + FEW) / share, 1.0)

    certain = {k: from_ends(k) for k in total}
    starts, mids = sums("start", "right"), sums("mid", "right")
    contexts = mapped.where("kind = 'slot'").select("left", "flag", "right", "n")
    kept = spark.sparkContext.broadcast({(r[0], r[1]) for r in frequent(contexts, "left", "right")})
    clip = lambda x: min(max(x, 1e-5), 1 - 1e-5)
    model = Model({k: clip(v) for k, v in certain.items()}, _shares(starts), _shares(mids), {}, {}, share)
    for _ in range(rounds):
        current = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            m, sums = current.value, {}
            for b in batches:
                for left, flag, right, n in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    chance = m.chance(left, flag)
                    a = chance * m.likelihood(left, right)
                    p = a / (a + 1 - chance)
                    for key in (left, flag, ""), ("", MID, right), *([(left, MID, right)] if (left, right) in kept.value else []):
                        yes, no = sums.get(key, (0.0, 0.0))
                        sums[key] = yes + n * p, no + n * (1 - p)
            columns = [*zip(*sums, strict=True)] or [(), (), ()]
            values = [*zip(*sums.values(), strict=True)] or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*columns, *values), (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["left", "flag", "right", "yes", "no"])

        soft = contexts.mapInArrow(expect, "left string, flag int, right string, yes double, no double").groupBy("left", "flag", "right").agg(F.sum("yes"), F.sum("no")).collect()
        seen, after, within = Counter(ends), Counter(starts), Counter(mids)
        left_within, pairs = Counter(), {}
        for left, flag, right, yes, no in soft:
            if not right:
                seen[left, flag] += yes
                left_within[left] += no
            elif not left:
                after[right] += yes
                within[right] += no
            else:
                pairs[left, right] = no
        event = {}
        for k, n in total.items():
            rare = 10 / (10 + n)
            event[k] = clip((1 - rare) * certain[k] + rare * min(seen[k] / n, 1.0))
        model = Model(event, _shares(after), _shares(within), pairs, left_within, share)
    return model


def split_sentences(docs: DataFrame, id_col: str, text_col: str, model: Model | None = None) -> DataFrame:
    """``(id, sent_no, start_at, end_at)`` of every sentence of every text."""
    found = cut(scanned(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")))
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(cut(observations(found))))
    kind = docs.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, start, end = [], [], [], []
            for i, (at, after, flag, words, spans) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True)):
                words = words.split("\0")
                s = list(map(Slot, np.frombuffer(at, np.int32).tolist(), np.frombuffer(after, np.int32).tolist(), words[::2], np.frombuffer(flag, np.int8).tolist(), words[1::2]))
                done = k = 0
                for a, b, n in np.frombuffer(spans, np.int32).reshape(-1, 3).tolist():
                    for x, y in decide(a, b, s[done : done + n], shared.value):
                        row.append(i)
                        number.append(k)
                        start.append(x)
                        end.append(y)
                        k += 1
                    done += n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(v, pa.int32()) for v in (number, start, end))], [id_col, "sent_no", "start_at", "end_at"])

    slots_of = found.where("kind is null").select("id", "at", "after", "flag", "words", "spans")
    return slots_of.mapInArrow(split, f"`{id_col}` {kind}, sent_no int, start_at int, end_at int")
