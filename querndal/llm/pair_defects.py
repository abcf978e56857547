"""Problem 2: broken prompt and response pairs, with the type of their defect.

Tests in this order; the first that holds names the defect.

* ``empty``: null, or nothing is left without markup, punctuation, labels and placeholders.
* ``copy``: the response is compressed with its prompt as a raw zstandard dictionary, whatever its length. If the dictionary makes it cheap, an exact
  check follows: apart from a lead-in, all its letters lie in long runs of the prompt. Both are linear in the texts.
* ``refusal``: a sentence declines (dictionary by language) and every other one is a courtesy.
* ``language``: the response's main language is clearly not the one that the prompt names or, if it names none, is written in. Scripts tell most
  languages apart; those in Latin script by a word model that is trained on the table itself from seeds of function words.
* ``truncated``: an open code fence, object, quote, bracket or bare list mark; no end mark; or an end mark in a context that
  continues. Terminal contexts are the last one to four words before an end mark, counted over all responses at their end and within
  them: a context that practically never stands at an end (as ``Laut Dr.``) means that the text breaks off.

The models' counts cover all rows. A table keeps every word and context from a share of FLOOR of all words or responses on, which bounds it by
1 / FLOOR entries at any size of the input; of contexts only those that can decide.

Edge cases: a null or empty prompt has no language and nothing to copy; brief answers, numbers, lists, code and objects are
complete; rows with repeated content are judged alike; a null run_id is kept as it is.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels and placeholders that are no answer.
LABELS = "answer response reply output result antwort ergebnis respuesta resultado 回答 答案 答 解答 回覆 答え 応答 आउटपुट उत्तर คำตอบ".split()
PLACEHOLDERS = "na none null nil nan undefined tbd todo empty noanswer noresponse keine keineangabe ninguno ninguna nada ka sindato 無 无 空 沒有 なし 無し 該当なし ไม่มี".split()
#: Courtesies that may stand beside a refusal, as patterns over a whole sentence.
COURTESIES = r"""
(?:please )?(?:ask|contact|consult|see|talk to) (?:your|the|an?) .*|i hope .*|thank(?:s| you).*|is there anything .*|(?:please )?try (?:another|a different|again).*|(?:i(?:'m| am)? )?(?:so |very )?(?:sorry|apologi[sz]e).*|let me know .*|feel free .*
bitte (?:wenden|fragen|versuchen|stellen) .*|(?:es )?tut mir leid|entschuldig.*|danke.*|ich hoffe .*|kann ich sonst .*|vielen dank.*|versuchen sie .*
(?:por favor,? ?)?(?:consulte|pregunte|contacte|pruebe|intente|haga) .*|lo siento|disculp.*|gracias.*|espero .*|¿?(?:puedo|hay) .*(?:algo|más).*
(?:請|请).*(?:洽|詢|问|問|聯|联|改|試|试).*|(?:很)?抱歉.{0,4}|對不起|不好意思|謝謝.{0,6}|感謝.{0,6}|希望.*|還有.*嗎
.*(?:お問い合わせ|お尋ね|ご連絡|ご相談|ご了承|ご理解|お試し)(?:ください|下さい|願います|いただけ).*|申し訳(?:ありません|ございません)|すみません|恐れ入ります.*|ありがとう.*|他に.*
"""
#: How a sentence declines, by language.
DECLINES = r"""
\b(?:i|we)(?:'m| am| are)? (?:(?:really|just|simply|also) )?(?:can ?not|can't|cannot|could not|couldn't|won't|will not|am unable|unable|not able|must|have to|would rather not|do not have|don't have|am not (?:able|allowed|permitted)|not (?:allowed|permitted)|decline|refuse)\b(?:.{0,30}\b(?:help|assist|answer|provide|discuss|talk|share|write|respond|comment|comply|say|pass|decline|refuse|permission|authori[sz]ed|able|fulfil|disclose|reveal|continue|do (?:that|this)|be able)\b)
\b(?:something|a (?:topic|matter|question)) (?:i'm|i am|we're|we are) (?:unable|not able|not allowed)\b
\b(?:goes|is) (?:against|outside|beyond) my\b|\bmy (?:policy|policies|guidelines|rules|instructions) (?:do|does|forbid|prevent|prohibit|don't|doesn't)\b|\bnot (?:allowed|permitted) to (?:answer|say|discuss|share)\b|\bi (?:decline|refuse)\b
\bich\b.{0,60}\b(?:nicht|keine?n?|ablehnen)\b|\b(?:kann|darf|muss|möchte) (?:ich|wir)\b.{0,80}(?:\bnicht\b|\bkeine?n?\b|ablehnen)|\bich lehne\b.{0,40}\bab\b|(?:verstößt|widerspricht).{0,30}(?:richtlinien|regeln)
\b(?:no|ni) (?:puedo|podemos|me está permitido|me es posible|estoy autorizad[oa]|tengo (?:permiso|autorización)|debo)\b|\b(?:debo|tengo que|prefiero) (?:rechazar|declinar|negarme|no)\b|\bme niego\b|(?:va|está) (?:contra|en contra de|fuera de) mis?\b
(?:我|恕|本系統|這邊)?.{0,8}(?:無法|无法|不能|不便|難以|难以|不方便|恕難|恕难|拒絕|拒绝|不予)(?:.{0,14})(?:回答|提供|協助|协助|說明|说明|討論|讨论|透露|處理|处理|告知|答覆|回應|配合)|超出.{0,6}(?:權限|权限|範圍|范围)|(?:違反|违反|不符).{0,8}(?:規定|规定|政策|準則|准则)
(?:お答え|お応え|回答|提供|お伝え|ご案内|お手伝い|対応|ご説明|お話し?)(?:は|を|に)?.{0,6}(?:できません|できかねます|しかねます|いたしかねます|控え|差し控え|出来ません|お断り)|お断り(?:し|いた)|権限(?:が|は|を)?.{0,4}(?:ありません|ございません|超え)
"""
#: Every pattern of DECLINES holds one of these, so a text without any is not searched.
DECLINE_WORDS = """not n't unable must have\u00a0to decline refuse against outside beyond polic guideline rules instruction nicht kein lehne verstößt widerspricht
puedo podemos permitid posible autoriz tengo debo prefiero niego contra fuera 無法 无法 不能 不便 難以 难以 不方便 恕難 恕难 拒絕 拒绝 不予 超出 違反 违反 不符
できません できかねます しかねます 控え 出来ません お断り 権限"""
#: Names of languages in several languages.
LANGUAGE_NAMES = {
    "en": "english englisch inglés ingles 英文 英語 英语 ภาษาอังกฤษ अंग्रेज़ी",
    "de": "german deutsch alemán aleman 德文 德語 德语 ドイツ語",
    "es": "spanish spanisch español espanol castellano 西班牙文 西班牙語 西班牙语 スペイン語",
    "ja": "japanese japanisch japonés japones 日文 日語 日语 日本語",
    "zh": "chinese mandarin chinesisch chino 中文 漢語 汉语 中国語 華語 繁體中文 简体中文 traditional\\s+chinese simplified\\s+chinese",
    "fr": "french französisch francés frances 法文 法語 法语 フランス語",
    "th": "thai thailändisch tailandés 泰文 泰語 タイ語",
    "hi": "hindi 印地文 印地語 ヒンディー語",
}
#: Function words that seed the word model of languages in Latin script.
SEEDS = {
    "en": "the of and is are was were to in for with which what how why does do did not on at by from it that this has have can list i you",
    "de": "der die das und ist nicht mit von für den dem des ein eine wie warum hat haben wurden wird im zu auf aus bei über kann welche mehr als",
    "es": "el la los las de que en y para por con una un qué cómo cuál del se no fue fueron más pocas puede está están según sobre al su",
}
#: The languages of answers of one word.
SHORT = {"yes": "en", "no": "en es", "ja": "de", "nein": "de", "sí": "es", "si": "es", "ok": "en de es", "okay": "en de es"}
#: Share of all words or responses from which a word or context is kept; share of the plain compressed size up to which a response may be a copy.
FLOOR, NOVEL = 1e-6, 0.6
VERBS = r"answer|reply|respond|write|antworte\w*|schreib\w*|responda|responde|conteste|contesta|escriba|回答|回覆|作答|答え|回答して"

_zero_width = re.compile("[​-‏‪-‮⁠﻿]")
_markup = re.compile(r"<[^<>]{0,200}>|&(?:nbsp|amp|lt|gt|quot|#\d+);|```[\w+-]*")
_fence = re.compile(r"```.*?(?:```|$)", re.S)
_object = re.compile(r"^\s*[\[{].*", re.S)
_sentence_end = re.compile(r"(?<=[.!?])[\"”»)]*\s+|(?<=[。！？])[」』）]*|\n+")
_noise = re.compile(r"https?://[!-~]+|(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.(?:txt|md|csv|json|pdf|docx|pptx|html?|py)(?![A-Za-z])|(?<![A-Za-z0-9_])[A-Za-z0-9]*_[A-Za-z0-9_]*|(?<![A-Za-z])[a-z]+[A-Z][A-Za-z0-9]*|\d+")
_may_be_noise = re.compile(r"[\d_/]|[a-z][A-Z]|\.[a-z]")  # every alternative of the noise holds one of these
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_letters = re.compile(r"[^\W\d_]+")
_no_letters = re.compile(r"[\W_]+")
_forty = re.compile(r"(?:[\W_]*[^\W_]){40}")
_latin = re.compile(r"[A-Za-zÀ-ɏ]")
_courtesy = re.compile("|".join(x for x in COURTESIES.strip().split("\n")), re.I)
_decline = re.compile("|".join(DECLINES.strip().split("\n")), re.I)
_decline_words = [w.replace("\u00a0", " ") for w in re.split(r"[ \n]+", DECLINE_WORDS)]
_names = {c: "|".join(v.split()) for c, v in LANGUAGE_NAMES.items()}
_asks = {c: re.compile(rf"(?:(?:{VERBS})\b[^.:：。?？]{{0,24}}?(?:{n})|(?:用|以|使用)\s*(?:{n})|(?:{n})(?:で|作答|回答))", re.I) for c, n in _names.items()}
_any_name = sorted({w.split("\\s+")[-1] for v in _names.values() for w in v.split("|")})
_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "«": "»", "“": "”", "„": "“"}
_end_mark = re.compile(r"[.!?。！？…।」』）)\"”“»\]}]$")


_ascii: dict[int, list[str]] = {}


def _holds_any(text: str, words: list[str]) -> bool:
    """Does a text hold one of the words of a list of this module?"""
    if text.isascii():
        if id(words) not in _ascii:
            _ascii[id(words)] = [w for w in words if w.isascii()]
        words = _ascii[id(words)]
    for w in words:
        if w in text:
            return True
    return False


def bare(text: str) -> str:
    """Letters and digits of a text, lower case, NFKC."""
    return _no_letters.sub("", (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


def is_empty(response: str | None) -> bool:
    if response is None:
        return True
    s = response if response.isascii() else _zero_width.sub("", response)
    if not s.isascii() or "<" in s or "&" in s or "`" in s:
        s = _markup.sub(" ", s)
    if _forty.match(s):
        return False  # longer than any label or placeholder
    rest = bare(s)
    for w in LABELS:
        if rest.startswith(w) and re.match(rf"\W*{re.escape(w)}\s*(?:[:：]|\W*$)", unicodedata.normalize("NFKC", s).lower()):
            rest = rest[len(w) :]
            break
    return not rest or rest in PLACEHOLDERS


def _cheap(response: bytes, prompt: bytes) -> bool:
    """May the response be a copy? With the prompt as dictionary it takes at most NOVEL of its compressed size without, or a fiftieth of its length if it repeats itself.

    Sizes are net of what an empty text takes.
    """
    plain = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(response))
    known = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = len(zstandard.ZstdCompressor(level=3, dict_data=known, write_content_size=False, write_dict_id=False).compress(response)) - _EMPTY_FRAME
    return size <= max(NOVEL * (plain - _EMPTY_FRAME), len(response) / 50)


_EMPTY_FRAME = len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(b""))


def _covered(r: str, p: str, least: int) -> int:
    """Letters of r within common runs with p of at least ``least`` letters."""
    known = {p[i : i + least] for i in range(len(p) - least + 1)}
    covered = end = 0
    for at in range(len(r) - least + 1):
        if r[at : at + least] in known:
            covered += at + least - max(at, end)
            end = at + least
    return covered


def is_copy(prompt: str, response: str) -> bool:
    p = bare(prompt)
    body = re.sub(r"^[^:：\n]{1,30}[:：]", "", response, count=1)
    for text in dict.fromkeys((response, body)):
        r = bare(text)
        least = 4 if _CJK.search(r) else 8
        # Of a short response only what names much of the prompt says that it is copied: ``in May`` may answer ``... in May?``.
        if len(r) < max(2 * least - 4, 6) or len(r) < 0.25 * len(p) and len(r) < 24:
            continue
        if not _cheap(r.encode(), p.encode()):
            continue
        cover = _covered(r, p, least)
        # The end of a repeated and cut copy may be shorter than a run.
        if cover >= len(r) - least + 1 and cover >= 0.85 * len(r):
            return True
    return False


def is_refusal(response: str) -> bool:
    low = response.lower()
    if not _holds_any(low, _decline_words):
        return False
    parts = [x.strip(" .!?。！？\"”“「」()") for x in _sentence_end.split(response)]
    parts = [x for x in parts if bare(x)]
    declines = [bool(_decline.search(x)) for x in parts]
    return any(declines) and all(d or _courtesy.fullmatch(x) for d, x in zip(declines, parts, strict=True))


def asked_language(prompt: str) -> str | None:
    """The language that the prompt names for the answer: the earliest one named."""
    low = prompt.lower()
    if not _holds_any(low, _any_name):
        return None
    found = [(m.start(), c) for c, x in _asks.items() if (m := x.search(prompt))]
    return min(found)[1] if found else None


def plain_of(text: str) -> str:
    """A text without code, objects, file names, identifiers and numbers."""
    text = _fence.sub(" ", text) if "```" in text else text
    return _noise.sub(" ", text) if _may_be_noise.search(text) else text


def words_of(plain: str) -> list[str]:
    return _letters.findall(plain.lower())


class Models:
    """What ``train`` learns.

    ``words``: logarithms of word shares by language, ``unseen`` that of a word a language lacks; ``contexts``: (ends, inner places) of terminal contexts,
    those that begin with ``- `` are whole list items; ``share``: ends among all places of end marks.
    """

    def __init__(self, words: dict[str, dict[str, float]], unseen: dict[str, float], contexts: dict[str, tuple[int, int]], share: float):
        self.languages = list(words)
        self.scores = {w: tuple(t.get(w, unseen[c]) for c, t in words.items()) for w in set().union(*words.values())}
        self.items = sorted(k for k in contexts if k.startswith("- "))
        self.contexts = {k: v for k, v in contexts.items() if not k.startswith("- ")}
        self.share = share

    def begins_longer_item(self, item: str) -> bool:
        """Is this no known list item, but the beginning of one?"""
        at = bisect.bisect_left(self.items, item)
        return at < len(self.items) and self.items[at] != item and self.items[at].startswith(item)


def script_language(plain: str) -> str | None:
    """Language by script; ``latin`` for Latin letters, None without letters."""
    if plain.isascii():
        return "latin" if _latin.search(plain) else None
    kana = len(re.findall(r"[぀-ヿ]", plain))
    han = len(re.findall(r"[㐀-鿿]", plain))
    thai, hindi = len(re.findall(r"[฀-๿]", plain)), len(re.findall(r"[ऀ-ॿ]", plain))
    latin = len(_latin.findall(plain))
    n = max((3 * (kana + han), "cjk"), (thai * 2, "th"), (hindi * 2, "hi"), (latin, "latin"))
    if not n[0]:
        return None
    return ("ja" if kana > 0.1 * (kana + han) else "zh") if n[1] == "cjk" else n[1]


def languages(text: str, models: Models, margin: float = 2.0) -> set[str]:
    """The languages a text may mainly be in; empty if it can't be told."""
    if _object.match(text):
        return set()
    plain = plain_of(text)
    script = script_language(plain)
    if script is None:
        return set()
    if script == "zh" and all(len(x.strip()) <= 12 and not re.search("[，。！？]", x) for x in text.strip().split("\n")):
        return {"zh", "ja"}  # bare nouns need no kana
    if script != "latin":
        return {script}
    words = words_of(plain)
    if len(words) <= 2 and all(w in SHORT for w in words):
        return set.intersection(*(set(SHORT[w].split()) for w in words)) if words else set()
    known = [t for t in map(models.scores.get, words) if t]
    score = [sum(x) for x in zip(*known, strict=True)] if known else [0.0] * len(models.languages)
    best = max(score, default=0.0)
    return {c for c, v in zip(models.languages, score, strict=True) if v >= best - margin}


def tails(words: list[str]) -> list[str]:
    """Contexts of one to four last words, digits as 0."""
    w = [re.sub(r"\d+", "0", x) for x in words[-4:]]
    return [" ".join(w[-k:]) for k in range(1, len(w) + 1)]


def is_truncated(response: str, models: Models) -> bool:
    s = (response if response.isascii() else _zero_width.sub("", response)).strip()
    if s.count("```") % 2:
        return True
    if s.endswith("```"):
        return False
    if s[0] in "{[" and (len(s) < 2 or not re.match(r"\[\w", s)):
        return s[-1] != {"{": "}", "[": "]"}[s[0]] or s.count(s[0]) != s.count(s[-1]) or s.count('"') % 2 == 1
    line = s[s.rfind("\n") + 1 :].strip()
    if re.fullmatch(r"(?:\d{1,3}[.)]|[-*•])", line):
        return "\n" in s
    item = re.match(r"[-*•]\s+(.*)", line)
    if item:
        body = item.group(1)
        if re.search(r"[,、，:：]$", body):
            return True
        if not re.search(r"[.!?。！？]", s):
            return models.begins_longer_item("- " + body.lower())
    stack: list[str] = []
    for c in line:
        if stack and c == stack[-1]:
            stack.pop()
        elif c in _OPEN:
            stack.append(_OPEN[c])
    if stack or line.count('"') % 2:
        return True
    if not _end_mark.search(line):
        return not (re.fullmatch(r"[\d\s.,:%+/-]+\w{0,3}", line) or len(line.split()) == 1 and not _CJK.search(line) and len(s) == len(line))
    if line[-1] != ".":
        return False
    best = None
    for t in tails(line.split()):
        end, inner = models.contexts.get(t, (0, 0))
        if end + inner >= 8:
            best = (end, inner)
    return bool(best) and continues(best[0], sum(best), models.share)


def defect_of(prompt: str | None, response: str | None, models: Models) -> str | None:
    if is_empty(response):
        return "empty"
    prompt = prompt or ""
    if is_copy(prompt, response):
        return "copy"
    if is_refusal(response):
        return "refusal"
    wanted = asked_language(prompt)
    want = {wanted} if wanted else languages(prompt, models)
    have = languages(response, models)
    if want and have and not want & have:
        return "language"
    return "truncated" if is_truncated(response, models) else None


def _seeded(words: list[str]) -> str | None:
    score = sorted(((sum(w in s for w in words), c) for c, s in _seed_sets.items()), reverse=True)
    return score[0][1] if score[0][0] >= 2 and score[0][0] >= 2 * score[1][0] else None


_seed_sets = {c: set(v.split()) for c, v in SEEDS.items()}


def continues(ends, places, share: float):
    """Does a context with these counts (numbers or columns) practically never end a response?"""
    return ends + 0.5 < 0.15 * share * places


def train(pairs: DataFrame) -> Models:
    """Word model and terminal contexts of a table with ``prompt`` and ``response``: one pass, counts combined before the shuffle."""
    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(seen)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, ["kind", "key", "n"])

        for batch in batches:
            for prompt, response in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for text in (prompt, response):
                    if text and not _object.match(text) and script_language(plain := plain_of(text)) == "latin":
                        words = words_of(plain)
                        if c := _seeded(words):
                            seen.update((c, w) for w in words)
                s = (response or "").strip()
                if not s:
                    continue
                lines = s.split("\n")
                for i, line in enumerate(lines):
                    if m := re.match(r"[-*•]\s+(.*)", line):
                        seen["end" if i == len(lines) - 1 else "inner", "- " + m.group(1).strip().lower()] += 1
                    words = line.split()
                    for k, w in enumerate(words):
                        if w[-1] == ".":
                            kind = "end" if k == len(words) - 1 else "inner"
                            seen.update((kind, t) for t in tails(words[max(0, k - 3) : k + 1]))
                seen["all", "responses"] += 1
                if len(seen) > 200_000:
                    yield out()
        yield out()

    counts = pairs.select("prompt", "response").mapInArrow(observe, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n >= 2 or kind in ('end', 'all')")
    wide = counts.groupBy("key").pivot("kind", ["end", "inner", "all", *SEEDS]).agg(F.sum("n")).na.fill(0).persist()
    totals = wide.agg(F.sum("all").alias("all"), *(F.sum(F.when(F.col(c) >= 2, F.col(c))).alias(c) for c in SEEDS)).first()
    least = lambda n, most: max(n, int(np.ceil(FLOOR * (most or 0))))
    total, item = F.col("end") + F.col("inner"), F.col("key").startswith("- ")
    one = wide.where(~item & ~F.col("key").contains(" ") & (total >= least(5, totals["all"]))).agg(F.sum("end"), F.sum(total)).first()
    share = (one[0] or 0) / (one[1] or 1)
    # A context decides if it practically never ends a response, or if it is the longer form of one that doesn't.
    places = wide.where(~item & (total >= least(8, totals["all"]))).select("key", "end", "inner", continues(F.col("end"), total, share).alias("goes_on"))
    words = F.split("key", " ")
    shorter = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(2), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " ")))
    longer = places.where("not goes_on").select("key", "end", "inner", F.explode(shorter).alias("short")).join(places.where("goes_on").select(F.col("key").alias("short")), "short", "left_semi")
    kept = places.where("goes_on").select("key", "end", "inner").unionAll(longer.select("key", "end", "inner").distinct()).unionAll(wide.where(item & (total >= least(5, totals["all"]))).select("key", "end", "inner"))
    contexts = {r.key: (r.end, r.inner) for r in kept.collect()}
    shares: dict[str, dict[str, float]] = {}
    unseen: dict[str, float] = {}
    for c in SEEDS:
        rows = wide.where(F.col(c) >= least(2, totals[c])).select("key", c).collect()
        n = sum(r[1] for r in rows) + 1.0
        shares[c] = {r[0]: float(np.log(r[1] / n)) for r in rows}
        unseen[c] = float(np.log(0.5 / n))
    wide.unpersist()
    floor = min(unseen.values(), default=-12.0)  # one cost for a word that a language lacks, whatever the language's size
    return Models(shares, {c: floor for c in unseen}, contexts, share)


def broken_pairs(runs: DataFrame, id_col: str = "run_id") -> DataFrame:
    """``(run_id, defect)`` of every defective row of a table with ``prompt`` and ``response``."""
    models = runs.sparkSession.sparkContext.broadcast(train(runs))
    kind = runs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([defect_of(p, r, models.value) for p, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], [id_col, "defect"]).filter(found.is_valid())

    return runs.select(id_col, "prompt", "response").mapInArrow(judge, f"`{id_col}` {kind}, defect string")
