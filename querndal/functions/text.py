"""Scalar text functions as Columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: letters, marks, digits, underscore. The same pattern in Java, RE2 and Python's ``regex``.
WORD = r"[\p{L}\p{M}\p{N}_]+"
#: Characters that are words of their own in Chinese and Japanese.
HAN = r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]"
#: Unicode White_Space as a character class body.
SPACES = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Language codes and their English names; unknown codes count as ``ch``.
LANGUAGES = {"ch": "traditional chinese", "zh": "simplified chinese", "en": "english", "jp": "japanese", "ja": "japanese", "ko": "korean", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "ru": "russian", "th": "thai", "vi": "vietnamese", "hi": "hindi"}
#: Share of the output budget and floor of each thinking level.
THINKING = {"minimal": (0.1, 128), "low": (0.2, 512), "medium": (0.5, 1024), "high": (0.8, 2048)}


def tokens(text: Column) -> Column:
    """Lower-cased words in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def han_tokens(text: Column) -> Column:
    """Lower-cased tokens of texts in which Chinese or Japanese occurs: each of their characters, and words of the rest; null for null."""
    return tokens(F.regexp_replace(text, f"({HAN})", " $1 "))


def word_count(text: Column) -> Column:
    """Number of runs of non-white-space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0))


def is_blank(text: Column) -> Column:
    """True for null and for white space only."""
    return F.coalesce(~text.rlike(f"[^{SPACES}]"), F.lit(True))


def separate_name(name: Column) -> Column:
    """``type:name`` as struct(type, name): the type lower-cased, the name all after the first colon or empty."""
    return F.struct(F.lower(F.split_part(name, F.lit(":"), F.lit(1))).alias("type"), F.when(name.contains(":"), F.regexp_replace(name, "^[^:]*:", "")).when(name.isNotNull(), F.lit("")).alias("name"))


def clean_category(name: Column) -> Column:
    """Letters, digits, spaces and underscores only, no trailing space; ``uncategorized`` if nothing is left."""
    return F.coalesce(F.nullif(F.rtrim(F.regexp_replace(name, r"[^\p{L}\p{N}_ ]", "")), F.lit("")), F.lit("uncategorized"))


def basename(path: Column) -> Column:
    """Last segment of a path with either slash; null for null."""
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def parent(path: Column) -> Column:
    """Path up to its last slash after normalising slashes and a leading ``./``; empty if there is none."""
    p = F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")
    return F.regexp_extract(p, "^(.*)/", 1)


def is_url(text: Column) -> Column:
    return text.rlike("^https?://")


def storage_name(path: Column, chunk_size: Column, embed_type: Column, embed_name: Column) -> Column:
    """Collection name of a source: sanitised path parts joined by ``-`` (a url: 30 letters and digits), embedder, chunk size."""
    parts = F.filter(F.transform(F.split(path, "/"), lambda x: F.regexp_replace(F.when(F.trim(x).isin(".", ""), F.lit("")).otherwise(x), "[^a-zA-Z0-9.-]", "")), lambda x: x != "")
    local = F.coalesce(F.nullif(F.array_join(parts, "-"), F.lit("")), F.lit("NoPaReNtDiR"))
    name = F.when(is_url(path), F.substring(F.regexp_replace(path, "[^a-zA-Z0-9]", ""), 1, 30)).otherwise(local)
    return F.concat(F.lit("chromadb/"), name, F.lit("_"), embed_type, F.lit("_"), F.replace(embed_name, F.lit("/"), F.lit("-")), F.lit("_"), chunk_size.cast("string"))


def answer_digit(response: Column) -> Column:
    """``ans`` of a JSON answer, else its first digit, else -1, as text."""
    return F.coalesce(F.nullif(F.get_json_object(response, "$.ans"), F.lit("")), F.nullif(F.regexp_extract(response, "[0-9]", 0), F.lit("")), F.lit("-1"))


def first_number(response: Column) -> Column:
    """First number of a text rounded to 3 places; 0 if there is none."""
    found = F.nullif(F.regexp_extract(response, r"[0-9]+\.?[0-9]*", 0), F.lit(""))
    return F.coalesce(F.round(found.try_cast("double"), 3), F.lit(0.0))


def language_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(code))), F.lit(LANGUAGES["ch"]))


def thinking_budget(level: Column, max_output_tokens: Column) -> Column:
    """Token budget of a thinking level; null for an unknown level."""
    out = F.lit(None).cast("bigint")
    for name, (share, floor) in THINKING.items():
        out = F.when(level == name, F.greatest(F.lit(floor), F.ceil(max_output_tokens * F.lit(share))).cast("bigint")).otherwise(out)
    return out


#: Fixed value: what marks a cut trace.
TRUNCATED = "\n... [verbose output truncated]"


def truncate_trace(text: Column, most: int = 4000) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(TRUNCATED))).otherwise(text)


def blocks_to_text(blocks: Column, kinds: tuple[str, ...] = ("text",)) -> Column:
    """Joined text of the content blocks (array of struct(type, text)) of the given kinds."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"].isin(*kinds)), lambda b: b["text"]), "")


def map_characters(text: Column, source: str, target: str) -> Column:
    """Character-wise conversion, as between simplified and traditional script, by an injected table."""
    return F.translate(text, source, target)


def json_safe(value: Column) -> Column:
    """Any value as JSON text, nulls kept; a string stays as it is."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def tool_result(blocks: Column) -> Column:
    """Result of a tool call, content blocks (array of struct(type, text)), as text: that of a single text block (JSON in its compact form), else all blocks as JSON."""
    one = F.try_element_at(blocks, F.lit(1))
    single = (F.size(blocks) == 1) & (one["type"] == "text") & one["text"].isNotNull()
    parsed = F.to_json(F.try_parse_json(one["text"]))
    return F.when(single, F.coalesce(parsed, one["text"])).otherwise(F.to_json(blocks, {"ignoreNullFields": "false"}))
