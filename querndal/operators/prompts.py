"""Prompt assembly as Columns: chat messages, plain forms and output schemas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(system: Column, prompt: Column, style: str = "chat_gpt") -> Column:
    """Messages of a prompt: ``chat_gpt`` with a system message, ``chat_mistral`` and ``chat_gemini`` with the system text before the prompt; empty parts are left out."""
    if style == "chat_gpt":
        parts = F.array(message("system", system), message("user", prompt))
    else:
        parts = F.array(message("user", F.concat_ws("\n\n", F.nullif(system, F.lit("")), F.nullif(prompt, F.lit("")))))
    return F.filter(parts, lambda m: F.coalesce(m["content"] != "", F.lit(False)))


def plain(system: Column, prompt: Column, style: str = "gpt") -> Column:
    """One text: ``gpt`` joins both by a blank line, ``llama`` wraps them in instruction marks, ``chat_gemma`` in turns."""
    if style == "llama":
        return F.concat(F.lit("[INST] <<SYS>> "), system, F.lit(" <</SYS>> \n"), prompt, F.lit(" [/INST]"))
    if style == "chat_gemma":
        return F.concat(F.lit("<start_of_turn>user\n"), system, F.lit("\n"), prompt, F.lit("<end_of_turn>\n<start_of_turn>model\n"))
    return F.concat_ws("\n\n", F.nullif(system, F.lit("")), prompt)


def style_of(model_type: Column, model_name: Column) -> Column:
    """Prompt form of a model by its type and name."""
    name = F.lower(model_name)
    return (
        F.when(model_type.isin("openai", "remote", "azure", "anthropic"), F.lit("chat_gpt"))
        .when(model_type.isin("gemini", "google"), F.lit("chat_gemini"))
        .when(name.contains("mistral"), F.lit("chat_mistral"))
        .when(name.contains("gemma"), F.lit("chat_gemma"))
        .when(name.contains("llama"), F.lit("llama"))
        .otherwise(F.lit("gpt"))
    )


def schema_text(fields: dict[str, str], form: str = "json") -> str:
    """Description of an output object for a prompt, as ``json``, ``xml``, ``list`` or ``dict``; unknown types count as str."""
    kinds = {k: v if v in ("str", "int", "float", "bool", "list") else "str" for k, v in fields.items()}
    if form == "xml":
        return "\n".join(f"<{k}>{v}</{k}>" for k, v in kinds.items())
    if form == "list":
        return ", ".join(kinds)
    if form == "dict":
        return "\n".join(f"{k}: {v}" for k, v in kinds.items())
    return "{" + ", ".join(f'"{k}": {v}' for k, v in kinds.items()) + "}"


def with_essay_note(system: Column, style: Column, language: Column, note: str = "請用中文回答") -> Column:
    """The system text with the language note in front, for essays in ``ch`` that lack it."""
    add = (style == "essay") & (language == "ch") & ~F.coalesce(system, F.lit("")).contains(note)
    return F.when(add, F.concat_ws(" ", F.lit(note), system)).otherwise(system)


def run_parameters(columns: list[str]) -> Column:
    """Map of the named columns as text, without null and empty ones."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in columns])
    return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"] != "", F.lit(False))))


def metadata_line(lines: Column) -> Column:
    """Joined metadata lines; ``none`` where there are none."""
    return F.coalesce(F.nullif(F.array_join(lines, "; "), F.lit("")), F.lit("none"))


# Prompts of the composite operators, one for each task.


def _task(instruction: str, *parts: tuple[str, Column]) -> Column:
    return F.concat(F.lit(instruction), *[x for name, text in parts for x in (F.lit(f"\n\n{name}: "), F.coalesce(text, F.lit("")))])


def grader(found: Column, question: Column) -> Column:
    return _task("Is this answer relevant to the question? Say yes or no.", ("Answer", found), ("Question", question))


def wrong_answers(question: Column, right: Column, n: int = 3) -> Column:
    return _task(f"Write {n} answers to the question that sound right and are wrong, one a line.", ("Question", question), ("Right answer", right))


def category(text: Column) -> Column:
    return _task("Name the subject of this text in one or two words.", ("Text", text))


def compression(text: Column) -> Column:
    return _task("Shorten this text and keep every fact.", ("Text", text))


def translation(text: Column, language: str) -> Column:
    return _task(f"Translate the text into {language}. Give the translation only.", ("Text", text))


def json_form(text: Column, keys: list[str]) -> Column:
    wanted = f" with the keys {', '.join(keys)}" if keys else ""
    return _task(f"Write the content of the text as one JSON object{wanted}.", ("Text", text))
