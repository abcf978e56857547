"""Evaluation: question sets, generated questions, choices, ROUGE-L and scores."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_word = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_]+")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; rows as bit vectors of a Python integer (Hyyrö), so whole texts stay cheap."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & places.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(candidate: str | None, reference: str | None) -> float:
    """Sentence-level ROUGE-L F1 over lower-case words (a CJK character is a word), rounded to 3 places; 0 if either has none."""
    a, b = (_word.findall((x or "").lower()) for x in (candidate, reference))
    if not a or not b:
        return 0.0
    n = lcs(a, b)
    return round(2 * n / (len(a) + len(b)), 3)


def _rouge(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(a, b) for a, b in zip(candidate, reference, strict=True)], dtype="float64")


def rouge_l_score(candidate: Column, reference: Column) -> Column:
    return F.pandas_udf(_rouge, "double")(candidate, reference)


def bert_score(candidate: Column, reference: Column, scorer) -> Column:
    """F1 of an injected ``scorer(candidates, references) -> scores`` over Arrow batches; 0 where it fails or a side is null."""

    def run(c: pd.Series, r: pd.Series) -> pd.Series:
        there = c.notna() & r.notna()
        out = pd.Series(0.0, index=c.index)
        try:
            out[there] = np.asarray(scorer(list(c[there]), list(r[there])), np.float64) if there.any() else 0.0
        except Exception:  # whatever the model raises counts as no similarity
            pass
        return out.fillna(0.0)

    return F.round(F.pandas_udf(run, "double")(candidate, reference), 3)


def toxicity(label: Column, p: Column) -> Column:
    """Chance of toxic text from a classifier's label and its chance."""
    return F.when(F.lower(label) == "toxic", p).otherwise(1 - p)


def check_question_kind(style: str, kind: str) -> None:
    """A summary can't be a single choice question."""
    if style == "single_choice" and kind == "summary":
        raise ValueError("summary questions have no single choice form")


def single_choice(wrong: Column, right: Column, place: Column) -> Column:
    """Numbered choices with the right answer at ``place`` (from 0), then the number of the right one as last element."""
    flat = lambda c: F.replace(c, F.lit("\n"), F.lit(""))
    clean = F.transform(wrong, flat)
    all_ = F.concat(F.slice(clean, F.lit(1), place), F.array(flat(right)), F.slice(clean, place + 1, F.greatest(F.size(clean) - place, F.lit(0))))
    return F.concat(F.transform(all_, lambda x, i: F.concat((i + 1).cast("string"), F.lit("."), x)), F.array((place + 1).cast("string")))


def format_question(question: Column, choices: Column) -> Column:
    """A question with its choices, one a line."""
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c)), "\n")
    return F.when(F.size(F.coalesce(choices, F.array().cast("array<string>"))) > 0, F.concat(question, F.lit("\n"), lines)).otherwise(question)


def valid_choice(choices: Column, answer: Column) -> Column:
    """True if the answer is the number of one of the choices."""
    n = F.trim(answer).try_cast("int")
    return F.coalesce((n >= 1) & (n <= F.size(choices)), F.lit(False))


def parse_question_answer(response: Column) -> Column:
    """struct(question, answer) of a generated text with question and answer marks (full or half-width colon), else null."""
    mark = r"(?is)(?:question|問題|问题)\s*[:：]\s*(.*?)\s*(?:answer|答案)\s*[:：]\s*(.*)"
    q, a = (F.trim(F.regexp_extract(response, mark, i)) for i in (1, 2))
    return F.when((q != "") & (a != ""), F.struct(q.alias("question"), a.alias("answer")))


def best_numbers(scores: list[float]) -> dict[str, float]:
    """Mean of the scores rounded to 3 places; zeros for an empty list."""
    return {"n": len(scores), "mean": round(float(np.mean(scores)), 3) if scores else 0.0}


def accuracy(judged: DataFrame, by: str, hit: str = "hit") -> DataFrame:
    return judged.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def create_questions(docs: DataFrame, generate, by: str = "source", order: str = "ord", text: str = "docs", size: int = 2, seed: int = 0) -> DataFrame:
    """One generated question for each drawn window of consecutive texts: ``(by, start, question, answer)``; unreadable ones are dropped."""
    from .models import answer
    from .windows import disjoint_starts, full_windows

    drawn = full_windows(docs, by, order, text, size).join(disjoint_starts(docs, by, order, size, seed), [by, "start"])
    prompt = F.concat(F.lit("Write a question and its answer about this text, as 'question: ... answer: ...'.\n\n"), F.array_join("values", "\n"))
    return drawn.withColumn("qa", parse_question_answer(answer(prompt, generate))).where("qa is not null").select(by, "start", "qa.*")


def create_topic_questions(found: DataFrame, generate) -> DataFrame:
    """One generated question for each topic from the texts found for it: ``(query_id, question, answer)``.

    ``found``: (query_id, place, text) as a search returns it.
    """
    from .models import answer

    parts = F.sort_array(F.collect_list(F.struct("place", "text")))
    texts = found.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("t"))
    prompt = F.concat(F.lit("Write a question and its answer about this text, as 'question: ... answer: ...'.\n\n"), F.col("t"))
    return texts.withColumn("qa", parse_question_answer(answer(prompt, generate))).where("qa is not null").select("query_id", "qa.*")


def create_compare_questions(items: DataFrame, category: str, noun: str, order: str, generate, threshold: int = 3) -> DataFrame:
    """One generated question that compares the nouns of each category with at least ``threshold`` of them: ``(category, question, answer)``."""
    from .aggregates import same_category
    from .models import answer

    groups = same_category(items, category, noun, order, threshold)
    prompt = F.concat(F.lit("Write a question that compares these, and its answer, as 'question: ... answer: ...'.\n\n"), F.col("category"), F.lit(": "), F.array_join("nouns", ", "))
    return groups.withColumn("qa", parse_question_answer(answer(prompt, generate))).where("qa is not null").select("category", "qa.*")


def evaluate(questions: DataFrame, contexts: DataFrame, model, judge=None, bert=None) -> DataFrame:
    """Answer and score every question: ``(qid, question_style, question_type, response, rouge, bert, llm_score, hit)``.

    ``questions``: (qid, question_style, question, choices, answer), ``contexts``: (qid, context), which may lack questions. Essays get ROUGE-L, the ``bert``
    scorer's F1 and the first number of the judge's answer; single choice questions a hit if the response holds the answer's number. Of the type
    ``summary`` the question is the text itself: no context is looked up, the model is asked for its summary.
    """
    from ..functions.text import first_number
    from .aggregates import hit
    from .models import answer

    asked = questions.join(contexts.select("qid", "context"), "qid", "left")
    found = F.concat(F.coalesce("context", F.lit("")), F.lit("\n\n"), format_question(F.col("question"), F.col("choices")))
    summary = F.coalesce(F.col("question_type") == "summary", F.lit(False))
    prompt = F.when(summary, F.concat(F.lit("Summarise this text.\n\n"), F.coalesce("question", F.lit("")))).otherwise(found)
    done = asked.withColumn("response", answer(prompt, model))
    essay = F.col("question_style") == "essay"
    none = F.lit(None).cast("double")
    graded = first_number(answer(F.concat(F.lit("Grade from 0 to 1.\n\n"), F.coalesce("response", F.lit("")), F.lit("\n\n"), F.coalesce("answer", F.lit(""))), judge)) if judge else none
    like = bert_score(F.col("response"), F.col("answer"), bert) if bert else none
    scores = {"rouge": rouge_l_score(F.col("response"), F.col("answer")), "bert": like, "llm_score": graded}
    return done.select("qid", "question_style", "question_type", "response", *[F.when(essay, v).alias(k) for k, v in scores.items()], F.when(~essay, hit(F.col("response"), F.col("answer"))).alias("hit"))


def evaluation_summary(scored: DataFrame) -> DataFrame:
    """Means and accuracy of each question type, zeros where nothing was scored."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 3), F.lit(0.0)).alias(c)
    return scored.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), mean("rouge"), mean("llm_score"), mean("hit"))
