import random
import re
import time

import pytest

from querndal.llm.pair_defects import DECLINES, Models, _covered, _decline_words, broken_pairs, is_copy, is_empty, is_refusal, is_truncated, languages

NONE = Models({"en": {"the": -1.0, "files": -3.0}, "de": {"die": -1.0, "dateien": -3.0}}, {"en": -9.0, "de": -9.0}, {"laut Dr.": (0, 40), "Dr.": (0, 40), "ready.": (20, 30)}, 0.3)


@pytest.mark.parametrize("text", [None, "", " \n", "​", "...", "N/A", "n/a.", "null", "{}", "[]", "<p></p>", "<br/>\n", "```\n```", "Answer:", "回答：", "（無）", "--", '""'])
def test_empty(text):
    assert is_empty(text)


@pytest.mark.parametrize("text", ["No.", "0", "42", "不行。", "- a", '{"a": 1}', "None of them.", "Answer: yes"])
def test_not_empty(text):
    assert not is_empty(text)


@pytest.mark.parametrize("response", ["Which files were lost in May?", "which files were lost in may", "You asked: Which files were lost in May?", '"Which files were lost in May?"', "Which files were lost in May? Which files were lo", "files were lost in May?"])
def test_copy(response):
    assert is_copy("Which files were lost in May?", response)


@pytest.mark.parametrize("response", ["Which files were lost in May? Three of the archive.", "May", "The archive lost three.", "- files\n- rows\n- pages"])
def test_no_copy(response):
    assert not is_copy("Which files were lost in May?", response)


REFUSALS = ["I'm sorry, but I can't help with that.", "Sorry, I must pass on this one. Please ask your administrator.", "抱歉，我無法回答這個問題。請洽系統管理員。", "その質問にはお答えできません。", "Leider kann ich diese Frage nicht beantworten.", "Lo siento, no puedo responder a esa pregunta."]


@pytest.mark.parametrize("text", REFUSALS)
def test_refusal(text):
    assert is_refusal(text)


@pytest.mark.parametrize("text", ["It cannot be changed later.", "I'm sorry for the confusion. The crawler lost three pages.", "這項設定無法事後修改。", "No."])
def test_no_refusal(text):
    assert not is_refusal(text)


@pytest.mark.parametrize("text", ['{"a": 1, "b": "x', "```python\nx = 1", "1. One is done.\n2.", "The files were", "The reader said (see p. 3.", "laut Dr."])
def test_truncated(text):
    assert is_truncated(text, NONE)


@pytest.mark.parametrize("text", ['{"a": 1}', "Text.\n```python\nx = 1\n```", "- files\n- rows", "42", "They are ready.", "Done!", "可以。"])
def test_complete(text):
    assert not is_truncated(text, NONE)


def test_languages():
    assert languages("The files", NONE) == {"en"} and languages("die Dateien", NONE) == {"de"}
    assert languages("これは本です。", NONE) == {"ja"} and languages("這是書，不是筆。", NONE) == {"zh"} and languages("42", NONE) == set()
    assert languages("- 文書\n- 記録", NONE) == {"zh", "ja"}


@pytest.mark.parametrize("seed", range(3))
def test_copies_of_any_length_end_soon(seed):
    """A copied megabyte, and one that only repeats pieces of its prompt."""
    rng = random.Random(seed)
    prompt = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(150_000))
    began = time.time()
    assert is_copy(prompt, prompt) and is_copy("a b " * 250_000, "a b " * 250_000)
    pieces = [prompt[i : i + 12] for i in range(0, len(prompt) - 12, 12)]
    rng.shuffle(pieces)
    is_copy(prompt, " ".join(pieces))
    assert not is_copy(prompt, "x" * 1_000_000)
    assert time.time() - began < 30


def test_cover_is_that_of_all_common_runs():
    rng = random.Random(7)
    for _ in range(300):
        p, r = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(2))
        covered = {k for i in range(len(r) - 3) for k in range(i, i + 4) if r[i : i + 4] in p}
        assert _covered(r, p, 4) == len(covered)


def test_list_item_that_breaks_off():
    models = Models({"en": {}}, {"en": -9.0}, {"- the red filter": (9, 1), "- the": (0, 0), "- rows": (5, 5)}, 0.3)
    assert models.begins_longer_item("- the r") and not models.begins_longer_item("- rows") and not models.begins_longer_item("- zebra")
    assert is_truncated("- rows\n- the red", models) and not is_truncated("- the red filter\n- rows", models)


def test_longer_contexts_decide_over_shorter_ones(spark):
    """``Nr.`` goes on; after ``jede`` it ends: both counts reach the model."""
    rows = [(i, None, f"Laut Nr. {i} gilt das. Fertig.") for i in range(200)] + [(1000 + i, None, "Das ist jede Nr.") for i in range(12)] + [(2000 + i, None, f"Wort{i} sagt alles Gute.") for i in range(200)]
    rows += [(5000, None, "Siehe Nr.")]
    df = spark.createDataFrame(rows, "run_id bigint, prompt string, response string")
    assert {tuple(r) for r in broken_pairs(df).collect()} == {(5000, "truncated")}


def test_table(spark):
    rows = [(1, "Which files were lost?", None), (2, "Which files were lost?", "Which files were lost?"), (3, "Which files were lost?", "I can't help with that."), (4, "Which files were lost?", "これは三つのファイルです。"), (5, "Which files were lost?", "The files of the"), (6, "Which files were lost?", "Three."), (7, None, "Three files were lost."), (7, None, "Three files were lost."), (8, "", "x" * 200_000 + ".")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "run_id bigint, prompt string, response string, defect string")
    assert {tuple(r) for r in broken_pairs(df).collect()} == {(1, "empty"), (2, "copy"), (3, "refusal"), (4, "language"), (5, "truncated")}
    assert broken_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("line", DECLINES.strip().split("\n"))
def test_every_declining_pattern_needs_a_word_of_the_gate(line):
    """The alternatives of each pattern, spelled out, hold a word without which nothing is searched."""
    for text in REFUSALS:
        if re.search(line, text, re.I):
            assert any(w in text.lower() for w in _decline_words)
