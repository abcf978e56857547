import pytest
from pyspark.sql import functions as F

from querndal.functions import text as X
from querndal.functions.json_text import calculate, find_objects
from querndal.functions.vectors import cosine, squared_l2, usable
from querndal.sources.html import last_modified, page_text


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    for name, want in (("OpenAI:gpt", ("openai", "gpt")), ("a:b:c", ("a", "b:c")), ("Plain", ("plain", "")), (None, (None, None))):
        assert tuple(value(spark, X.separate_name(F.lit(name).cast("string")))) == want


@pytest.mark.parametrize("path,want", [(".", "chromadb/NoPaReNtDiR_openai_text-embed_1000"), ("docs/a_b/c.d", "chromadb/docs-ab-c.d_openai_text-embed_1000"), ("https://example.com/some/long/path/with-parts", "chromadb/httpsexamplecomsomelongpathwit_openai_text-embed_1000")])
def test_storage_name(spark, path, want):
    assert value(spark, X.storage_name(F.lit(path), F.lit(1000), F.lit("openai"), F.lit("text/embed"))) == want


def test_counts_and_cleaning(spark):
    assert value(spark, X.word_count(F.lit("a  b　c\n"))) == 3 and value(spark, X.word_count(F.lit(None).cast("string"))) == 0
    assert value(spark, X.clean_category(F.lit(" !? "))) == "uncategorized" and value(spark, X.clean_category(F.lit("A/b_ "))) == "Ab_"
    assert value(spark, X.first_number(F.lit("score 7.126 of 10"))) == 7.126 and value(spark, X.first_number(F.lit("none"))) == 0.0
    assert value(spark, X.answer_digit(F.lit('{"ans": "3"}'))) == "3" and value(spark, X.answer_digit(F.lit("no"))) == "-1"
    assert value(spark, X.language_name(F.lit("xx"))) == "traditional chinese" and value(spark, X.thinking_budget(F.lit("high"), F.lit(10_000))) == 8000
    assert value(spark, X.is_blank(F.lit("  "))) and value(spark, X.basename(F.lit("a\\b/c.txt"))) == "c.txt"


def test_json():
    assert find_objects("```json\n{'a': 'x', 'b': True,}\n```") == ['{"a": "x", "b": true}']
    assert find_objects('one {"a": {"b": 1}} two {"c": [1, 2]} {broken') == ['{"a": {"b": 1}}', '{"c": [1, 2]}']
    assert find_objects(None) == [] and find_objects("{not json}") == []


@pytest.mark.parametrize("s,want", [("1 + 2 * 3", 7), ("(1+2)*3", 9), ("-4 / 2", -2), ("7 % 4", 3), ("2**9", None), ("__import__('os')", None), ("1/0", None), ("(1", None), ("", None)])
def test_calculate(s, want):
    assert calculate(s) == want


def test_vectors(spark):
    a, b = (F.array(*[F.lit(float(x)) for x in v]) for v in ((3, 4), (4, 3)))
    assert value(spark, cosine(a, b)) == pytest.approx(0.96) and value(spark, squared_l2(a, b)) == 2.0
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, cosine(a, zero)) is None and not value(spark, usable(zero, 2)) and value(spark, usable(a, 2))


def test_html(spark):
    html = "<html><head><title> T </title><meta name='x'></head><body><nav>menu</nav><h1>Head</h1><p>Some <b>text</b></p><a>link</a><footer>end</footer></body></html>"
    assert page_text(html) == ("T", "T Head Some text") and page_text(None) == ("", "") and page_text("<p>x")[0] == "No title found"
    assert str(value(spark, last_modified(F.lit("Tue, 03 Jun 2025 10:20:30 GMT")))) == "2025-06-03 10:20:30" and value(spark, last_modified(F.lit("soon"))) is None
