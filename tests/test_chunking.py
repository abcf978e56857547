import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querndal.operators import chunking as C
from querndal.operators import summarize, windows
from querndal.operators.evals import format_question, parse_question_answer, single_choice, valid_choice


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ,.\n。!", max_size=120), st.integers(3, 30), st.integers(0, 2))
def test_recursive_split(text, size, overlap):
    pieces = C.split_recursive(text, size, overlap)
    longest = max((len(x) for x in "".join(" " if c in "".join(C.SEPARATORS) else c for c in text).split()), default=0)
    assert all(p.strip() == p and p and len(p) <= max(size, longest + 1) for p in pieces)
    assert set("".join(text.split())) <= set("".join(pieces)) | set(C.SEPARATORS)


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        C.split_recursive("a b", 5, 5)


@given(st.text(alphabet="ab ", min_size=1, max_size=80), st.integers(1, 5))
def test_halves_reassemble(text, most):
    parts = C.halve(text, most)
    # The width is that of the first slice that fits; later slices may hold more words.
    assert "".join(parts) == text and C.n_words(parts[0]) <= most and len({len(p) for p in parts[:-1]} | {len(parts[0])}) == 1 and len(parts[-1]) <= len(parts[0])


def test_pack(spark):
    rows = [("a", 0, "1 2 3 4 5 6 7 8"), ("a", 1, "1 2 3 4 5 6 7"), ("a", 2, " "), ("a", 3, "x y"), ("a", 4, "z"), ("b", 0, None), (None, 0, "n")]
    docs = spark.createDataFrame(rows, "by string, ord bigint, text string")
    out = C.pack_documents(docs, "by", "ord", "text", 4).collect()
    assert all(r.text.strip() and r.n_tokens <= 5 for r in out) and {r.by for r in out} == {"a", None}
    joined = "".join(r.text for r in sorted((r for r in out if r.by == "a"), key=lambda r: r.bin))
    assert "".join(joined.split()) == "12345678" + "1234567" + "xyz"
    calls = C.pack_calls(docs, "by", "ord", "text", 4).where("by = 'a'").orderBy("call").collect()
    assert [r.n_chunks for r in calls] == [1, 1, 3] or sum(r.n_chunks for r in calls) == 5
    assert C.pack_documents(docs.limit(0), "by", "ord", "text", 4).count() == 0


def test_estimates(spark):
    row = spark.range(1).select(C.call_count(F.lit(10), F.lit(3)).alias("a"), C.call_count(F.lit(1), F.lit(2)).alias("b"), C.chunks_per_call(F.lit("traditional chinese"), F.lit(3000), F.lit(500), F.lit(1000)).alias("c")).first()
    assert tuple(row) == (4 + 2 + 1, 0, 5)


def test_history(spark):
    rows = [(1, 0, "User", "q one", "2024-01-01 00:00:00"), (1, 1, "assistant", "a one", "2024-01-01 00:00:01"), (1, 2, "USER", "q two", "2024-01-01 00:00:02"), (1, 3, "Assistant", "a two", "2024-01-01 00:00:03"), (2, 0, "User", None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, content string, sent_at string").withColumn("sent_at", F.col("sent_at").cast("timestamp"))
    out = {r.conv_id: (r.history, r.n_tokens) for r in windows.history_window(turns, 1, 100).collect()}
    assert out == {1: ("User: q two\nAssistant: a two", 6), 2: ("", 0)}


def test_windows(spark):
    df = spark.createDataFrame([("a", i, str(i)) for i in range(7)], "by string, ord bigint, v string")
    assert windows.full_windows(df, "by", "ord", "v", 3).count() == 5
    starts = sorted(r.start for r in windows.disjoint_starts(df, "by", "ord", 3).collect())
    assert starts and all(b - a >= 3 for a, b in zip(starts, starts[1:], strict=False)) and starts[-1] <= 4
    assert {r.batch for r in windows.batches(df, "by", "ord", 3).collect()} == {0, 1, 2}


def test_choices(spark):
    wrong = F.array(F.lit("x"), F.lit("y\n"))
    for place, want in ((0, ["1.r", "2.x", "3.y", "1"]), (1, ["1.x", "2.r", "3.y", "2"]), (2, ["1.x", "2.y", "3.r", "3"])):
        assert spark.range(1).select(single_choice(wrong, F.lit("r"), F.lit(place))).first()[0] == want
    row = spark.range(1).select(valid_choice(wrong, F.lit(" 2 ")).alias("a"), valid_choice(wrong, F.lit("3")).alias("b"), format_question(F.lit("q"), wrong).alias("c"), parse_question_answer(F.lit("Question： a? Answer: b")).alias("d")).first()
    assert row.a and not row.b and row.c == "q\n1. x\n2. y\n" and tuple(row.d) == ("a?", "b")


def test_summaries(spark):
    docs = spark.createDataFrame([(1, "word " * 900), (2, "short text."), (3, "")], "doc_id bigint, text string")
    out = {r.doc_id: r.summary for r in summarize.map_reduce(docs, "doc_id", "text", lambda p: p.split("\n\n")[-1][:40], budget=100).collect()}
    assert set(out) == {1, 2} and len(out[1]) <= 40
    assert {r.doc_id for r in summarize.refine(docs, "doc_id", "text", lambda p: p[-20:]).collect()} == {1, 2}
