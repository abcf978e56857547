import pytest
from pyspark.sql import functions as F

from querndal.operators import evals, models, prompts, rag


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t) for i, t in enumerate(["the code is 4711", "a red fox", "the code of the fox", "", "a red fox"])]
    df = spark.createDataFrame(rows, "ord bigint, text string")
    return df.withColumn("vector", models.embed(F.col("text"), "stub:hash")).cache()


def asked(spark, *texts):
    df = spark.createDataFrame([*enumerate(texts)], "query_id bigint, text string")
    return df.withColumn("vector", models.embed(F.col("text"), "stub:hash"))


@pytest.mark.parametrize("kind", ["auto", "knn", "bm25", "tfidf", "faiss", "mmr", "merge", "auto_rerank", "rerank"])
def test_search_finds_the_planted_text(spark, corpus, kind):
    out = rag.search(corpus, asked(spark, "code 4711"), kind, k=4, budget=6, knn_least=0.1).orderBy("place").collect()
    assert out and "the code is 4711" in [r.text for r in out] and out[-1].total_words <= 6
    assert len({r.text for r in out}) == len(out)


def test_answers(spark, corpus):
    got = rag.rag(corpus, asked(spark, "code 4711", "zzz"), lambda p: p.split("\n\n")[-1], search_type="bm25", k=1).collect()
    assert {r.query_id: (r.answer, r.n_chunks) for r in got} == {0: ("the code is 4711", 1), 1: ("", 0)}
    two = rag.self_ask(corpus, asked(spark, "who?"), lambda q: ["red fox", "code 4711"], lambda p: p[-20:], k=1, budget=9).collect()
    assert [(r.query_id, r.n_followups) for r in two] == [(0, 2)]
    docs = spark.createDataFrame([("g", i, f"part {i} " + "w " * 30) for i in range(4)], "by string, ord bigint, text string")
    assert rag.ask(docs, "by", "ord", "text", "?", lambda p: "short", budget=40).collect()[0].n_bins == 4


def test_memory(spark):
    turns = spark.createDataFrame([(0, "where is the key", "under the mat", None), (1, " ", None, None), (2, "who sings", "a bird", None)], "ord bigint, prompt string, response string, at timestamp")
    memory = rag.memory_entries(turns, lambda t: "Home/!" if "key" in t else "")
    assert {(r.ord, r.category) for r in memory.collect()} == {(0, "Home"), (2, "uncategorized")}
    assert rag.search_memory(memory, asked(spark, "the key under the mat"), 1).collect()[0].ord == 0


def test_memory_finds_k_texts_behind_copies(spark):
    said = ["the key under the mat"] * 20 + ["the key under the rug"] * 15 + ["the key"]
    turns = spark.createDataFrame([(i, t, "yes", None) for i, t in enumerate(said)], "ord bigint, prompt string, response string, at timestamp")
    found = rag.search_memory(rag.memory_entries(turns), asked(spark, "the key under the mat"), 3).collect()
    assert {r.ord for r in found} == {0, 20, 35} and {r.place for r in found} == {1, 2, 3}


def test_evaluate(spark):
    schema = "qid int, question_style string, question_type string, question string, choices array<string>, answer string"
    q = spark.createDataFrame([(1, "essay", "fact", "q", None, "the cat"), (2, "single_choice", "fact", "q", ["a", "b"], "2"), (3, "essay", "summary", "q", None, None)], schema)
    out = evals.evaluate(q, spark.createDataFrame([(1, "c")], "qid int, context string"), lambda p: "the cat 2", lambda p: "0.5 of 1")
    got = {r.qid: (r.rouge, r.llm_score, r.hit) for r in out.collect()}
    assert got == {1: (0.8, 0.5, None), 2: (None, None, 1.0), 3: (0.0, 0.5, None)}
    assert {(r.question_type, r.n, r.hit) for r in evals.evaluation_summary(out).collect()} == {("fact", 2, 1.0), ("summary", 1, 0.0)}


def test_models_and_prompts(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return x

    assert models.retried(flaky, 3)("y") == "y" and len(calls) == 3
    with pytest.raises(ValueError):
        models.model("nothing")
    row = spark.range(1).select(prompts.chat(F.lit(""), F.lit("p")).alias("a"), prompts.plain(F.lit("s"), F.lit("p")).alias("b"), prompts.with_essay_note(F.lit("s"), F.lit("essay"), F.lit("ch")).alias("c")).first()
    assert [tuple(m) for m in row.a] == [("user", "p")] and row.b == "s\n\np" and row.c == "請用中文回答 s"
    assert prompts.schema_text({"a": "int", "b": "odd"}) == '{"a": int, "b": str}'
    with pytest.raises(ValueError):
        evals.check_question_kind("single_choice", "summary")
