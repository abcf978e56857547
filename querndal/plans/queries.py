"""Core queries by name, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_text
from ..functions import text as X
from ..functions.vectors import cosine, squared_l2, usable
from ..operators import aggregates as A
from ..operators import chunking as C
from ..operators import evals as E
from ..operators import filters as FL
from ..operators import fuse, prompts, rag
from ..operators import retrieve as R
from ..operators import summarize as SM
from ..operators import windows as W
from ..operators.models import answer, embed
from ..runtime import cut, parallel, shared_dir, table
from ..sources import ledger as L
from ..sources import store
from ..sources.html import extract_page, last_modified

FIELDS = [
    {"name": "chunk_size", "description": "size of the chunk", "type": "integer"},
    {"name": "chunk_overlap", "description": "overlap of the chunk", "type": "integer"},
    {"name": "title", "description": "title of the page", "type": "string"},
    {"name": "source", "description": "path of the file", "type": "string"},
    {"name": "url", "description": "address of the page", "type": "string"},
]
NOW = "2025-06-01 00:00:00"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def dbs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "dbs")


# Projections and filters


@query
def project_chunks(spark, d):
    return dbs(spark, d).select("ord", "ids", F.coalesce("docs", F.lit("")).alias("docs"), F.coalesce(F.size("embeds"), F.lit(0)).alias("dims"))


@query
def first_chunks(spark, d):
    return dbs(spark, d).select("ord", "source").orderBy("ord").limit(100)


@query
def filter_by_file(spark, d):
    return FL.by_file(dbs(spark, d), ["x/manual_0011.pdf", "report_0001.docx", ".\\manual_0003.docx"]).select("ord", "source")


@query
def filter_by_keyword(spark, d):
    return FL.by_keyword(dbs(spark, d), ["token counter", "chunk_size", "向量"]).select("ord", "keyword_no")


def _every_fiftieth(spark, d):
    return dbs(spark, d).where(F.col("ord") % 50 == 0).select("ids")


@query
def filter_by_ids(spark, d):
    return FL.by_ids(dbs(spark, d), _every_fiftieth(spark, d)).select("ord", "ids")


@query
def pop_by_ids(spark, d):
    return FL.pop_ids(dbs(spark, d), _every_fiftieth(spark, d)).select("ord", "ids")


@query
def filter_metadata(spark, d):
    return FL.by_metadata(dbs(spark, d), "and(gte(chunk_size, 1000), or(lt(chunk_overlap, 200), eq(title, release)))", FIELDS).select("ord", F.array_join("matched_fields", ",").alias("matched"))


@query
def filter_metadata_loose(spark, d):
    return FL.by_metadata(dbs(spark, d), "AND(eq(title, notes), ne(chunk_size, 1000))", FIELDS, loose=True).select("ord", F.array_join("matched_fields", ",").alias("matched"))


@query
def self_query_stub(spark, d):
    rows, _ = FL.self_query(dbs(spark, d), "pages of guides", FIELDS, lambda prompt, fields: '{"query": "guides", "filter": "eq(url, /guide/)"}')
    return rows.select("ord", F.array_join("matched_fields", ",").alias("matched"))


@query
def non_blank_chunks(spark, d):
    return A.non_blank(dbs(spark, d)).select("ord")


# Store operations


@query
def merge_stores(spark, d):
    rows = dbs(spark, d).select("ids", "ord", "source")
    return store.merge(rows.where("page is null"), rows.where("page is not null")).select("ids", "ord")


@query
def append_stores(spark, d):
    rows = dbs(spark, d).select("ids", "ord")
    return rows.where("ord % 2 = 0").unionByName(rows.where("ord % 2 = 1"))


@query
def update_metadata(spark, d):
    rows = dbs(spark, d).select("ids", "ord", "metadatas")
    changes = rows.where("ord % 3 = 0").select("ids", F.create_map(F.lit("state"), F.lit("changed")).alias("metadatas"))
    return store.update_metadata(rows, changes).select("ord", F.try_element_at("metadatas", F.lit("state")).alias("state"), F.try_element_at("metadatas", F.lit("chunk_size")).alias("chunk_size"))


@query
def delete_by_file(spark, d):
    gone = table(spark, d, "ledger").where("kind = 'file' and item is not null").select(X.basename(F.col("item")).alias("file")).where("file like 'report%'").distinct()
    return store.delete_files(dbs(spark, d).select("ord", "source"), gone).select("ord", "source")


@query
def delete_by_collection(spark, d):
    """What is left of a store when the folder of its first collection is deleted; deleting it again finds nothing."""
    base, rows = _folder(spark), dbs(spark, d).select("ord", "collection")
    store.append(rows, base)
    first = rows.agg(F.min("collection")).first()[0]
    gone, again = (store.drop_collection(spark, base, first) for _ in range(2))
    return store.read_store(spark, base).groupBy("collection").agg(F.count(F.lit(1)).alias("n")).withColumns({"deleted": F.lit(gone), "deleted_again": F.lit(again)})


# Ledger


@query
def ledger_current(spark, d):
    return L.current(table(spark, d, "ledger")).select("collection", "item", "mtime", "written_at")


@query
def ledger_file_status(spark, d):
    ledger = table(spark, d, "ledger").where("kind = 'file'")
    files = ledger.where("item is not null").groupBy("collection", "item").agg(F.max("mtime").alias("mtime"))
    return L.file_status(files, L.current(ledger.where("written_at < timestamp'2025-01-01 00:00:00'"))).select("collection", "item", "status")


@query
def ledger_url_status(spark, d):
    ledger = table(spark, d, "ledger").where("kind = 'url'")
    urls = ledger.where("item is not null").select("collection", "item").distinct()
    return L.url_status(urls, L.current(ledger), F.lit(NOW).cast("timestamp"), 30).select("collection", "item", "status")


# Aggregations


@query
def dedupe_text(spark, d):
    return A.first_by_text(dbs(spark, d).select("ord", "docs")).select("ord")


@query
def group_concat_ref(spark, d):
    return A.reference_texts(dbs(spark, d)).select("ref", "part", F.md5("text").alias("text_md5"), "n_chunks")


@query
def group_pages(spark, d):
    return A.pages_by_file(dbs(spark, d)).select("source", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query
def files_by_parent(spark, d):
    return A.files_by_parent(dbs(spark, d))


@query
def source_phrase(spark, d):
    return A.source_phrase(dbs(spark, d).where(~X.is_url(F.col("source"))), "collection", "根據文件")


@query
def same_category(spark, d):
    return A.same_category(table(spark, d, "documents"), "category", "source", "doc_id", 3).select("category", "n", "first_at", F.array_join("nouns", "|").alias("nouns"))


@query
def mean_scores(spark, d):
    return A.mean_scores(table(spark, d, "handle_table"), "model", ["bert", "rouge", "llm_score"])


@query
def choice_accuracy(spark, d):
    runs, questions = table(spark, d, "handle_table").select("run_id", "qid", "response"), table(spark, d, "questions").where("question_style = 'single_choice'")
    judged = runs.join(questions, "qid").withColumn("hit", A.hit(F.col("response"), F.col("answer")))
    return E.accuracy(judged, "question_type").select("question_type", "n", F.round("accuracy", 6).alias("accuracy"))


@query
def df_stats(spark, d):
    docs = table(spark, d, "documents").select(X.tokens(F.col("text")).alias("words"))
    return R.document_frequency(docs)


@query
def length_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(X.word_count(F.col("text"))).alias("n_words"), F.sum(F.char_length("text")).alias("n_chars"))


# Vectors and retrieval


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))


def _vector_queries(spark, d):
    return _vectors(spark, d).where("ord % 50 = 0").select(F.col("ord").alias("query_id"), "vector")


@query
def knn_cosine(spark, d):
    return R.nearest(_vectors(spark, d), _vector_queries(spark, d), 10).select("query_id", "ord", "score", "score_norm", "rank")


@query
def knn_threshold(spark, d):
    return R.nearest(_vectors(spark, d), _vector_queries(spark, d), 20).where("score_norm >= 0.7").select("query_id", "ord", "rank")


@query
def l2_flat(spark, d):
    return R.nearest(_vectors(spark, d), _vector_queries(spark, d), 10, "l2").select("query_id", "ord", "score", "rank")


@query
def vector_norms(spark, d):
    v = _vectors(spark, d)
    zero = F.array_repeat(F.lit(0.5), 64)
    return v.where(usable(F.col("vector"), 64)).select("ord", F.round(cosine(F.col("vector"), zero), 6).alias("cos"), F.round(squared_l2(F.col("vector"), zero), 6).alias("d2"))


@query
def knn_store(spark, d):
    """Nearest chunks of the store for every fiftieth record."""
    v = parallel(dbs(spark, d).where(usable(F.col("embeds"), 64)).select("ord", F.col("embeds").alias("vector")))
    return R.nearest(v, v.where("ord % 50 = 0").select(F.col("ord").alias("query_id"), "vector"), 5).select("query_id", "ord", "score", "rank")


@query
def mmr_topk(spark, d):
    return R.mmr(_vectors(spark, d), _vector_queries(spark, d), 3)


@query
def svm_topk(spark, d):
    return R.exemplar_svm(_vectors(spark, d), _vector_queries(spark, d), 5)


@query
def custom_retriever(spark, d):
    def farthest(q, m, k):
        import numpy as np

        return list(np.argsort(-((m - q) ** 2).sum(1), kind="stable")[:k])

    return R.custom(_vectors(spark, d), _vector_queries(spark, d), farthest, 3)


@query
def recall_at_k(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), "label")
    near = R.nearest(_vectors(spark, d), _vector_queries(spark, d), 11).where("ord <> query_id")
    own = labels.select(F.col("ord").alias("query_id"), F.col("label").alias("own"))
    return near.join(labels, "ord").join(own, "query_id").groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 6).alias("share"))


def _texts(spark, d):
    return parallel(table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text"))


def _text_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query
def bm25_topk(spark, d):
    return R.lexical(_texts(spark, d), _text_queries(spark, d), 5, "bm25")


@query
def tfidf_topk(spark, d):
    return R.lexical(_texts(spark, d), _text_queries(spark, d), 5, "tfidf")


@query
def rerank_stub(spark, d):
    near = R.lexical(_texts(spark, d), _text_queries(spark, d), 20, "bm25").select("query_id", "ord")
    pool = near.join(_texts(spark, d), "ord").join(_text_queries(spark, d).withColumnRenamed("text", "query"), "query_id")
    return R.rerank(pool, R.overlap_scorer, 0.2)


def _hybrid(spark, d):
    docs = parallel(table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text"))
    chunks = cut(docs.join(_vectors(spark, d), "ord").where("text is not null"))  # read by several retrievers
    queries = chunks.where("ord % 50 = 0").select(F.col("ord").alias("query_id"), "text", "vector")
    return chunks, queries


def _two_lists(spark, d, k=10):
    chunks, queries = _hybrid(spark, d)
    knn = R.nearest(chunks.select("ord", "vector"), queries, k).join(chunks.select("ord", "text"), "ord")
    bm25 = R.lexical(chunks.select("ord", "text"), queries.select("query_id", "text"), k).join(chunks.select("ord", "text"), "ord")
    return knn, bm25


def _ranked(spark, d):
    knn, bm25 = _two_lists(spark, d)
    return knn.select("query_id", F.lit(0).alias("retriever_idx"), "rank", "ord", "text").unionAll(bm25.select("query_id", F.lit(1), "rank", "ord", "text"))


@query
def fuse_round_robin(spark, d):
    return fuse.round_robin(_ranked(spark, d), 400).select("query_id", "ord", "place", "total_words")


@query
def fuse_concat(spark, d):
    return fuse.concatenated(_ranked(spark, d), 8).select("query_id", "ord", "place")


@query
def auto_hybrid(spark, d):
    knn, bm25 = _two_lists(spark, d)
    return fuse.auto(knn, bm25, 500, bm25_least=70.0).select("query_id", "ord", "place", "total_words")


@query
def auto_rerank_stub(spark, d):
    chunks, queries = _hybrid(spark, d)
    return rag.search(chunks, queries, "auto_rerank", 20, 800, knn_least=0.3).select("query_id", "ord", "place")


@query
def merge_search(spark, d):
    chunks, queries = _hybrid(spark, d)
    return rag.search(chunks, queries, "merge", 10, 600).select("query_id", "ord", "place")


@query
def hybrid_search(spark, d):
    chunks, queries = _hybrid(spark, d)
    return rag.search(chunks, queries, "auto", 10, 500).select("query_id", "ord", "place", "total_words")


@query
def rag_answer_stub(spark, d):
    chunks, queries = _hybrid(spark, d)
    return rag.rag(chunks, queries, k=5, budget=300)


@query
def self_ask_stub(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("ord"), "text").withColumn("vector", embed(F.col("text"), "stub:hash"))
    asked = table(spark, d, "questions").where("qid % 50 = 0").select(F.col("qid").cast("bigint").alias("query_id"), F.col("question").alias("text"))
    return rag.self_ask(rows, asked, lambda q: [f"What is {w}?" for w in sorted(set((q or "").split()))[:2]], k=3, budget=200)


@query
def ask_stub(spark, d):
    return rag.ask(table(spark, d, "documents"), "category", "doc_id", "text", "What is this about?", budget=3000)


@query
def references_stub(spark, d):
    return rag.references(dbs(spark, d), "The chunks were counted.", lambda p: "yes" if "chunk" in p.split("\n\n")[-1] else "no").select("ref", F.array_join("parts", ",").alias("parts"))


# Windows and packing


@query
def budget_prefix(spark, d):
    docs = table(spark, d, "documents").where("source is not null")
    return W.prefix_within(docs, "source", ["doc_id"], X.word_count(F.col("text")), 2000).select("source", "doc_id", "total")


@query
def history_window(spark, d):
    return W.history_window(table(spark, d, "history"), 3, 200)


@query
def doc_windows(spark, d):
    return W.full_windows(table(spark, d, "documents").where("source is not null"), "source", "doc_id", "text", 3).select("source", "start", F.md5(F.array_join("values", "|")).alias("window_md5"))


@query
def window_starts(spark, d):
    return W.disjoint_starts(table(spark, d, "documents").where("source is not null"), "source", "doc_id", 3)


@query
def doc_batches(spark, d):
    return W.batches(table(spark, d, "documents").where("source is not null"), "source", "doc_id", 10).groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query
def roles_by_position(spark, d):
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"])
    rows = table(spark, d, "history").groupBy("conv_id").agg(turns.alias("texts"))
    return rows.select("conv_id", F.md5(F.array_join(F.transform(W.roles_by_position(F.col("texts")), lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("messages_md5"))


@query
def merge_history(spark, d):
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"])
    return table(spark, d, "history").groupBy("conv_id").agg(turns.alias("texts")).select("conv_id", F.md5(W.merge_history(F.col("texts"), F.lit("And then?"))).alias("prompt_md5"))


@query
def chunk_documents(spark, d):
    return C.chunk_documents(parallel(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", 1000, 100).select("doc_id", "chunk_no", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


@query
def pack_documents(spark, d):
    return C.pack_documents(table(spark, d, "documents").where("source is not null"), "source", "doc_id", "text", 1000).select("source", "bin", "n_tokens", F.md5("text").alias("text_md5"))


@query
def pack_calls(spark, d):
    return C.pack_calls(table(spark, d, "documents").where("source is not null"), "source", "doc_id", "text", 1000, 100)


@query
def halve_oversize(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(C.halves(F.col("text"), 40)).alias("part", "piece")).select("doc_id", "part", F.char_length("piece").alias("n_chars"))


@query
def split_reference(spark, d):
    return C.split_reference(table(spark, d, "documents").where("text is not null").select("doc_id", "text"), "text", 60).select("doc_id", "half", F.md5("text").alias("text_md5"))


@query
def format_context(spark, d):
    return C.format_context(table(spark, d, "documents").where("source is not null"), "source", "doc_id", "text").select("source", F.md5("context").alias("context_md5"))


@query
def call_estimate(spark, d):
    per = C.chunks_per_call(X.language_name(F.col("lang")), F.lit(3000), F.lit(500), F.lit(1000))
    counts = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("chunks"))
    return counts.select("lang", "chunks", per.alias("per_call")).withColumn("calls", C.call_count(F.col("chunks"), F.col("per_call")))


# Scalars


@query
def doc_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"), F.coalesce(F.size(X.tokens(F.col("text"))), F.lit(0)).alias("n_tokens"))


@query
def split_model_name(spark, d):
    return table(spark, d, "handle_table").select("run_id", X.separate_name(F.col("model")).alias("m")).select("run_id", "m.type", "m.name")


@query
def storage_names(spark, d):
    return dbs(spark, d).select("ord", X.storage_name(F.translate("source", "\\", "/"), F.lit(1000), F.lit("openai"), F.lit("text/embed")).alias("store"), X.is_url(F.col("source")).alias("url"), F.md5("docs").alias("docs_md5"))


@query
def category_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", X.clean_category(F.concat_ws(": ", "category", "title")).alias("clean"))


@query
def answer_digits(spark, d):
    return table(spark, d, "handle_table").select("run_id", X.first_number(F.col("response")).alias("number"), X.answer_digit(F.col("response")).alias("digit"))


@query
def json_objects(spark, d):
    return table(spark, d, "handle_table").select("run_id", json_text.extract_object(F.col("response")).alias("object")).where("object is not null")


@query
def language_names(spark, d):
    return table(spark, d, "documents").select("doc_id", X.language_name(F.col("lang")).alias("language"))


@query
def thinking_budgets(spark, d):
    level = F.element_at(F.array(*[F.lit(x) for x in X.THINKING]), (F.col("run_id") % 4 + 1).cast("int"))
    return table(spark, d, "handle_table").select("run_id", X.thinking_budget(level, F.char_length(F.coalesce("response", F.lit("")))).alias("budget"))


@query
def trace_truncated(spark, d):
    return dbs(spark, d).where("docs is not null").select("ord", F.md5(X.truncate_trace(F.col("docs"), 4000)).alias("trace_md5"))


@query
def content_blocks(spark, d):
    blocks = F.array(F.struct(F.lit("thinking").alias("type"), F.col("prompt").alias("text")), F.struct(F.lit("text").alias("type"), F.col("response").alias("text")))
    return table(spark, d, "handle_table").select("run_id", F.md5(X.blocks_to_text(blocks)).alias("answer_md5"), F.md5(X.blocks_to_text(blocks, ("thinking",))).alias("thinking_md5"))


@query
def prompt_messages(spark, d):
    style = prompts.style_of(F.lower(F.split_part("model", F.lit(":"), F.lit(1))), F.coalesce("model", F.lit("")))
    gpt = prompts.chat(F.lit("Be brief."), F.col("prompt"))
    return table(spark, d, "handle_table").select("run_id", style.alias("style"), F.md5(F.array_join(F.transform(gpt, lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|")).alias("chat_md5"), F.md5(prompts.plain(F.lit("Be brief."), F.col("prompt"), "llama")).alias("llama_md5"))


@query
def run_parameters(spark, d):
    rows = table(spark, d, "handle_table").select("run_id", prompts.run_parameters(["model", "lang"]).alias("p"), prompts.metadata_line(F.col("metadata")).alias("line"))
    return rows.select("run_id", F.size("p").alias("n_parameters"), F.try_element_at("p", F.lit("model")).alias("model"), F.md5("line").alias("line_md5"))


@query
def html_pages(spark, d):
    safe = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><head><title>"), title, F.lit("</title><meta charset='utf-8'></head><body><nav>menu</nav><p>"), safe, F.lit("</p><a href='#'>more</a><footer>end</footer></body></html>"))
    page = parallel(table(spark, d, "documents").select("doc_id", html.alias("html"))).select("doc_id", extract_page(F.col("html")).alias("p"))
    return page.select("doc_id", "p.title", F.md5("p.text").alias("text_md5"))


@query
def header_dates(spark, d):
    return dbs(spark, d).where("created_at is not null").select("ord", last_modified(F.concat(F.lit("Tue, "), F.date_format("created_at", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).alias("modified"))


# Evaluation, memory, summaries


@query
def rouge_l(spark, d):
    runs = parallel(table(spark, d, "handle_table").select("run_id", "prompt", "response"))
    return runs.select("run_id", E.rouge_l_score(F.col("response"), F.col("prompt")).alias("rouge_l"))


@query
def question_choices(spark, d):
    q = table(spark, d, "questions")
    return q.select("qid", F.md5(E.format_question(F.col("question"), F.col("choices"))).alias("text_md5"), E.valid_choice(F.col("choices"), F.col("answer")).alias("valid"))


@query
def single_choice_build(spark, d):
    q = table(spark, d, "questions").where("choices is not null")
    return q.select("qid", F.array_join(E.single_choice(F.slice("choices", 2, 3), F.element_at("choices", 1), (F.col("qid") % 4).cast("int")), "|").alias("built"))


@query
def create_questions_stub(spark, d):
    generate = lambda p: f"question: What says {p.split()[-1] if p.split() else ''}? answer: {len(p)}"
    return E.create_questions(table(spark, d, "documents").where("source is not null").select(F.col("doc_id").alias("ord"), "source", F.col("text").alias("docs")), generate)


@query
def compare_questions_stub(spark, d):
    generate = lambda p: f"question: How do they differ? answer: {p.split(': ')[-1]}"
    return E.create_compare_questions(table(spark, d, "documents"), "category", "source", "doc_id", generate)


@query
def topic_questions_stub(spark, d):
    chunks, queries = _hybrid(spark, d)
    generate = lambda p: f"question: What is it about? answer: {len(p)}"
    return E.create_topic_questions(rag.search(chunks, queries, "knn", 5, 300), generate)


@query
def evaluation_stub(spark, d):
    questions = table(spark, d, "questions")
    contexts = table(spark, d, "handle_table").where("qid is not null").groupBy("qid").agg(F.min(F.array_join("inputs", " ")).alias("context"))
    return E.evaluation_summary(E.evaluate(questions, contexts, lambda p: p.split("\n")[-1], lambda p: f"{min(1.0, len(p) / 1000):.3f}"))


@query
def search_function(spark, d):
    """The SQL table function over the documents, for one question."""
    table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text").createOrReplaceTempView("searchable_documents")
    rag.register_search(spark, "searchable_documents")
    return spark.sql("SELECT ord, hits FROM chunk_search('How does the token counter handle chunks at night?', 20)")


@query
def memory_search(spark, d):
    turns = table(spark, d, "handle_table").select(F.col("run_id").alias("ord"), "prompt", "response", F.col("ts").alias("at"))
    memory = rag.memory_entries(turns)
    asked = table(spark, d, "questions").where("qid % 50 = 0").select(F.col("qid").cast("bigint").alias("query_id"), embed(F.col("question"), "stub:hash").alias("vector"))
    return rag.search_memory(memory, asked, 3).select("query_id", "ord", "place")


@query
def summarize_stub(spark, d):
    return SM.map_reduce(table(spark, d, "documents").where("text is not null"), "doc_id", "text", "stub:first_sentence").select("doc_id", F.char_length("summary").alias("n_chars"))


@query
def refine_stub(spark, d):
    return SM.refine(table(spark, d, "documents").where("text is not null"), "doc_id", "text", "stub:first_sentence").select("doc_id", F.char_length("summary").alias("n_chars"))


@query
def model_answers(spark, d):
    return table(spark, d, "questions").select("qid", answer(F.col("question"), "stub:first_sentence").alias("reply"))


# Streaming


@query
def stream_ingest(spark, d):
    """Ledger rows of files as a stream of file versions; the store keeps the newest of each."""
    from ..streaming.ingest import current_store, stream_files

    base = _folder(spark)
    versions = f"{base}/in"
    table(spark, d, "ledger").where("kind = 'file' and item is not null").select("collection", "item", "mtime", F.concat_ws(" ", "item", F.round(F.col("mtime") * 1000).cast("bigint")).alias("text")).write.parquet(versions)
    items = spark.readStream.schema("collection string, item string, mtime double, text string").option("maxFilesPerTrigger", 4).parquet(versions)
    stream_files(items, f"{base}/store", f"{base}/ledger", f"{base}/checkpoint").awaitTermination()
    return current_store(spark, f"{base}/store").select("collection", "item", "text")


def _folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, whatever file system holds it."""
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query
def stream_fetches(spark, d):
    """Windows of fetched urls over a stream of ledger rows with a watermark."""
    from ..streaming.ingest import stale_urls, window_counts

    base = _folder(spark)
    table(spark, d, "ledger").where("kind = 'url' and fetched_at is not null").select("item", "fetched_at").write.parquet(f"{base}/in")
    rows = spark.readStream.schema("item string, fetched_at timestamp").parquet(f"{base}/in")
    stale_urls(rows, "400 days", 30).writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return window_counts(spark.read.schema("start timestamp, item string").parquet(f"{base}/out"))


@query
def memory_stream(spark, d):
    """Turns as a stream into the memory, and what it holds afterwards by category."""
    from ..streaming.ingest import read_memory, stream_memory

    base = _folder(spark)
    table(spark, d, "handle_table").select(F.col("run_id").alias("ord"), "prompt", "response", F.col("ts").alias("at")).write.parquet(f"{base}/in")
    turns = spark.readStream.schema("ord bigint, prompt string, response string, at timestamp").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    stream_memory(turns, f"{base}/memory", f"{base}/checkpoint", lambda t: f"{len(t) % 7} parts!").awaitTermination()
    return read_memory(spark, f"{base}/memory").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), F.sum(F.char_length("text")).alias("n_chars"))


# Files, stores and sinks


def _text_folders(spark, d, base: str) -> None:
    """The documents of each source as one text file, a document a line, in a folder named by the source's hash."""
    docs = table(spark, d, "documents").where("source is not null").select(F.md5("source").alias("place"), "doc_id", F.translate(F.coalesce("text", F.lit("")), "\n\r", "  ").alias("value"))
    docs.repartition("place").sortWithinPartitions("place", "doc_id").select("place", "value").write.partitionBy("place").text(base)


def _folders_of(spark, base: str) -> list[str]:
    return [r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select(F.regexp_extract("path", "^(.*)/", 1)).distinct().collect()]


@query
def process_db(spark, d):
    """Folders into the store and back: once to build, a second time when nothing is new."""
    from ..sources.load import process_db as build

    base = _folder(spark)
    _text_folders(spark, d, f"{base}/in")
    folders = _folders_of(spark, f"{base}/in")
    build(spark, folders, f"{base}/store", f"{base}/ledger", 10**9, 0)
    chunks, _ = build(spark, [*folders, f"{base}/nowhere"], f"{base}/store", f"{base}/ledger", 10**9, 0)
    times = spark.read.parquet(f"{base}/ledger").groupBy(F.col("item").alias("source")).agg(F.count(F.lit(1)).alias("times_built"))
    return chunks.join(times, "source").select(F.regexp_extract("source", "place=([0-9a-f]+)/", 1).alias("place"), "page", F.char_length("docs").alias("n_chars"), F.md5("docs").alias("docs_md5"), "times_built")


@query
def list_text_files(spark, d):
    from ..sources.files import list_files

    base = _folder(spark)
    _text_folders(spark, d, base)
    found = [list_files(spark, f, "txt") for f in _folders_of(spark, base)]
    from functools import reduce

    return reduce(DataFrame.unionAll, found).select(F.regexp_extract("source", "place=([0-9a-f]+)/", 1).alias("place"), "length")


@query
def csv_rows(spark, d):
    """Two tables with different headers as CSV, read back row by row."""
    from ..sources.files import read_csv

    base, docs = _folder(spark), table(spark, d, "documents")
    for name, columns in (("a", ["doc_id", "lang", "title"]), ("b", ["title", "category", "n_chars"])):
        docs.select(*columns).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/{name}")
    return read_csv(spark, [f"{base}/a", f"{base}/b"]).groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


def _office(name: str, paragraph: str, run: str):
    """Column function: an office file whose one part holds the given lines."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    def build(a, b):
        out = []
        for lines in zip(a, b, strict=True):
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as z:
                z.writestr(name, '<x xmlns:n="n">' + "".join(f"<n:{paragraph}><n:{run}>{escape(t)}</n:{run}></n:{paragraph}>" for t in lines) + "</x>")
            out.append(held.getvalue())
        import pandas as pd

        return pd.Series(out)

    return F.pandas_udf(build, "binary")


def _office_texts(spark, d, extension: str, name: str):
    from ..sources.files import parse_files

    made = _office(name, "p", "t")(F.coalesce("source", F.lit("")), F.coalesce(F.trim("lang"), F.lit("")))
    content = F.when(F.col("doc_id") % 10 == 0, F.lit(b"broken")).otherwise(made)
    raw = table(spark, d, "documents").select(F.concat("doc_id", F.lit(f".{extension}")).alias("path"), F.current_timestamp().alias("modificationTime"), content.alias("content"))
    return parse_files(raw).select(F.split_part("source", F.lit("."), F.lit(1)).cast("bigint").alias("doc_id"), "page", F.md5("text").alias("text_md5"), F.col("error").isNotNull().alias("failed"))


@query
def docx_texts(spark, d):
    """Word files with two paragraphs, every tenth of them broken, read by their type."""
    return _office_texts(spark, d, "docx", "word/document.xml")


@query
def pptx_texts(spark, d):
    return _office_texts(spark, d, "pptx", "ppt/slides/slide1.xml")


@query
def info_texts(spark, d):
    """A folder, a file of it, a page and plain text as one source."""
    from ..sources.files import read_info

    base = _folder(spark)
    _text_folders(spark, d, base)
    folders = sorted(_folders_of(spark, base))
    rows = read_info(spark, [*folders, "", "plain words", "https://x.test/a"], lambda u: f"<title>t</title><p>{u}</p>")
    kind = F.when(F.col("source").isNull(), F.lit("text")).when(F.col("source").startswith("https"), F.lit("page")).otherwise(F.lit("file"))
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("n_chars"))


@query
def store_roundtrip(spark, d):
    """Two appends to a store, one collection rewritten without some rows, and what is read back."""
    base, rows = f"{_folder(spark)}/store", dbs(spark, d).where("collection is not null").select("ord", "ids", "docs", "collection")
    store.append(rows.where("ord % 2 = 0"), base)
    store.append(rows.where("ord % 2 = 1"), base)
    first = rows.agg(F.min("collection")).first()[0]
    gone = store.rewrite(spark, base, first, F.col("ord") % 3 != 0)
    return store.read_store(spark, base).select("collection", "ord", "ids", F.md5("docs").alias("docs_md5"), F.lit(gone).cast("bigint").alias("gone"))


@query
def directory_store(spark, d):
    """Chunks of two files of some collections, each id once."""
    from ..sources.load import load_store

    base = f"{_folder(spark)}/store"
    store.append(dbs(spark, d).where("collection is not null and ids is not null").select("ord", "ids", "source", "page", "collection"), base)
    names = [r[0] for r in spark.read.parquet(base).select("collection").distinct().orderBy("collection").limit(5).collect()]
    return load_store(spark, base, names, ["x/manual_0011.pdf", "report_0001.docx", ".\\manual_0003.docx"]).select("ids", "collection", "source")


@query
def add_chunks(spark, d):
    rows = dbs(spark, d).select("ord", "docs", F.when(F.col("ord") % 3 == 0, F.lit("a title")).alias("search_text"))
    return store.add_chunks(rows, _lengths).select("ord", F.round(F.element_at("embeds", 1), 1).cast("double").alias("n_chars"), F.round(F.element_at("embeds", 2), 1).cast("double").alias("n_words"))


def _lengths(texts: list[str]) -> list[list[float]]:
    """Stand-in embedder that SQL can follow: characters and words."""
    return [[float(len(t)), float(len(t.split()))] for t in texts]


@query
def embed_stub(spark, d):
    return table(spark, d, "questions").select("qid", embed(F.col("question"), _lengths).alias("v")).select("qid", F.element_at("v", 1).cast("double").alias("n_chars"), F.element_at("v", 2).cast("double").alias("n_words"))


@query
def memory_nearest(spark, d):
    turns = table(spark, d, "handle_table").select(F.col("run_id").alias("ord"), "prompt", "response", F.col("ts").alias("at"))
    asked = table(spark, d, "questions").where("qid % 50 = 0").select(F.col("qid").cast("bigint").alias("query_id"), embed(F.col("question"), _lengths).alias("vector"))
    return rag.search_memory(rag.memory_entries(turns, embedder=_lengths), asked, 3).select("query_id", "ord", "place")


@query
def questions_roundtrip(spark, d):
    from ..sources.sinks import read_questions, write_questions

    base = _folder(spark)
    write_questions(table(spark, d, "questions"), base)
    return read_questions(spark, base).select(F.col("qid").cast("int").alias("qid"), "question_style", "question_type", "question", F.array_join("choices", "|").alias("choices"), "answer")


@query
def logs_roundtrip(spark, d):
    from ..sources.sinks import write_logs

    base = _folder(spark)
    write_logs(table(spark, d, "handle_table").select("run_id", "model", "prompt", "response"), base)
    return spark.read.schema("run_id bigint, model string, prompt string, response string").json(base).select("run_id", "model", F.md5("prompt").alias("prompt_md5"), F.md5("response").alias("response_md5"))


@query
def saved_json(spark, d):
    """Objects in fences and prose, found, saved and read again."""
    from ..sources.sinks import save_json

    base = _folder(spark)
    object_ = F.to_json(F.struct("qid", "question", "answer"))
    texts = table(spark, d, "questions").select(F.when(F.col("qid") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), object_, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("So "), object_, F.lit(" is all."))).alias("text"))
    save_json(texts, "text", base)
    return spark.read.schema("qid int, question string, answer string").json(base)


@query
def experiment_metrics(spark, d):
    from ..sources.sinks import write_experiment

    base = _folder(spark)
    write_experiment(table(spark, d, "handle_table").select("run_id", "model", "lang", "bert", "rouge", "llm_score"), base, "first", ["model", "lang"], ["bert", "rouge", "llm_score"])
    metrics, params, runs = (spark.read.parquet(f"{base}/first/{x}") for x in ("metrics", "params", "table"))
    return metrics.select("key", F.round("value", 6).alias("value")).unionAll(params.groupBy("key").agg(F.count(F.lit(1)).cast("double"))).unionAll(runs.select(F.lit("runs"), F.count(F.lit(1)).cast("double")))


@query
def memory_markdown(spark, d):
    """Memory blocks as one markdown file for each category."""
    from ..sources.files import read_text
    from ..sources.sinks import append_memory, write_markdown

    base = _folder(spark)
    rows = table(spark, d, "handle_table").where("prompt is not null").select(F.concat(F.lit("group "), (F.col("run_id") % 5).cast("string")).alias("category"), F.lit("2025").alias("at"), "prompt", F.col("prompt").alias("text"))
    append_memory(rows, f"{base}/memory")
    files = write_markdown(spark, f"{base}/memory", f"{base}/md")
    pages = read_text(spark, files)
    return pages.select(F.regexp_extract("source", "([^/]*)[.]md$", 1).alias("file"), F.char_length("text").cast("bigint").alias("n_chars"))


@query
def web_search_stub(spark, d):
    from ..sources.sinks import ENGINES, search_web

    ENGINES["stub"] = lambda q, n: [(f"T{i}", f"https://x.test/{i}", f"{q} {i}") for i in range(n)]
    return search_web(spark, "stub", "tokens", 5)


@query
def url_refresh(spark, d):
    """Pages of all urls that are due, fetched again by a stand-in."""
    import html

    from ..sources.load import refresh_urls

    pages, rows = refresh_urls(table(spark, d, "ledger"), lambda u: f"<title>T</title><p>page of {html.escape(u)}</p>", F.lit(NOW).cast("timestamp"), 30)
    counted = rows.groupBy("collection").agg(F.count(F.lit(1)).alias("due"))
    return pages.join(counted, "collection").select("collection", "url", "title", F.md5("text").alias("text_md5"), "due")


# Injected models, tools and scores


@query
def rerank_reduce_stub(spark, d):
    near = R.lexical(_texts(spark, d), _text_queries(spark, d), 20, "bm25").select("query_id", "ord")
    pool = near.join(_texts(spark, d), "ord").join(_text_queries(spark, d).withColumnRenamed("text", "query"), "query_id")
    return R.rerank_reduce(pool, R.overlap_scorer, 5)


@query
def svm_threshold(spark, d):
    return R.svm_above(_vectors(spark, d), _vector_queries(spark, d), 20, 0.5).select("query_id", "ord", "rank")


@query
def bert_stub(spark, d):
    """An injected scorer: overlap of word sets in place of a language model's similarity."""

    def overlap(candidates, references):
        sets = [(set(a.lower().split()), set(b.lower().split())) for a, b in zip(candidates, references, strict=True)]
        return [2 * len(a & b) / ((len(a) + len(b)) or 1) for a, b in sets]

    return table(spark, d, "handle_table").select("run_id", E.bert_score(F.col("response"), F.col("prompt"), overlap).alias("f1"))


@query
def toxicity_stub(spark, d):
    label = F.when(F.col("run_id") % 3 == 0, F.lit("Toxic")).otherwise(F.lit("neutral"))
    return table(spark, d, "handle_table").select("run_id", F.round(E.toxicity(label, F.pmod(F.col("run_id"), F.lit(10)) / 10), 6).alias("toxicity"))


@query
def evaluation_scores(spark, d):
    """Every question answered and scored by stand-ins, without ROUGE-L, which SQL can't follow."""
    contexts = table(spark, d, "handle_table").where("qid is not null").groupBy("qid").agg(F.min(F.array_join("inputs", " ")).alias("context"))
    scored = E.evaluate(table(spark, d, "questions"), contexts, lambda p: p.split("\n")[-1], lambda p: f"{min(1.0, len(p) / 1000):.3f}")
    return scored.select("qid", F.md5("response").alias("response_md5"), "llm_score", "hit")


@query
def translate_stub(spark, d):
    from ..operators.models import translate

    return table(spark, d, "questions").select("qid", translate(F.col("question"), "German", lambda p: p.split("Text: ", 1)[1].upper() if p.isascii() else p.split("Text: ", 1)[1]).alias("translated"))


@query
def json_call_stub(spark, d):
    from ..operators.models import to_json_object

    reply = lambda p: 'Sure: {"length": ' + str(len(p.split("Text: ", 1)[1])) + "} as asked"
    return table(spark, d, "questions").select("qid", F.get_json_object(to_json_object(F.coalesce("question", F.lit("")), ["length"], reply), "$.length").cast("int").alias("length"))


@query
def relevant_stub(spark, d):
    rows = table(spark, d, "handle_table").select("run_id", "prompt", "response").where("response is not null")
    return rag.relevant_answers(rows, "response", F.col("prompt"), lambda p: "Yes." if "chunk" in p.split("Answer: ", 1)[1].split("\n\nQuestion: ")[0] else "no").select("run_id")


@query
def tool_functions(spark, d):
    """A Python function as a tool, called from SQL."""
    from ..operators.models import tool

    def framed(text: str) -> str:
        return None if text is None else f"<{text}>"

    made = tool(framed, "puts a text in marks")
    made.register(spark)
    table(spark, d, "questions").createOrReplaceTempView("tool_questions")
    return spark.sql("SELECT qid, framed(question) AS framed FROM tool_questions").withColumn("explained", F.lit(made.explained()))


@query
def tool_results(spark, d):
    block = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    q = F.col("question")
    blocks = F.when(F.col("qid") % 3 == 0, F.array(block(q))).when(F.col("qid") % 3 == 1, F.array(block(F.concat(F.lit('{ "n" :  '), F.col("qid").cast("string"), F.lit("}"))))).otherwise(F.array(block(F.lit("a")), block(F.lit("b"))))
    return table(spark, d, "questions").select("qid", X.tool_result(blocks).alias("result"))


@query
def essay_notes(spark, d):
    q = table(spark, d, "questions")
    language = F.when(F.col("qid") % 2 == 0, F.lit("ch")).otherwise(F.lit("en"))
    return q.select("qid", prompts.with_essay_note(F.lit("Be brief."), F.col("question_style"), language).alias("system"))


@query
def json_rows(spark, d):
    return table(spark, d, "handle_table").select("run_id", X.json_safe(F.struct("run_id", "qid", "model", "prompt")).alias("row"))


@query
def character_map(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.map_characters(F.col("text"), "后国问题检", "後國問題檢")).alias("text_md5"))


@query
def han_token_counts(spark, d):
    from ..functions import counters

    return table(spark, d, "documents").select("doc_id", counters.han_words(F.col("text")).alias("n_tokens"), counters.characters(F.col("text")).alias("n_chars"))


@query
def budget_prefix_characters(spark, d):
    from ..functions import counters

    return W.prefix_within(table(spark, d, "documents").where("source is not null"), "source", ["doc_id"], counters.characters(F.col("text")), 9000).select("source", "doc_id", "total")


@query
def filter_none(spark, d):
    return FL.by_metadata(dbs(spark, d), "NO_FILTER", FIELDS).select("ord", F.size("matched_fields").alias("n_matched"))


@query
def filter_parser(spark, d):
    """A filter in another language, read by an injected parser: ``attribute op value`` joined by ``&``."""

    def parser(text: str):
        ops = {"=": "eq", ">": "gt", "<": "lt"}
        return FL.Node("and", tuple(FL.Leaf(ops[op], name, value) for name, op, value in (x.split() for x in text.split("&"))))

    return FL.by_metadata(dbs(spark, d), "chunk_size > 500 & title = notes", FIELDS, parser=parser).select("ord")


# Relational smoke


@query
def lineitem_flags(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query
def orders_by_nation(spark, d):
    orders, customer, nation = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"))
