"""Queries pN_ over the project's tables, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import default_tokenizer_file, parallel, table
from .corpus_encoding import encode_corpus
from .leakage import leaked_items
from .near_dup import near_duplicate_pairs
from .pair_defects import broken_pairs
from .sentences import split_sentences
from .similar_vectors import similar_pairs
from .site_lines import repeated_lines, strip_repeated_lines
from .splitting import BALANCED, digits_or, split_oversized


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    dbs = parallel(table(spark, sf_dir, "dbs").select("ord", "docs"))
    return near_duplicate_pairs(dbs, "ord", "docs", threshold=0.6, width=5, min_tokens=20).toDF("ord_a", "ord_b")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(parallel(table(spark, sf_dir, "handle_table").select("run_id", "prompt", "response")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(parallel(table(spark, sf_dir, "dbs").select("ord", "docs", "metadatas")))


def p3_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    dbs = parallel(table(spark, sf_dir, "dbs").select("ord", "docs", "metadatas"))
    return strip_repeated_lines(dbs, repeated_lines(dbs))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record without the lines of frequent clusters of near-duplicate lines of its site."""
    dbs = parallel(table(spark, sf_dir, "dbs").select("ord", "docs", "metadatas"))
    return strip_repeated_lines(dbs, repeated_lines(dbs, exact=False))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    dbs = parallel(table(spark, sf_dir, "dbs").select("ord", "docs", "metadatas"))
    size, overlap = (F.try_element_at("metadatas", F.lit(k)) for k in ("chunk_size", "chunk_overlap"))
    return split_oversized(dbs, "ord", "docs", digits_or(size, 1000, 1), digits_or(overlap, 100, 0))


def p4_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pieces when the whole text's penalties and imbalance are minimised together."""
    dbs = parallel(table(spark, sf_dir, "dbs").select("ord", "docs", "metadatas"))
    size, overlap = (F.try_element_at("metadatas", F.lit(k)) for k in ("chunk_size", "chunk_overlap"))
    return split_oversized(dbs, "ord", "docs", digits_or(size, 1000, 1), digits_or(overlap, 100, 0), BALANCED)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    dbs = parallel(table(spark, sf_dir, "dbs").select("ord", "embeds"))
    return similar_pairs(dbs, "ord", "embeds", dim=64, k=5, min_cosine=0.9).toDF("ord_a", "ord_b")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parallel(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return encode_corpus(docs, "doc_id", "text", default_tokenizer_file("byte_bpe_50k.json"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parallel(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leaked_items(docs, table(spark, sf_dir, "benchmark"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(parallel(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_stripped, p3_clusters, p4_found, p4_balanced, p5_found, p6_ids, p7_found, p8_found)}
