"""Command line, for ``spark-submit querndal/cli.py COMMAND ...`` or ``python -m querndal.cli``.

    ingest --store S --ledger L INPUT...           build files, folders and urls into a store
    search --store S [--type T] [--k N] QUESTION   chunks found for a question
    ask    --store S [--model M] QUESTION          answer from what is found
    keep   --store S [--model M]                   answer questions from standard input until an empty line
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querndal import log
from querndal.operators import rag
from querndal.operators.models import embed
from querndal.sources.load import load_store, process_db


def chunks_of(store: DataFrame) -> DataFrame:
    """Chunks as retrievers take them, numbered by their id."""
    return store.select(F.xxhash64("ids").alias("ord"), F.col("docs").alias("text"), F.col("embeds").alias("vector"))


def asked(spark: SparkSession, question: str, embedder: str) -> DataFrame:
    return spark.createDataFrame([(0, question)], "query_id bigint, text string").withColumn("vector", embed(F.col("text"), embedder))


def keep_asking(spark: SparkSession, chunks: DataFrame, questions: Iterable[str], model: str | Callable, embedder: str = "stub:hash", **options) -> Iterator[str]:
    """Answers to questions one after another over chunks that are read once; ends at the first blank question."""
    held = chunks.persist()
    try:
        for q in questions:
            if not q.strip():
                return
            yield rag.rag(held, asked(spark, q.strip(), embedder), model, **options).first()["answer"]
    finally:
        held.unpersist()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="querndal", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "search", "ask", "keep"):
        c = commands.add_parser(name)
        c.add_argument("--store", required=True)
        c.add_argument("--embedder", default="stub:hash")
        c.add_argument("--log-level", default="WARNING")
        if name == "ingest":
            c.add_argument("--ledger", required=True)
            c.add_argument("--chunk-size", type=int, default=1000)
            c.add_argument("inputs", nargs="+")
        else:
            c.add_argument("--type", default="auto")
            c.add_argument("--k", type=int, default=20)
            c.add_argument("--budget", type=int, default=3000)
            c.add_argument("--model", default="stub:first_sentence")
        if name in ("search", "ask"):
            c.add_argument("question")
    a = parser.parse_args(argv)
    logger = log.configure(a.log_level)
    spark = spark or SparkSession.builder.appName("querndal").getOrCreate()
    if a.command == "ingest":
        chunks, ignored = process_db(spark, a.inputs, a.store, a.ledger, a.chunk_size, embedder=a.embedder)
        for r in ignored.toLocalIterator():
            logger.warning("ignored %s: %s", r["source"], r["error"])
        print(f"{chunks.count()} chunks")
        return 0
    options = {"search_type": a.type, "k": a.k, "budget": a.budget}
    chunks = chunks_of(load_store(spark, a.store))
    if a.command == "search":
        for r in rag.search(chunks, asked(spark, a.question, a.embedder), **options).orderBy("place").toLocalIterator():
            print(f"{r['place']}. {r['text']}")
    elif a.command == "ask":
        print(rag.rag(chunks, asked(spark, a.question, a.embedder), a.model, **options).first()["answer"])
    else:
        for answer in keep_asking(spark, chunks, sys.stdin, a.model, a.embedder, **options):
            print(answer, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
