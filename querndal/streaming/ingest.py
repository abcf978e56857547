"""Incremental ingestion with Structured Streaming: build what is new or changed, replace what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import latest
from ..sources import ledger as L


def ingest_batch(batch: DataFrame, batch_id: int, store: str, ledger: str) -> None:
    """Apply one micro-batch of ``(collection, item, mtime, text)``: of each item its newest version, unless the ledger has that time or a later one already.

    Store and ledger are written as versions by batch: running a batch again after a failure overwrites its own folder, so each row counts once.
    """
    spark = batch.sparkSession
    newest = latest(batch.where("item is not null"), ["collection", "item"], [F.struct(F.col("mtime").isNotNull(), F.col("mtime")), F.col("text")])
    known = _read(spark, ledger, batch_id, "collection string, item string, mtime double, batch bigint")
    built = latest(known, ["collection", "item"], [F.col("batch")])
    times = built.select("collection", "item", F.col("mtime").alias("built"))
    late = F.coalesce(F.col("mtime") < F.col("built"), F.col("mtime").isNull() & F.col("built").isNotNull())
    todo = L.file_status(newest, built.select("collection", "item", "mtime")).where(F.col("status") != L.ALREADY_BUILT).join(times, ["collection", "item"], "left").where(~late).persist()
    todo.select("collection", "item", "text").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
    todo.select("collection", "item", "mtime").write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")
    todo.unpersist()


def _read(spark: SparkSession, path: str, before: int, schema: str) -> DataFrame:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):  # nothing written yet; any other failure is one
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch") < before)


def stream_files(items: DataFrame, store: str, ledger: str, checkpoint: str):
    """Start ingesting a stream of ``(collection, item, mtime, text)``; runs until the input is used up."""
    return items.writeStream.foreachBatch(lambda df, i: ingest_batch(df, i, store, ledger)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_store(spark: SparkSession, store: str) -> DataFrame:
    """The newest text of each item: later batches replace earlier ones."""
    return latest(spark.read.option("basePath", store).parquet(store), ["collection", "item"], [F.col("batch"), F.col("text")]).select("collection", "item", "text", "batch")


def stale_urls(ledger: DataFrame, watermark: str, days: int) -> DataFrame:
    """Each url once in each window of ``days`` in which it was fetched, over a stream of ledger rows with late ones up to ``watermark``: ``(start, item)``.

    A pair is given when it is first seen, so no window waits for the watermark, which only bounds the state.
    """
    w = F.window("fetched_at", f"{days} days").alias("window")
    return ledger.withWatermark("fetched_at", watermark).select(w, "item").dropDuplicates(["window", "item"]).select(F.col("window.start").alias("start"), "item")


def window_counts(pairs: DataFrame) -> DataFrame:
    """``(start, urls)`` of what ``stale_urls`` has written."""
    return pairs.groupBy("start").agg(F.count("item").alias("urls"))


def stream_memory(turns: DataFrame, memory: str, checkpoint: str, categorise="stub:first_sentence", embedder="stub:hash"):
    """Start appending a stream of ``(ord, prompt, response, at)`` to the memory; each batch can be searched as soon as it is written.

    A batch that runs again after a failure overwrites its own folder.
    """
    from ..operators.rag import memory_entries

    def add(batch: DataFrame, batch_id: int) -> None:
        memory_entries(batch, categorise, embedder).write.mode("overwrite").parquet(f"{memory}/batch={batch_id}")

    return turns.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_memory(spark: SparkSession, memory: str) -> DataFrame:
    """All entries that a stream has written, with their batch."""
    return spark.read.option("basePath", memory).parquet(memory)


def init_memory(spark: SparkSession, memory: str) -> DataFrame:
    """The memory at a place; a new one begins with a greeting."""
    from ..operators.rag import memory_entries
    from ..runtime import path_kind

    if not path_kind(spark, memory):
        hello = spark.createDataFrame([(0, "Hello", "Hello, this is your memory.", None)], "ord bigint, prompt string, response string, at timestamp")
        memory_entries(hello).write.parquet(f"{memory}/batch=-1")
    return read_memory(spark, memory)


def show_memory(memory: DataFrame, n: int = 100) -> DataFrame:
    """The first n texts."""
    return memory.orderBy("batch", "ord").select("ord", "text").limit(n)
