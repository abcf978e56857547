"""The main source: files, folders and pages into the chunk store, building only what the ledger doesn't have."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, is_blank, parent, storage_name
from ..operators.chunking import chunk_documents
from ..runtime import cut, path_kind
from . import ledger as L
from . import store as S
from .files import KNOWN, parse_files, raw_files, read_urls

LEDGER = "collection string, item string, kind string, mtime double, fetched_at timestamp, written_at timestamp"
CHUNKS = "ids string, docs string, embeds array<float>, source string, page int, metadatas map<string,string>, created_at timestamp, collection string"


def collection_of(place: Column, chunk_size: int, embedder: str) -> Column:
    kind, _, name = embedder.partition(":")
    return storage_name(F.regexp_replace(place, "^file:/*", "/"), F.lit(chunk_size), F.lit(kind), F.lit(name))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_kind(spark, path) else spark.createDataFrame([], schema)


def ingest(documents: DataFrame, chunk_size: int = 1000, overlap: int = 100, embedder: str | Callable = "stub:hash") -> DataFrame:
    """Chunks with vectors of ``(collection, source, page, title, text)``: split, embedded and named by the hash of source, page, place and text.

    ``title`` is null for files, whose metadata hold source and page; pages of the web have title and url. Documents without any text give nothing.
    """
    keyed = documents.where(~is_blank(F.col("text"))).select(F.struct("collection", "source", "page", "title").alias("doc"), "text")
    pieces = chunk_documents(keyed, "doc", "text", chunk_size, overlap).select("doc.*", "chunk_no", "chunk")
    sizes = {"chunk_size": F.lit(str(chunk_size)), "chunk_overlap": F.lit(str(overlap))}
    of_file = {"source": F.col("source"), "page": F.col("page").cast("string"), **sizes}
    of_page = {"url": F.col("source"), "title": F.col("title"), **sizes}
    as_map = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])
    rows = pieces.select(
        F.md5(F.concat_ws("|", "source", "page", "chunk_no", "chunk")).alias("ids"),
        F.col("chunk").alias("docs"),
        F.lit(None).cast("string").alias("search_text"),
        "source",
        "page",
        F.when(F.col("title").isNull(), as_map(of_file)).otherwise(as_map(of_page)).alias("metadatas"),
        F.current_timestamp().alias("created_at"),
        "collection",
    )
    return S.add_chunks(rows, embedder).select(*[x.split()[0] for x in CHUNKS.split(", ")])


def process_db(
    spark: SparkSession, inputs: list[str], store: str, ledger: str, chunk_size: int = 1000, overlap: int = 100, embedder: str = "stub:hash", fetch: Callable[[str], str | None] | None = None, now: Column | None = None, days: int = 30
) -> tuple[DataFrame, DataFrame]:
    """``(chunks, ignored)`` of folders, files and urls: new and changed items are built, then all their collections are loaded, each id once.

    A folder is a collection, files belong to that of their folder, a url is one of its own. Files are built anew when their time of change
    differs from the ledger's, pages after ``days`` days; what was built of them before is replaced. ``ignored``: ``(source, error)`` of paths that don't
    exist and documents without readable text.
    """
    now = F.current_timestamp() if now is None else now
    urls = [x for x in inputs if re.match("^https?://", x)]
    kinds = {x: path_kind(spark, x) for x in inputs if x not in urls}
    folders, files = ([x for x, k in kinds.items() if k == kind] for kind in ("dir", "file"))
    raw = ([raw_files(spark, folders, KNOWN)] if folders else []) + ([raw_files(spark, files)] if files else [])
    ignored = [spark.createDataFrame([(x, "no such path") for x, k in kinds.items() if k is None], "source string, error string")]
    built = cut(L.current(_read(spark, ledger, LEDGER)))
    documents, items = [], []
    if raw:
        found = reduce(DataFrame.unionAll, raw)
        listed = found.select(collection_of(parent(F.col("path")), chunk_size, embedder).alias("collection"), F.col("path").alias("item"), F.col("modificationTime").cast("double").alias("mtime")).distinct()
        todo = L.file_status(listed, built).where(F.col("status") != L.ALREADY_BUILT)
        # Which files are parsed is settled before; a file named twice is read once.
        due = found.join(todo.select(F.col("item").alias("path")), "path", "left_semi")
        if folders and files:
            due = due.dropDuplicates(["path"])
        documents.append(parse_files(due).select(collection_of(parent(F.col("source")), chunk_size, embedder).alias("collection"), "source", "page", F.lit(None).cast("string").alias("title"), "text", "error"))
        items.append(todo.select("collection", "item", F.lit("file").alias("kind"), "mtime", F.lit(None).cast("timestamp").alias("fetched_at")))
    if urls:
        asked = spark.createDataFrame([(u,) for u in dict.fromkeys(urls)], "item string").withColumn("collection", collection_of(F.col("item"), chunk_size, embedder))
        todo = L.url_status(asked, built, now, days).where(F.col("status") != L.ALREADY_BUILT)
        pages = read_urls(todo.select(F.col("item").alias("url")), fetch or (lambda url: None))
        documents.append(pages.select(collection_of(F.col("url"), chunk_size, embedder).alias("collection"), F.col("url").alias("source"), F.lit(0).alias("page"), "title", "text", F.lit(None).cast("string").alias("error")))
        items.append(todo.select("collection", "item", F.lit("url").alias("kind"), F.lit(None).cast("double").alias("mtime"), now.alias("fetched_at")))
    collections = [r[0] for r in spark.createDataFrame([(u,) for u in urls] + [(x if k == "dir" else x.rpartition("/")[0],) for x, k in kinds.items() if k], "place string").select(collection_of(F.rtrim(F.col("place"), F.lit("/")), chunk_size, embedder)).distinct().collect()]
    if documents:
        read, changed = cut(reduce(DataFrame.unionByName, documents)), cut(reduce(DataFrame.unionByName, items))
        blank = is_blank(F.col("text"))
        ignored.append(read.where(F.col("error").isNotNull() | blank).select("source", F.coalesce("error", F.lit("no text")).alias("error")))
        S.replace_items(spark, store, changed.select("collection", F.col("item").alias("source")), ingest(read.where(~blank), chunk_size, overlap, embedder))
        changed.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(ledger)
    return load_store(spark, store, collections), reduce(DataFrame.unionByName, ignored)


def load_store(spark: SparkSession, store: str, collections: list[str] | None = None, files: list[str] | None = None) -> DataFrame:
    """Chunks of some collections (whose folders alone are read), of some files if named, each id once; ValueError if there is no such store."""
    if not path_kind(spark, store):
        raise ValueError(f"no store at {store}")
    rows = S.read_store(spark, store, collections)
    if files is not None:
        rows = rows.where(basename(F.col("source")).isin([re.split(r"[/\\\\]", f)[-1] for f in files]))
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy("ids").agg(F.min_by(whole, F.struct("collection", "source", "page")).alias("r")).select("r.*")


def refresh_urls(ledger: DataFrame, fetch: Callable[[str], str | None], now: Column, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """``(pages, rows)``: the pages of all urls of a ledger that are due, fetched again as ``(collection, url, title, text)``, and their new ledger rows."""
    current = L.current(ledger.where("kind = 'url'"))
    due = L.url_status(current.select("collection", "item"), current, now, days).where(F.col("status") == L.OLD_BUILT).select("collection", "item")
    pages = read_urls(due.select(F.col("item").alias("url")).distinct(), fetch).join(due.withColumnRenamed("item", "url"), "url")
    rows = due.select("collection", "item", F.lit("url").alias("kind"), F.lit(None).cast("double").alias("mtime"), now.alias("fetched_at"), now.alias("written_at"))
    return pages.select("collection", "url", "title", "text"), rows
