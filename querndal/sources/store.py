"""The chunk store: Parquet, one directory a collection."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..operators.models import embed
from ..runtime import cut, path_kind, remove_path


def read_store(spark: SparkSession, path: str, collections: list[str] | None = None) -> DataFrame:
    """Chunks of all or some collections; the partition filter prunes directories."""
    df = spark.read.parquet(path)
    return df if collections is None else df.where(F.col("collection").isin(collections))


def append(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").partitionBy("collection").parquet(path)


def rewrite(spark: SparkSession, path: str, collection: str, keep) -> int:
    """Keep only the rows of a collection for which ``keep`` holds; returns how many went. Rewrites that one partition by way of a side path of its own."""
    kept = read_store(spark, path, [collection]).select("*", F.coalesce(keep, F.lit(False)).alias("_keep"))
    before, stay = kept.agg(F.count(F.lit(1)), F.count_if("_keep")).first()
    if not stay:
        drop_collection(spark, path, collection)
    elif stay < before:
        _exchange(spark, path, kept.where("_keep").drop("_keep"))
    return before - stay


def _exchange(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Replace the partitions of all collections in ``rows``, which may read them."""
    side = f"{path.rstrip('/')}__{uuid.uuid4().hex}"
    rows.write.partitionBy("collection").parquet(side)
    try:
        spark.read.schema(rows.schema).parquet(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)
    finally:
        remove_path(spark, side)


def replace_items(spark: SparkSession, path: str, gone: DataFrame, chunks: DataFrame) -> None:
    """Put ``chunks`` into the store in place of the rows of all items ``gone(collection, source)``. Only collections that lose rows are rewritten."""
    if path_kind(spark, path):
        old = spark.read.schema(chunks.schema).parquet(path)
        hit = old.join(gone, ["collection", "source"], "left_semi").select("collection").distinct()
        if touched := [r[0] for r in hit.collect()]:
            kept = old.where(F.col("collection").isin(touched)).join(gone, ["collection", "source"], "left_anti").select(*chunks.columns)
            new = cut(kept.unionByName(chunks.where(F.col("collection").isin(touched))))
            stay = {r[0] for r in new.select("collection").distinct().collect()}
            _exchange(spark, path, new)
            for c in set(touched) - stay:  # nothing takes the place of these
                drop_collection(spark, path, c)
            chunks = chunks.where(~F.col("collection").isin(touched))
    append(chunks, path)


def drop_collection(spark: SparkSession, path: str, collection: str) -> int:
    """Delete a collection's directory; 1 if there was one, else 0."""
    escaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(collection)
    return int(remove_path(spark, f"{path.rstrip('/')}/collection={escaped}"))


def merge(a: DataFrame, b: DataFrame, key: str = "ids", order: str = "ord") -> DataFrame:
    """All rows of a, and of b the first row of each key that a lacks (null is a key as any other)."""
    fresh = b.join(a.select(F.col(key).alias("_key")).distinct(), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    first = fresh.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*[F.col(c) for c in b.columns]), F.col(order)).alias("r")).select("r.*")
    return a.unionByName(first)


def add_chunks(chunks: DataFrame, embedder: str | Callable = "stub:hash") -> DataFrame:
    """New chunks with vectors: of ``search_text`` where it is given, else of ``docs``; rows without a text are skipped."""
    return chunks.where("docs is not null").withColumn("embeds", embed(F.coalesce("search_text", "docs"), embedder)).drop("search_text")


def update_metadata(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Metadata replaced by those of ``changes(ids, metadatas)`` for ids that both hold; of several changes of an id the greatest text form wins."""
    one = changes.where("ids is not null").groupBy("ids").agg(F.max_by("metadatas", F.to_json("metadatas")).alias("_new"))
    return chunks.join(one, "ids", "left").withColumn("metadatas", F.coalesce("_new", "metadatas")).drop("_new")


def delete_files(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose file name is not among ``gone(file)``."""
    return chunks.withColumn("_file", basename(F.col("source"))).join(gone.select(F.col("file").alias("_file")), "_file", "left_anti").drop("_file")


def delete_collection(chunks: DataFrame, collection: str) -> DataFrame:
    return chunks.where(~F.col("collection").eqNullSafe(F.lit(collection)))
