"""The ingestion ledger: which item of a collection was built at what time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import latest

NOT_BUILT, OLD_BUILT, ALREADY_BUILT = "NOT_BUILT", "OLD_BUILT", "ALREADY_BUILT"


def current(ledger: DataFrame) -> DataFrame:
    """One row for each collection and item: the one written last; of equal times the one with the greatest values."""
    rows = ledger.where("item is not null")
    nulls_low = [F.struct(F.col(c).isNotNull(), F.col(c)) for c in ("written_at", "mtime", "fetched_at", "kind")]
    return latest(rows.select("collection", "item", "kind", "mtime", "fetched_at", "written_at"), ["collection", "item"], nulls_low)


def upsert(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    return current(ledger.unionByName(rows))


def file_status(files: DataFrame, built: DataFrame) -> DataFrame:
    """Status of each file ``(collection, item, mtime)`` against the ledger, by equality of times."""
    known = built.select("collection", "item", F.col("mtime").alias("_built"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), NOT_BUILT).when(F.col("mtime").eqNullSafe(F.col("_built")), ALREADY_BUILT).otherwise(OLD_BUILT)
    return files.join(known, ["collection", "item"], "left").withColumn("status", status).drop("_built", "_known")


def url_status(urls: DataFrame, built: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Status of each url: old if it was fetched more than ``days`` days before ``now`` or at an unknown time."""
    known = built.select("collection", "item", F.col("fetched_at").alias("_at"), F.lit(True).alias("_known"))
    fresh = F.coalesce(F.col("_at") + F.make_interval(days=F.lit(days)) >= now, F.lit(False))
    return urls.join(known, ["collection", "item"], "left").withColumn("status", F.when(F.col("_known").isNull(), NOT_BUILT).when(fresh, ALREADY_BUILT).otherwise(OLD_BUILT)).drop("_at", "_known")
