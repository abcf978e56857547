"""Session helpers shared by every operator: tables, lineage cuts and size checks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily scan one test table; column pruning and filters reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_kind(spark: SparkSession, path: str) -> str | None:
    """``dir``, ``file`` or None for a path of any file system that Spark knows."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return None
    return "dir" if fs.getFileStatus(place).isDirectory() else "file"


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder with all it holds; False if there is none."""
    fs, place = _place(spark, path)
    return bool(fs.exists(place) and fs.delete(place, True))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share.

    ``spark.checkpoint.dir`` is what the cluster names. Only where it is unset on a local master, as in tests,
    a folder of this machine is set on the session; a cluster without it raises ValueError.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="querndal-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs no more than a re-read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, max_rows: int, what: str) -> DataFrame:
    """``df`` if it has at most ``max_rows`` rows, else ValueError: the proof needed before it goes to the driver."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows")
    return df


def parallel(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input of few partitions over the session's task slots before heavy per-row work; no-op where half of them are busy anyway."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() > n:
        return df
    return df.repartition(n, *[F.col(k) for k in keys]) if keys else df.repartition(n)


def default_tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; ``QUERNDAL_TOKENIZERS`` overrides the installed package."""
    base = os.environ.get("QUERNDAL_TOKENIZERS")
    if not base:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            base = "/opt/tokenizers"
    return os.path.join(base, name)
