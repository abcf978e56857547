"""Aggregations over chunk, run and question tables. All aggregate partially before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, is_blank, parent


def first_by_text(chunks: DataFrame, text: str = "docs", order: str = "ord") -> DataFrame:
    """One row for each distinct text, the first by ``order``; null texts count as one text.

    min_by aggregates partially, so a text that a third of all rows share is no hot window.
    """
    others = F.struct(*[F.col(c) for c in chunks.columns])
    return chunks.groupBy(F.col(text).alias("_text")).agg(F.min_by(others, F.col(order)).alias("r")).select("r.*")


def reference_texts(chunks: DataFrame, text: str = "docs") -> DataFrame:
    """Text of each reference, joined in order: by (source, page) of the metadata, else by (url, title); rows with neither are dropped."""
    m = lambda k: F.try_element_at("metadatas", F.lit(k))
    by_file = m("source").isNotNull() & m("page").isNotNull()
    keyed = chunks.select(F.when(by_file, m("source")).otherwise(m("url")).alias("ref"), F.when(by_file, m("page")).otherwise(m("title")).alias("part"), "ord", F.coalesce(F.col(text), F.lit("")).alias("t"))
    parts = F.sort_array(F.collect_list(F.struct("ord", "t")))
    return keyed.where("ref is not null and part is not null").groupBy("ref", "part").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"), F.count(F.lit(1)).alias("n_chunks"))


def pages_by_file(chunks: DataFrame) -> DataFrame:
    """Sorted pages of each source file."""
    return chunks.where("page is not null and source is not null").groupBy("source").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def files_by_parent(chunks: DataFrame) -> DataFrame:
    """Distinct files of each directory and their number."""
    files = chunks.where(F.col("source").isNotNull() & ~F.col("source").rlike("^https?://")).select(parent(F.col("source")).alias("parent"), basename(F.col("source")).alias("file")).distinct()
    return files.groupBy("parent").agg(F.count(F.lit(1)).alias("n_files"), F.min("file").alias("first_file"), F.max("file").alias("last_file"))


def same_category(items: DataFrame, category: str, noun: str, order: str, threshold: int) -> DataFrame:
    """Categories with at least ``threshold`` distinct nouns: their number, first place and the nouns in order."""
    distinct = items.where(F.col(category).isNotNull() & F.col(noun).isNotNull()).groupBy(category, noun).agg(F.min(order).alias("at"))
    nouns = F.transform(F.sort_array(F.collect_list(F.struct("at", noun))), lambda x: x[noun])
    return distinct.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), nouns.alias("nouns")).where(F.col("n") >= threshold)


def source_phrase(chunks: DataFrame, by: str, prefix: str) -> DataFrame:
    """Distinct file names without their extensions, sorted and joined by ``、`` behind a prefix."""
    name = F.split_part(basename(F.col("source")), F.lit("."), F.lit(1))
    return chunks.where("source is not null").groupBy(by).agg(F.concat(F.lit(prefix), F.array_join(F.sort_array(F.collect_set(name)), "、")).alias("phrase"))


def mean_scores(runs: DataFrame, by: str, scores: list[str], places: int = 3) -> DataFrame:
    """Mean of each score by group, rounded; null and NaN scores take no part."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(clean(c)), places).alias(c) for c in scores])


def hit(response: Column, answer: Column) -> Column:
    """1.0 if the response's text contains the answer without its spaces, else 0.0; null answers hit nothing."""
    return F.coalesce(response.contains(F.replace(answer, F.lit(" "), F.lit(""))), F.lit(False)).cast("double")


def min_max(ranked: DataFrame, by: str, score: str) -> DataFrame:
    """``score`` scaled to [0, 1] within each query, as (s - min) / (max - min + 1e-6).

    The bounds are aggregated and joined back: a window would put a whole query's rows in one task.
    """
    bounds = ranked.groupBy(by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    return ranked.join(bounds, by).withColumn("score_norm", (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-6))).drop("_lo", "_hi")


def non_blank(chunks: DataFrame, text: str = "docs") -> DataFrame:
    return chunks.where(~is_blank(F.col(text)))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``; partial aggregation, no window over a hot key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")


def top_by(ranked: DataFrame, by: str, k: int, score: str = "score", tie: str = "ord") -> DataFrame:
    """The k best rows of each group; WindowGroupLimit cuts each partition to k rows before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(tie))
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
