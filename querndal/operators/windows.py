"""Ordered operators: prefix budgets, history windows, document windows, batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..runtime import cut


def _running(rows: DataFrame, by: str, order: list, size: Column) -> tuple[DataFrame, DataFrame]:
    """Rows in order with their ``_size``, ``_task`` and place ``_at``, and for each group and task the total of the tasks before: ``(_by, _t, _ahead)``.

    Rows are sorted by range over the whole table, so a group spreads over as many tasks as its size asks for. What
    adds up along a group is one row for each of its tasks.
    """
    ranged = rows.withColumn("_size", size).repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    ranged = cut(ranged.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(by, "_task").agg(F.sum("_size").alias("_s")).withColumn("_ahead", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    return ranged, totals.select(F.col(by).alias("_by"), F.col("_task").alias("_t"), "_ahead")


def _added_up(ranged: DataFrame, totals: DataFrame, by: str, name: str) -> DataFrame:
    """The rows of the groups and tasks in ``totals``, with the total of sizes up to and with each."""
    w = Window.partitionBy(by, "_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(totals, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_task") == F.col("_t")))
    return joined.withColumn(name, F.sum("_size").over(w) + F.col("_ahead")).drop("_size", "_task", "_at", "_by", "_t", "_ahead")


def placed(rows: DataFrame, by: str, order: list) -> DataFrame:
    """Rows with their place ``_n`` within the group, from 0; no group meets in one task."""
    return _added_up(*_running(rows, by, order, F.lit(1)), by, "_n").withColumn("_n", F.col("_n") - 1)


def prefix_within(rows: DataFrame, by: str, order: list, size: Column, budget: int) -> DataFrame:
    """The first rows of each group whose sizes together stay within the budget (sizes are never negative).

    Totals add up within stretches of a group that the tasks hold, on top of the totals of the stretches before, so no group meets in one task.
    """
    ranged, totals = _running(rows, by, order, size)
    return _added_up(ranged, totals.where(F.col("_ahead") <= budget), by, "total").where(F.col("total") <= budget)


def short_prefix(rows: DataFrame, by: str, order: list, size: Column, budget: int) -> DataFrame:
    """``prefix_within`` for groups that are short by construction: one window."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("total", F.sum(size).over(w)).where(F.col("total") <= budget)


def history_window(turns: DataFrame, pairs: int = 10, budget: int = 1500, size: Callable[[Column], Column] = word_count) -> DataFrame:
    """The newest question and answer pairs of each conversation, as one text: ``(conv_id, history, n_tokens)``.

    Turns are ordered by turn, then time; equal turns keep the latest row. Pairs are taken from the end in steps of two, a pair being
    (User, Assistant) in any case; other steps are skipped. Stops after ``pairs`` or at the first text over the budget; the answer alone stays if its
    question is too long. Without a full pair the text is empty. A token is what ``size`` counts.
    """
    once = turns.groupBy("conv_id", "turn").agg(F.max_by(F.struct("role", "content"), F.struct("sent_at", "role", "content")).alias("t"))
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    back = once.select("conv_id", "turn", F.lower("t.role").alias("role"), F.coalesce("t.content", F.lit("")).alias("content"))
    back = back.withColumns({"n": F.row_number().over(w), "asked": F.lead("content").over(w), "asker": F.lead("role").over(w)})
    pair = back.where((F.col("n") % 2 == 1) & (F.col("role") == "assistant") & (F.col("asker") == "user")).select(
        "conv_id", "n", F.concat(F.lit("Assistant: "), "content").alias("a"), F.concat(F.lit("User: "), "asked").alias("q")
    )
    pair = pair.withColumn("pair", F.row_number().over(Window.partitionBy("conv_id").orderBy("n"))).where(F.col("pair") <= pairs)
    parts = pair.select("conv_id", "pair", F.posexplode(F.array("a", "q")).alias("side", "text")).withColumn("size", size(F.col("text")))
    kept = short_prefix(parts, "conv_id", ["pair", "side"], F.col("size"), budget)
    texts = F.sort_array(F.collect_list(F.struct((-F.col("pair")).alias("p"), (-F.col("side")).alias("s"), "text")))
    joined = kept.groupBy("conv_id").agg(F.sum("size").alias("n_tokens"), F.count_if(F.col("side") == 1).alias("full"), F.array_join(F.transform(texts, lambda x: x["text"]), "\n").alias("history"))
    every = turns.select("conv_id").distinct().join(joined, "conv_id", "left")
    some = F.coalesce(F.col("full") > 0, F.lit(False))
    return every.select("conv_id", F.when(some, F.col("history")).otherwise(F.lit("")).alias("history"), F.when(some, F.col("n_tokens")).otherwise(F.lit(0)).cast("bigint").alias("n_tokens"))


def full_windows(rows: DataFrame, by: str, order: str, value: str, size: int, stretch: int = 10_000) -> DataFrame:
    """Every run of ``size`` consecutive values of a group: ``(by, start, values)``.

    A group is cut into stretches of rows; the first ``size`` - 1 rows of one are also given to the stretch before.
    """
    own = F.floor(F.col("_n") / stretch)
    also = F.when((F.col("_n") % stretch < size - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    spread = placed(rows.select(by, order, value), by, [order]).withColumns({"_own": own, "_in": F.explode(also)})
    w = Window.partitionBy(by, "_in").orderBy("_n").rowsBetween(0, size - 1)
    runs = spread.select(by, F.col(order).alias("start"), "_own", "_in", F.collect_list(F.coalesce(F.col(value), F.lit(""))).over(w).alias("values"))
    return runs.where((F.size("values") == size) & (F.col("_own") == F.col("_in"))).drop("_own", "_in")


def disjoint_starts(rows: DataFrame, by: str, order: str, size: int, seed: int = 0) -> DataFrame:
    """Start rows of windows of ``size`` that don't overlap: each group is cut in blocks from an offset that a seeded hash draws."""
    places = placed(rows.select(by, order), by, [order]).withColumnRenamed("_n", "n")
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    shift = F.pmod(F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), F.col(by).cast("string"))), F.lit(8)), 16, 10).cast("bigint"), F.lit(size))
    return places.join(counts, by).where((F.pmod(F.col("n") - shift, F.lit(size)) == 0) & (F.col("n") >= shift) & (F.col("n") + size <= F.col("total"))).select(by, F.col(order).alias("start"))


def batches(rows: DataFrame, by: str, order: str, size: int) -> DataFrame:
    """Number of the batch of ``size`` consecutive rows that each row belongs to, within its group."""
    return placed(rows, by, [order]).withColumn("batch", F.floor(F.col("_n") / size).cast("bigint")).drop("_n")


def roles_by_position(texts: Column) -> Column:
    """Array of texts as array of struct(role, content): user at even places, assistant at odd ones."""
    return F.transform(texts, lambda t, i: F.struct(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), t.alias("content")))


def merge_history(texts: Column, prompt: Column) -> Column:
    """History and prompt as one text: a line a turn with its role, a blank line, the prompt; without history the prompt."""
    lines = F.transform(texts, lambda t, i: F.concat(F.when(i % 2 == 0, F.lit("user: ")).otherwise(F.lit("assistant: ")), t, F.lit("\n")))
    return F.when(F.coalesce(F.size(texts), F.lit(0)) > 0, F.concat(F.array_join(lines, ""), F.lit("\n\n"), prompt)).otherwise(prompt)
