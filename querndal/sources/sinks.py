"""Sources and sinks of question sets, logs and experiment rows, and a search engine source."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
except ImportError:  # an older session without Python data sources
    DataSource = DataSourceReader = InputPartition = None


def _field(name: str) -> Callable:
    return lambda x: x[name]


def write_questions(questions: DataFrame, path: str) -> None:
    """Question sets as JSON lines, one set of a style and type a line, with parallel arrays of questions and answers."""
    rows = F.sort_array(F.collect_list(F.struct("qid", "question", "choices", "answer")))
    sets = questions.groupBy("question_style", "question_type").agg(rows.alias("r"))
    sets.select("question_style", "question_type", *[F.transform("r", _field(c)).alias(c) for c in ("qid", "question", "choices", "answer")]).write.mode("overwrite").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row a question; a file without the four needed keys raises ValueError."""
    sets = spark.read.json(path)
    if missing := {"question_style", "question_type", "question", "answer"} - set(sets.columns):
        raise ValueError(f"missing keys: {sorted(missing)}")
    zipped = F.arrays_zip(*[F.col(c) for c in ("qid", "question", "choices", "answer") if c in sets.columns])
    return sets.select("question_style", "question_type", F.explode(zipped).alias("q")).select("question_style", "question_type", "q.*")


def write_logs(runs: DataFrame, path: str, form: str = "json") -> None:
    """Run logs as JSON lines, or as ``key: value`` text."""
    if form == "json":
        runs.write.mode("append").json(path)
    else:
        lines = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in runs.columns])
        runs.select(F.concat(lines, F.lit("\n")).alias("value")).write.mode("append").text(path)


def append_memory(entries: DataFrame, path: str) -> None:
    """Memory blocks, partitioned by category."""
    block = F.concat(F.lit("## "), F.col("at").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n"))
    entries.select("category", block.alias("value")).write.mode("append").partitionBy("category").text(path)


def write_markdown(spark: SparkSession, memory: str, folder: str) -> list[str]:
    """One ``<category>.md`` for each category of the memory at ``memory``: its blocks, streamed from part to part; returns the files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for category in sorted(r[0] for r in spark.read.text(memory).select("category").distinct().collect()):
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(category)
        source, place = jvm.org.apache.hadoop.fs.Path(f"{memory}/category={escaped}"), jvm.org.apache.hadoop.fs.Path(f"{folder}/{escaped}.md")
        fs = source.getFileSystem(conf)
        written = fs.create(place, True)
        for part in sorted((x.getPath() for x in fs.listStatus(source) if x.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            opened = fs.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(opened, written, conf, False)
            opened.close()
        written.close()
        out.append(f"{folder}/{escaped}.md")
    return out


def write_experiment(runs: DataFrame, path: str, name: str, parameters: list[str], metrics: list[str]) -> None:
    """An experiment's runs: ``parameters`` as text and ``metrics`` as means (NaN left out) in long form, and the table of runs itself, below ``path/name``."""
    sides = {
        "params": runs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in parameters])).alias("p")).select("p.*").where("value is not null").distinct(),
        "metrics": runs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("value")) for c in metrics])).alias("m")).groupBy("m.key").agg(F.avg("m.value").alias("value")),
        "table": runs,
    }
    for side, df in sides.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}/{side}")


def save_json(texts: DataFrame, text: str, path: str) -> None:
    """The JSON objects in a column of texts as JSON lines; texts without any are left out."""
    from ..functions.json_text import extract_objects

    texts.select(F.explode(extract_objects(F.col(text))).alias("value")).write.mode("append").text(path)


#: Search engines by name: a callable (query, count) -> list of (title, url, text).
ENGINES: dict[str, Callable[[str, int], list[tuple[str, str, str]]]] = {}

if DataSource is not None:

    class WebSearch(DataSource):
        """``spark.read.format("web_search").option("engine", ...).option("hits", JSON)``: results of an injected engine.

        The engine runs on the driver and its results are handed to the reader, as engines are external services.
        """

        @classmethod
        def name(cls) -> str:
            return "web_search"

        def schema(self) -> str:
            return "title string, url string, text string"

        def reader(self, schema):
            return _Reader(json.loads(self.options.get("hits", "[]")))

    class _Reader(DataSourceReader):
        def __init__(self, hits):
            self.hits = hits

        def partitions(self):
            return [InputPartition(0)]

        def read(self, partition):
            yield from (tuple(h) for h in self.hits)


def search_web(spark: SparkSession, engine: str, query: str, count: int = 5) -> DataFrame:
    """Results of a registered engine; unknown engines raise ValueError."""
    if engine not in ENGINES:
        raise ValueError(f"unknown engine: {engine}")
    spark.dataSource.register(WebSearch)
    return spark.read.format("web_search").option("hits", json.dumps(ENGINES[engine](query, count))).load()
