import json
import logging
import os
import shutil
import zipfile

import pytest
from pyspark.sql import functions as F

from querndal import cli, log
from querndal.functions import counters
from querndal.operators import fuse
from querndal.operators import windows as W
from querndal.operators.evals import bert_score, evaluate
from querndal.operators.models import explain_tools, tool
from querndal.sources import files
from querndal.sources.load import load_store, process_db, refresh_urls
from querndal.streaming.ingest import init_memory, show_memory


def docx(path, *lines):
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in lines)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="x"><w:body>{body}</w:body></w:document>')


@pytest.fixture
def inputs(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text("the code is 4711")
    (d / "b.csv").write_text("name,age\nann,7\nbob,8\n")
    (d / "c.csv").write_text("city,zip\nbonn,53111\n")
    (d / "e.txt").write_text("  \n")
    (d / "f.docx").write_bytes(b"no zip")
    (d / "g.bin").write_text("not a known type")
    docx(d / "h.docx", "first line", "second line")
    return tmp_path


def test_csv_files_keep_their_own_headers(spark, inputs):
    got = {(os.path.basename(r.source), r.page): r.text for r in files.read_csv(spark, str(inputs / "in")).collect()}
    assert got == {("b.csv", 0): "name: ann\nage: 7", ("b.csv", 1): "name: bob\nage: 8", ("c.csv", 0): "city: bonn\nzip: 53111"}


def test_process_db_builds_what_is_new(spark, inputs):
    fetched = []

    def fetch(url):
        if "down" in url:
            raise OSError("unreachable")
        return f"<title>T</title><p>page {url[-1]}</p>"

    args = ([str(inputs / "in"), "https://x.test/1", "https://x.test/down", str(inputs / "nowhere")], str(inputs / "store"), str(inputs / "ledger"))
    chunks, ignored = process_db(spark, *args, fetch=fetch)
    by = {os.path.basename(r.source): r for r in chunks.collect()}
    assert set(by) == {"a.txt", "b.csv", "c.csv", "h.docx", "1"} and by["h.docx"].docs == "first line\nsecond line" and len(by["a.txt"].embeds) == 64
    assert by["1"].metadatas["title"] == "T" and by["a.txt"].metadatas["page"] == "0" and chunks.count() == 6
    assert {os.path.basename(r.source) for r in ignored.collect()} == {"nowhere", "e.txt", "f.docx", "down"}
    # Nothing new: nothing is built again. Then one file changes, its chunks are replaced.
    before = spark.read.parquet(args[2]).count()
    assert process_db(spark, *args, fetch=fetch)[0].count() == 6 and spark.read.parquet(args[2]).count() == before
    (inputs / "in" / "a.txt").write_text("the code is 4712")
    os.utime(inputs / "in" / "a.txt", (2_000_000_000, 2_000_000_000))
    docs = [r.docs for r in process_db(spark, *args, fetch=fetch)[0].collect()]
    assert "the code is 4712" in docs and "the code is 4711" not in docs and len(docs) == 6 and not fetched
    only = load_store(spark, args[1], files=["x/h.docx"]).collect()
    assert [os.path.basename(r.source) for r in only] == ["h.docx"]
    # Files given one by one belong to their folder's collection.
    again, _ = process_db(spark, [str(inputs / "in" / "c.csv")], args[1], args[2])
    assert again.count() == 5
    with pytest.raises(ValueError):
        load_store(spark, str(inputs / "none"))
    shutil.rmtree(inputs / "in")
    (inputs / "in").mkdir()
    assert process_db(spark, [str(inputs / "in")], args[1], args[2])[0].count() == 5


def test_read_info(spark, inputs):
    rows = files.read_info(spark, [str(inputs / "in" / "h.docx"), str(inputs / "in" / "b.csv"), "", "free text", "https://x.test/1", "x" * 300], lambda u: "<p>page</p>").collect()
    assert sorted(r.text for r in rows) == sorted(["first line\nsecond line", "name: ann\nage: 7", "name: bob\nage: 8", "free text", "page", "x" * 300])


@pytest.mark.parametrize("text, name", [("héllo", "utf-8"), ("這是繁體中文的文件，內容是測試。", "big5"), ("这是简体中文的文件，内容是测试。", "gb18030"), ("これは日本語のテストです。", "shift_jis"), ("Der Käse für Öl über naïve Größe", "cp1252"), ("plain", "utf-8"), ("señor año", "cp1252"), ("wide", "utf-16")])
def test_encodings(text, name):
    assert files.decode_bytes(text.encode(name)) == text


def test_url_refresh(spark):
    ledger = spark.sql("SELECT 'c' collection, u item, 'url' kind, CAST(null AS DOUBLE) mtime, CAST(t AS TIMESTAMP) fetched_at, timestamp'2025-01-01' written_at FROM VALUES ('https://x.test/old', '2025-01-01'), ('https://x.test/new', '2025-05-30'), ('https://x.test/never', null) AS v(u, t)")
    pages, rows = refresh_urls(ledger, lambda u: f"<p>{u[-3:]}</p>", F.lit("2025-06-01").cast("timestamp"))
    assert {r.text for r in pages.collect()} == {"old", "ver"} and rows.count() == 2


def test_command_line(spark, inputs, capsys):
    store = str(inputs / "store")
    assert cli.main(["ingest", "--store", store, "--ledger", str(inputs / "ledger"), str(inputs / "in")], spark) == 0
    cli.main(["search", "--store", store, "--type", "bm25", "--k", "1", "code 4711"], spark)
    cli.main(["ask", "--store", store, "--type", "bm25", "--k", "1", "code 4711"], spark)
    out = capsys.readouterr().out
    assert "5 chunks" in out and "1. the code is 4711" in out
    chunks = cli.chunks_of(load_store(spark, store))
    got = list(cli.keep_asking(spark, chunks, ["code 4711", "bonn", " ", "never asked"], lambda p: p.split("\n\n")[-1], search_type="bm25", k=1))
    assert got == ["the code is 4711", "city: bonn\nzip: 53111"]


def test_logging(tmp_path):
    logger = log.configure("info", str(tmp_path / "l"), "json")
    logger.info("héllo %d", 7)
    assert json.loads((tmp_path / "l").read_text())["message"] == "héllo 7" and len(log.configure("debug").handlers) == 1
    assert logging.getLogger("querndal").level == logging.DEBUG
    with pytest.raises(ValueError):
        log.configure(form="xml")


def test_memory_begins_with_a_greeting(spark, tmp_path):
    place = str(tmp_path / "memory")
    assert [r.ord for r in show_memory(init_memory(spark, place)).collect()] == [0] and init_memory(spark, place).count() == 1


def test_counters(spark):
    df = spark.createDataFrame([(0, 0, 1, "a b 中文"), (0, 1, 2, None), (0, 2, 3, "x"), (0, 3, 4, "yy zz")], "query_id int, rank int, ord bigint, text string")
    row = df.select(*[F.collect_list(c(F.col("text"))).alias(str(i)) for i, c in enumerate((counters.words, counters.characters, counters.han_words, counters.of_callable(len)))]).first()
    assert [list(x) for x in row] == [[3, 0, 1, 2], [6, 0, 1, 5], [4, 0, 1, 2], [6, 0, 1, 5]]
    kept = fuse.round_robin(df.withColumn("retriever_idx", F.lit(0)), 7, counters.characters)
    assert {r.ord for r in kept.collect()} == {1, 2, 3}
    if os.path.isdir("/opt/tokenizers"):
        assert df.select(counters.tokenizer()(F.col("text")).alias("n")).where("n > 0").count() == 3


def test_windows_over_a_group_that_spreads_over_many_tasks(spark):
    """One group holds nearly all rows; places, prefixes, batches and windows are those of plain sequences."""
    rows = [("big", i, i % 4) for i in range(500)] + [("small", i, 9) for i in range(3)] + [(None, i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, o bigint, n int").repartition(7)
    for g in ("big", "small", None):
        mine = [n for x, _, n in rows if x == g]
        of = F.col("g").eqNullSafe(F.lit(g))
        assert [r._n for r in W.placed(df, "g", ["o"]).where(of).orderBy("o").collect()] == list(range(len(mine)))
        totals = [sum(mine[: i + 1]) for i in range(len(mine))]
        assert [r.total for r in W.prefix_within(df, "g", ["o"], F.col("n"), 300).where(of).orderBy("o").collect()] == [t for t in totals if t <= 300]
        assert [r.batch for r in W.batches(df, "g", "o", 7).where(of).orderBy("o").collect()] == [i // 7 for i in range(len(mine))]
    got = W.full_windows(df.select("g", "o", F.col("n").cast("string").alias("v")), "g", "o", "v", 3, stretch=20).where("g = 'big'").orderBy("start").collect()
    assert [(r.start, r["values"]) for r in got] == [(i, [str((i + j) % 4) for j in range(3)]) for i in range(498)]
    assert W.prefix_within(df.limit(0), "g", ["o"], F.col("n"), 3).count() == 0


def test_scores_and_tools(spark):
    df = spark.createDataFrame([("a", "a"), (None, "a"), ("b", None)], "c string, r string")
    assert [r[0] for r in df.select(bert_score(F.col("c"), F.col("r"), lambda c, r: [0.91239] * len(c))).collect()] == [0.912, 0.0, 0.0]

    def broken(c, r):
        raise RuntimeError("no model")

    assert [r[0] for r in df.select(bert_score(F.col("c"), F.col("r"), broken)).collect()] == [0.0, 0.0, 0.0]
    schema = "qid int, question_style string, question_type string, question string, choices array<string>, answer string"
    q = spark.createDataFrame([(1, "essay", "summary", "Long text. More.", None, "Long text.")], schema)
    one = evaluate(q, spark.createDataFrame([(1, "other")], "qid int, context string"), lambda p: p.split("\n\n")[1].split(". ")[0] + ".", bert=lambda c, r: [float(x == y) for x, y in zip(c, r, strict=True)]).first()
    assert one.response == "Long text." and one.bert == 1.0 and one.rouge == 1.0

    def add(a: int, b: int) -> int:
        return a + b

    assert explain_tools([tool(add, "adds")]) == {"add": "adds, args: {a:int, b:int}"}
    tool(add, "adds").register(spark, "bigint")
    assert spark.sql("SELECT add(id, 2) FROM range(3)").collect()[2][0] == 4
