import io
import zipfile

import pytest
from pyspark.sql import functions as F

from querndal.operators import aggregates as A
from querndal.plans import queries as core
from querndal.sources import files, ledger, sinks, store
from querndal.streaming.ingest import current_store, stale_urls, stream_files, window_counts


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://w"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_directory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("alpha")
    (tmp_path / "b.md").write_text("# beta")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n3,\n")
    (tmp_path / "d.docx").write_bytes(docx("delta"))
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / "blank.txt").write_text("  ")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.txt").write_text("hidden")
    docs, ignored = files.read_directory(spark, str(tmp_path))
    assert {(r.source.rsplit("/", 1)[1], r.page, r.text) for r in docs.collect()} == {("a.txt", 0, "alpha"), ("b.md", 0, "# beta"), ("c.csv", 0, "x: 1\ny: 2"), ("c.csv", 1, "x: 3\ny: "), ("d.docx", 0, "delta")}
    assert {r.source.rsplit("/", 1)[1] for r in ignored.collect()} == {"e.docx", "blank.txt"}
    info = files.read_info(spark, ["", "literal", str(tmp_path / "a.txt"), "http://x.test"], fetch=lambda u: "<p>page</p>")
    assert sorted(r.text for r in info.collect()) == ["alpha", "literal", "page"]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "collection string, ord bigint, ids string, docs string, source string")


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    a = chunks(spark, [("c/1", 0, "i0", "x", "d/a.txt"), ("c/1", 1, "i1", "y", "d/b.txt"), ("c2", 2, "i2", "z", None)])
    store.append(a, path)
    assert store.read_store(spark, path, ["c/1"]).count() == 2
    assert store.rewrite(spark, path, "c/1", F.col("source") != "d/a.txt") == 1
    assert {r.ids for r in store.read_store(spark, path).collect()} == {"i1", "i2"}
    assert store.drop_collection(spark, path, "c/1") == 1 and store.drop_collection(spark, path, "none") == 0


def test_merge_is_idempotent(spark):
    a = chunks(spark, [("c", 0, "1", "alpha", None), ("c", 1, "s", "shared", None)])
    b = chunks(spark, [("c", 2, "s", "shared", None), ("c", 3, "2", "beta", None), ("c", 4, "2", "again", None), ("c", 5, None, "n", None)])
    m = store.merge(a, b)
    assert sorted(r.docs for r in m.collect()) == ["alpha", "beta", "n", "shared"] and store.merge(m, b).count() == 4
    assert sorted(r.ord for r in A.first_by_text(a.unionAll(b)).collect()) == [0, 1, 3, 4, 5]
    gone = spark.createDataFrame([("a.txt",)], "file string")
    assert store.delete_files(chunks(spark, [("c", 0, "1", "x", "q\\a.txt"), ("c", 1, "2", "y", None)]), gone).count() == 1


def test_ledger(spark):
    rows = [("c", "a", "file", 1.0, None, "2024-01-01"), ("c", "a", "file", 2.0, None, "2024-01-02"), ("c", "u", "url", None, "2024-01-01", "2024-01-01"), ("c", None, "file", 9.0, None, "2024-01-01")]
    led = spark.createDataFrame(rows, "collection string, item string, kind string, mtime double, fetched_at string, written_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("fetched_at", "written_at")})
    now = ledger.current(led)
    assert {(r.item, r.mtime) for r in now.collect()} == {("a", 2.0), ("u", None)}
    files_ = spark.createDataFrame([("c", "a", 2.0), ("c", "a2", 1.0), ("c", "u", 3.0)], "collection string, item string, mtime double")
    assert {(r.item, r.status) for r in ledger.file_status(files_, now).collect()} == {("a", "ALREADY_BUILT"), ("a2", "NOT_BUILT"), ("u", "OLD_BUILT")}
    urls = files_.select("collection", "item")
    status = {r.item: r.status for r in ledger.url_status(urls, now, F.lit("2024-02-15").cast("timestamp"), 30).collect()}
    assert status == {"a": "OLD_BUILT", "a2": "NOT_BUILT", "u": "OLD_BUILT"}


def test_questions_and_search(spark, tmp_path, sf):
    q = spark.read.parquet(f"{sf}/questions.parquet")
    path = str(tmp_path / "q")
    sinks.write_questions(q, path)
    assert sinks.read_questions(spark, path).count() == q.count()
    (tmp_path / "bad.json").write_text('{"question": ["x"]}')
    with pytest.raises(ValueError):
        sinks.read_questions(spark, str(tmp_path / "bad.json"))
    sinks.ENGINES["fake"] = lambda query, count: [(query, "http://x.test", "text")] * count
    assert sinks.search_web(spark, "fake", "word", 3).where("title = 'word'").count() == 3
    with pytest.raises(ValueError):
        sinks.search_web(spark, "nothing", "word")
    sinks.write_logs(q.select("qid", "question"), str(tmp_path / "log"), "txt")


def test_stream(spark, tmp_path):
    schema = "collection string, item string, mtime double, text string"
    base = str(tmp_path)

    def run(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{base}/in")
        stream_files(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/store", f"{base}/ledger", f"{base}/cp").awaitTermination()
        return {(r["item"], r["text"]) for r in current_store(spark, f"{base}/store").collect()}

    assert run([("c", "a", 1.0, "a1"), ("c", "b", 1.0, "b1")]) == {("a", "a1"), ("b", "b1")}
    assert run([("c", "a", 2.0, "a2"), ("c", "b", 1.0, "ignored"), ("c", None, 1.0, "x")]) == {("a", "a2"), ("b", "b1")}


def test_stream_fetches_counts_every_window(spark, sf):
    rows = spark.read.parquet(f"{sf}/ledger.parquet").where("kind = 'url' and fetched_at is not null")
    want = rows.groupBy(F.window("fetched_at", "30 days").start.alias("start")).agg(F.countDistinct("item").alias("urls"))
    got = sorted(map(tuple, core.QUERIES["stream_fetches"](spark, sf).collect()))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 1


def test_fetches_of_later_batches_join_their_window(spark, tmp_path):
    base = f"file://{tmp_path}"
    for hour, items in ((1, "ab"), (2, "bc")):
        spark.createDataFrame([(x, f"2025-01-01 0{hour}:00:00") for x in items], "item string, at string").select("item", F.to_timestamp("at").alias("fetched_at")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        pairs = stale_urls(spark.readStream.schema("item string, fetched_at timestamp").parquet(f"{base}/in"), "1 day", 1)
        pairs.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [r.urls for r in window_counts(spark.read.parquet(f"{base}/out")).collect()] == [3]
