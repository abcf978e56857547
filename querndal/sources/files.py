"""File sources: one row for each document, with what couldn't be read set aside."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import path_kind

#: File types in the order of their loading.
EXTENSIONS = ("pdf", "md", "docx", "txt", "csv", "pptx")
SCHEMA = "source string, page int, text string"


def list_files(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Files of a directory (not of those below) with an extension, case-sensitive: ``(source, length, modified)``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", "false").load(path)
    return found.select(F.col("path").alias("source"), "length", F.col("modificationTime").alias("modified"))


def text_pages(data: bytes) -> list[str]:
    return [decode_bytes(data)]


def csv_pages(data: bytes) -> list[str]:
    """One text for each row of a CSV file: ``column: value`` lines by the file's own header; missing values are empty, values beyond the header are left out."""
    return ["\n".join(f"{k}: {v or ''}" for k, v in row.items() if k is not None) for row in csv.DictReader(io.StringIO(decode_bytes(data), newline=""))]


def read_text(spark: SparkSession, path: str | list[str], extension: str | None = None) -> DataFrame:
    """Whole text files (txt, md) in the encoding they are found to have, page 0."""
    return read_binary(spark, path, extension, text_pages).select("source", "page", "text")


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row for each CSV row: ``column: value`` lines as text, its place in the file as page. Each file is read by its own header."""
    return read_binary(spark, path, "csv", csv_pages).select("source", "page", "text")


def _xml_texts(data: bytes, names: str, paragraph: str, run: str) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = sorted((n for n in z.namelist() if re.fullmatch(names, n)), key=lambda n: [int(x) for x in re.findall(r"\d+", n)])
        return ["\n".join("".join(t.text or "" for t in p.iter() if t.tag.endswith(run)) for p in ElementTree.fromstring(z.read(n)).iter() if p.tag.endswith(paragraph)) for n in files]


def docx_pages(data: bytes) -> list[str]:
    return _xml_texts(data, r"word/document\.xml", "}p", "}t")


def pptx_pages(data: bytes) -> list[str]:
    return ["\n".join(_xml_texts(data, r"ppt/slides/slide\d+\.xml", "}p", "}t"))]


def pdf_pages(data: bytes) -> list[str]:
    """Pages of a PDF; needs a parser package, without which every PDF is set aside."""
    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]


PAGES = {"pdf": pdf_pages, "md": text_pages, "docx": docx_pages, "txt": text_pages, "csv": csv_pages, "pptx": pptx_pages}
_PARSED = f"{SCHEMA}, modified timestamp, error string"


def raw_files(spark: SparkSession, path: str | list[str], extension: str | None = None) -> DataFrame:
    """``(path, modificationTime, content)`` of the files in folders or of the given ones; content is read only where it is selected. ``extension`` may be several as ``{a,b}``."""
    reader = spark.read.format("binaryFile")
    if extension:
        reader = reader.option("pathGlobFilter", f"*.{extension}")
    return reader.load(path).select("path", "modificationTime", "content")


def parse_files(raw: DataFrame, pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """``(source, page, text, modified, error)`` of ``raw_files``, read by ``pages`` or by their extension; a file that can't be read gives one row with its error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for n, (source, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                try:
                    read = pages or PAGES.get(extension_of(source), text_pages)
                    found = [(source, i, t, None) for i, t in enumerate(read(data))]
                except Exception as e:  # whatever a broken file raises
                    found = [(source, None, None, f"{type(e).__name__}: {e}"[:200])]
                rows += found
                of += [n] * len(found)
            source, page, text, error = (pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string())))
            yield pa.RecordBatch.from_arrays([source, page, text, batch.column(1).take(pa.array(of, pa.int64())), error], ["source", "page", "text", "modified", "error"])

    return raw.mapInArrow(parse, _PARSED)


def read_binary(spark: SparkSession, path: str | list[str], extension: str | None, pages: Callable[[bytes], list[str]]) -> DataFrame:
    """``(source, page, text, error)`` of documents; a file that can't be read gives one row with its error."""
    return parse_files(raw_files(spark, path, extension), pages).select("source", "page", "text", "error")


def _sorted_out(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.col("error").isNull() & F.coalesce(F.trim("text") != "", F.lit(False))
    return every.where(good).drop("error"), every.where(~good).select("source", F.coalesce("error", F.lit("no text")).alias("error"))


KNOWN = "{" + ",".join(EXTENSIONS) + "}"


def read_directory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(documents, ignored)``: documents of all known file types in their order (``ext_rank``), and sources that couldn't be read or are blank."""
    rank = F.array_position(F.array(*[F.lit(e) for e in EXTENSIONS]), F.regexp_extract("source", "[^.]*$", 0)).cast("int") - 1
    good, ignored = _sorted_out(parse_files(raw_files(spark, path, KNOWN)).withColumn("ext_rank", rank))
    return good.select("ext_rank", "source", "page", "text"), ignored


def extension_of(path: str) -> str:
    return path.rpartition(".")[2].lower()


def read_files(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(documents, ignored)`` of the given files, each read by its type; other types are read as text."""
    if not paths:
        none = spark.createDataFrame([], f"{SCHEMA}, error string")
        return none.drop("error"), none.select("source", "error")
    good, ignored = _sorted_out(parse_files(raw_files(spark, paths)))
    return good.select("source", "page", "text"), ignored


def read_urls(urls: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """``(url, title, text)`` of a table ``(url)``: pages are fetched by the tasks; title and text are empty where that fails."""
    from .html import page_text

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = []
            for url in batch.column(0).to_pylist():
                try:
                    pages.append(page_text(fetch(url)))
                except Exception:  # whatever a request raises
                    pages.append(("", ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[i] for p in pages], pa.string()) for i in (0, 1))], ["url", "title", "text"])

    return urls.select("url").mapInArrow(get, "url string, title string, text string")


#: Byte order marks with their encodings.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def detect_encoding(data: bytes) -> str:
    """Encoding of a text: its byte order mark, UTF-8 if it is valid, else the double-byte encoding whose characters look used, else cp1252.

    A text looks like Big5 or GB 18030 if it decodes and most of its double bytes are common characters, which both place in
    their first level; letters with accents lie beyond those lead bytes.
    """
    data = bytes(data)
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    shares = {}
    for name, low, high in (("utf-8", 0, 0), ("big5", 0xA4, 0xC6), ("gb18030", 0xB0, 0xD7), ("shift_jis", 0x81, 0x97)):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        if name == "utf-8":
            return name
        wide = [c.encode(name) for c in text if ord(c) > 127]
        han = sum(0x3040 <= ord(c) < 0xA000 for c in text if ord(c) > 127)
        shares[name] = min(sum(low <= w[0] <= high for w in wide if len(w) > 1), han) / max(1, len(wide)) + (0.2 if any(0x3040 <= ord(c) < 0x3100 for c in text) else 0)
    best = max(shares, key=shares.get, default="")
    return best if shares.get(best, 0) >= 0.6 else "cp1252"


def decode_bytes(data: bytes) -> str:
    """Text of bytes in their encoding; what it can't read becomes a replacement character."""
    return bytes(data).decode(detect_encoding(data), "replace")


def read_info(spark: SparkSession, info, fetch: Callable[[str], str] | None = None) -> DataFrame:
    """Documents of a text, path, url or list of them: empty strings are skipped, urls go through ``fetch`` (HTML), files are read by their type,
    strings of 255 characters or more and unknown paths are text themselves. Paths are those of Spark's file systems."""
    rows: list[tuple] = []
    urls, folders, files, frames = [], [], [], []
    for x in info if isinstance(info, (list, tuple)) else [info]:
        s = str(x)
        if not s:
            continue
        # A colon beyond the scheme, a line feed or a pattern is no path.
        kind = path_kind(spark, s) if len(s) < 255 and not re.search(r"[\n:?*\[{]", re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/", "/", s)) else None
        if re.match("^https?://", s):
            urls.append((s,))
        elif kind == "dir":
            folders.append(s)
        elif kind == "file":
            files.append(s)
        else:
            rows.append((None, 0, s))
    if folders:
        frames.append(_sorted_out(parse_files(raw_files(spark, folders, KNOWN)))[0].select("source", "page", "text"))
    if files:
        frames.append(read_files(spark, files)[0])
    if urls:
        pages = read_urls(spark.createDataFrame(urls, "url string"), fetch or (lambda url: None))
        frames.append(pages.select(F.col("url").alias("source"), F.lit(0).alias("page"), "text"))
    frames.append(spark.createDataFrame(rows, SCHEMA))
    return reduce(DataFrame.unionByName, frames)
