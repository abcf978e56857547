"""Titles and visible text of HTML pages, and HTTP dates."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are dropped with all they hold, elements without an end tag, and the title of pages without one.
DROPPED = {"footer", "nav", "a"}
VOID = {"meta", "br", "hr", "img", "input", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
NO_TITLE = "No title found"


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.parts: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.inside.append(tag)

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass

    def handle_data(self, data):
        if "title" in self.inside and self.title is None and data.strip():
            self.title = data.strip()
        if data.strip() and not DROPPED & set(self.inside):
            self.parts.append(data.strip())


def page_text(html: str | None) -> tuple[str, str]:
    """Title and visible text (text nodes without outer white space, joined by a space); two empty strings for null."""
    if html is None:
        return "", ""
    page = _Page()
    page.feed(html)
    page.close()
    return page.title or NO_TITLE, " ".join(page.parts)


def _extract(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_text(x) for x in html], columns=["title", "text"])


def extract_page(html: Column) -> Column:
    """struct(title, text) of a page."""
    return F.pandas_udf(_extract, "struct<title:string,text:string>")(html)


def last_modified(header: Column) -> Column:
    """Time of an HTTP date header (UTC); null where it can't be read."""
    return F.try_to_timestamp(F.regexp_extract(header, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
