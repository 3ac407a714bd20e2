"""Legislation records out of scraped pages: an Arrow UDF over stdlib parsing, one small helper per row."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids of the page's elements.
FIELD_IDS = {
    "type": "ContentPlaceholder1_lblLegiFileType",
    "number": "ContentPlaceholder1_lblResNum",
    "status": "ContentPlaceholder1_lblStatus",
    "date_text": "ContentPlaceholder1_lnkDate",
    "title": "ContentPlaceholder1_lblLegiFileTitle",
}
INFO_TABLE = "tblLegiFileInfo"
RECORD_FIELDS = ("number", "type", "status", "date_text", "title", "department", "sponsors")
RECORD = T.StructType([T.StructField(name, T.StringType()) for name in RECORD_FIELDS])
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
FIELD_OF = {element: field for field, element in FIELD_IDS.items()}


class _Fields(HTMLParser):
    """Text of the first element with each known id, and the info table's headers with the next cell of their row."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: dict[str, str] = {}
        self.info: dict[str, str] = {}
        self.open: list[tuple[str, str | None]] = []
        self.tables = 0
        self.headers: list[str] = []
        self.cell: tuple[str, list[str]] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        name = next((v for k, v in attrs if k == "id"), None)
        field = FIELD_OF.get(name)
        if field in self.found:
            field = None  # a later element of the same id isn't read
        if field:
            self.found[field] = ""
        if tag in VOID:
            return
        if tag in ("th", "td", "tr"):
            self._close_cell()
        if tag == "tr":
            self.headers = []
        inside = name == INFO_TABLE
        self.tables += inside
        self.open.append((tag, INFO_TABLE if inside else field))
        if tag in ("th", "td") and self.tables:
            self.cell = (tag, [])

    def handle_data(self, data: str) -> None:
        for _, field in self.open:
            if field in self.found:
                self.found[field] += data.strip()
        if self.cell is not None:
            self.cell[1].append(data.strip())

    def _close_cell(self) -> None:
        if self.cell is None:
            return
        (kind, texts), self.cell = self.cell, None
        if kind == "th":
            self.headers.append("".join(texts).rstrip(":"))
        else:
            self.info.update(dict.fromkeys(self.headers, "".join(texts)))
            self.headers = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("th", "td", "tr", "table"):
            self._close_cell()
        if tag == "tr":
            self.headers = []
        if any(t == tag for t, _ in self.open):
            while True:
                closed, field = self.open.pop()
                self.tables -= field == INFO_TABLE
                if closed == tag:
                    break


#: Each field of a record: where it is found, and what stands in for it. None means no value.
DEFAULTS = {"status": "Unknown", "sponsors": ""}


def record_of(html: str | None, page_id: object) -> dict | None:
    """The record of one page; none without a title. An element that is there but empty gives an empty text."""
    parser = _Fields()
    parser.feed(html or "")
    parser.close()
    if not parser.found.get("title"):
        return None
    known = parser.found | {"department": parser.info.get("Department"), "sponsors": parser.info.get("Sponsors")}
    defaults = DEFAULTS | {"number": str(page_id)}
    return {field: known[field] if known.get(field) is not None else defaults.get(field) for field in RECORD_FIELDS}


@F.pandas_udf(RECORD)
def page_record(html: pd.Series, page_id: pd.Series) -> pd.DataFrame:
    rows = [record_of(h, i) or dict.fromkeys(RECORD_FIELDS) for h, i in zip(html, page_id, strict=True)]
    return pd.DataFrame(rows, columns=list(RECORD_FIELDS), dtype=object)


#: Not deterministic for the optimizer, which else would parse every page once more to filter by its record.
page_record = page_record.asNondeterministic()


def page_title(html: Column) -> Column:
    """The text of a page's title element; null without one."""
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
