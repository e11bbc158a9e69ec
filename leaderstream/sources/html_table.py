"""The first table of a web page, as a small helper inside a Pandas UDF."""

from __future__ import annotations

import sys
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tasks get the helper below by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TEXTS = T.ArrayType(T.StringType())
TABLE_TYPE = T.StructType([T.StructField("headers", _TEXTS), T.StructField("rows", T.ArrayType(_TEXTS))])

# Elements without an end tag, and elements whose text is not
# part of the text around them.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
HIDDEN = frozenset("rp rt script style template".split())


class _TableClosed(Exception):
    """Raised at the end of the first table: nothing behind it matters."""


class _FirstTable(HTMLParser):
    """Collects header cells and rows of the first table, nested ones included.

    A cell belongs to every row it lies in, and its text is all text inside it.
    An end tag closes everything opened since its start tag. There is one
    running text; a cell is a stretch of it and a row a stretch of the cells,
    so that elements without an end tag cost no more than others.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # Tag and cell or row of each open element; how often each tag is open.
        self.open: list[tuple[str, list[int] | None]] = []
        self.depth: Counter[str] = Counter()
        self.hidden = 0
        self.table_at: int | None = None
        self.parts: list[str] = []
        self.length = 0
        self.headers: list[list[int]] = []
        self.cells: list[list[int]] = []
        self.rows: list[list[int]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        stretch: list[int] | None = None
        if self.table_at is None:
            if tag == "table":
                self.table_at = len(self.open)
        elif tag == "tr":
            stretch = [len(self.cells), -1]
            self.rows.append(stretch)
        elif tag in ("th", "td"):
            stretch = [self.length, -1]
            (self.headers if tag == "th" else self.cells).append(stretch)
        self.open.append((tag, stretch))
        self.depth[tag] += 1
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.depth[tag]:
            return
        while True:
            name, stretch = self.open.pop()
            self.depth[name] -= 1
            self.hidden -= name in HIDDEN
            if stretch:
                stretch[1] = len(self.cells) if name == "tr" else self.length
            if name == tag:
                break
        if self.table_at is not None and len(self.open) <= self.table_at:
            raise _TableClosed

    def handle_data(self, data):
        if self.table_at is not None and not self.hidden:
            self.parts.append(data)
            self.length += len(data)


def first_table(html: str | None, whole: bool = True) -> dict | None:
    """``headers`` and ``rows`` (the first row left out) of a page's first table.

    Unless ``whole``, rows whose number of cells is not that of the headers are
    empty lists: their texts are not worked out.
    """
    if html is None:
        return None
    parser = _FirstTable()
    try:
        parser.feed(html)
        parser.close()
    except _TableClosed:
        pass
    if parser.table_at is None:
        return None
    running = "".join(parser.parts)

    def text(stretch):
        begin, end = stretch
        return running[begin : end if end >= 0 else None].strip()

    def row(stretch):
        begin, end = stretch
        end = end if end >= 0 else len(parser.cells)
        if not whole and end - begin != len(parser.headers):
            return []
        return [text(c) for c in parser.cells[begin:end]]

    return {"headers": [text(h) for h in parser.headers], "rows": [row(r) for r in parser.rows[1:]]}


@F.pandas_udf(TABLE_TYPE)
def _first_tables(html: pd.Series) -> pd.DataFrame:
    tables = [first_table(h, whole=False) for h in html]
    return pd.DataFrame(
        {
            "headers": [t and t["headers"] for t in tables],
            "rows": [t and t["rows"] for t in tables],
        }
    )


# Declared so that a filter on the result stays above it: pushed below, it would
# parse every page a second time.
first_table_udf = _first_tables.asNondeterministic()
