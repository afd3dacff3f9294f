"""HTML tables: block extraction and cheap metadata as native expressions, and the one grid UDF.

The grid UDF gives, for a block, everything that later steps need: an error or the shape and every cell with its place,
its text at the anchor and the text repeated over spans. Tags come from the standard library's tolerant tokenizer; a
stack of open elements follows the rules of HTML 4 parsers: start tags end what they imply, end tags that match nothing
are passed over and don't reach beyond elements of a higher rank, nested tables are text of their cell, comments are left
out, entities are decoded. Cells outside any row, and those that an element between parts from their row, are left out.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, stripped

# Failure codes and decisions.
NO_TABLE_FOUND = "NO_TABLE_FOUND"
HTML_PARSE_ERROR = "HTML_PARSE_ERROR"
SPAN_EXPANSION_FAILED = "SPAN_EXPANSION_FAILED"
RECTANGULAR_INCONSISTENCY = "RECTANGULAR_INCONSISTENCY"
DEGENERATE_TABLE = "DEGENERATE_TABLE"
CODES = (NO_TABLE_FOUND, HTML_PARSE_ERROR, SPAN_EXPANSION_FAILED, RECTANGULAR_INCONSISTENCY, DEGENERATE_TABLE)
PASS, REPARSE = "PASS", "REPARSE"

MOST_CELLS = 1_000_000  # spans that cover more are an error: without a bound one attribute could fill the memory
END = r"(?![0-9A-Za-z_\p{L}\p{N}])"


def table_blocks(text: Column) -> Column:
    """The table blocks of a text in order, the shortest from each <table on; null has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(rf"(?is)<table{END}[^>]*>.*?</table{SPACE}*>"), F.lit(0)), F.array().cast("array<string>"))


def row_segments(html: Column) -> Column:
    """What follows each <tr> up to the next </tr>, which unclosed rows share; rows after the last </tr> have none."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<tr{END}[^>]*>(?=(.*?)</tr{SPACE}*>)"), F.lit(1))


def _count(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?is)<(?:{tag}){END}[^>]*>"))


def metadata(html: Column) -> Column:
    """row_count, col_count, has_merged_cells, has_nested_headers by patterns alone."""
    rows = row_segments(html)
    spans = F.regexp_extract_all(html, F.lit(rf"""(?is)(?:row|col)span{SPACE}*={SPACE}*["']?{SPACE}*([0-9]+)"""), F.lit(1))
    return F.struct(
        _count(html, "tr").alias("row_count"),
        F.coalesce(F.array_max(F.transform(rows, lambda r: _count(r, "td|th"))), F.lit(0)).alias("col_count"),
        F.exists(spans, lambda s: s.try_cast("long") > 1).alias("has_merged_cells"),
        ((_count(html, "thead") > 1) | F.exists(rows, lambda r: _count(r, "th") > 1)).alias("has_nested_headers"),
    )


def non_empty_cells(html: Column) -> Column:
    """Cells whose body without tags isn't blank."""
    bodies = F.regexp_extract_all(html, F.lit(rf"(?is)<(t[dh]){END}[^>]*>(.*?)</\1{SPACE}*>"), F.lit(2))
    return F.size(F.filter(bodies, lambda b: stripped(F.regexp_replace(b, "<[^>]+>", "")) != ""))


class TableError(Exception):
    """Carries a failure code."""


# Fixed values, those of HTML 4 parsers with implied end tags: the open elements that a start tag ends if they are the
# innermost; elements without content; and ranks, over which an end tag doesn't look for its element.
ENDED_BY = {
    "table": "p head h1 h2 h3 h4 h5 h6 pre listing xmp a",
    "caption": "p",
    "colgroup": "caption colgroup col p",
    "col": "caption col p",
    "thead": "caption col colgroup",
    "tfoot": "th td tr caption col colgroup thead tbody p",
    "tbody": "th td tr caption col colgroup thead tfoot tbody p",
    "tr": "th td tr caption col colgroup p",
    "td": "th td p span font a b u",
    "th": "th td p span font a b u",
    "p": "p head h1 h2 h3 h4 h5 h6",
    "div": "p head",
    "ul": "p head ol menu dir address pre listing",
    "ol": "p head ul",
    "li": "p h1 h2 h3 h4 h5 h6 dl address pre listing xmp head li",
    "center": "font b i p head",
    "a": "a head",
    "option": "option",
    "hr": "p head",
}
EMPTY = "area base basefont br col frame hr img input isindex link meta param embed".split()
RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190}
OTHER = 100  # the rank of all others
_ENDED = {k: frozenset(v.split()) for k, v in ENDED_BY.items()}
_OUTSIDE = frozenset(("html", "head", "body"))  # their tags don't count inside a table


class _Tree(HTMLParser):
    """The rows of the first table: lists of (rowspan, colspan, text pieces).

    A stack of open elements. A row counts where its nearest table is the first one, in whatever it stands; a cell
    counts right below a row that counts; a cell's text is all that stands in it, however deep.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str | None, str | None, list[str]]]] = []
        self.open: list[tuple[str, list | None, list[str] | None]] = []  # tag, cells of a row that counts, a cell's text
        self.cells: list[list[str]] = []  # texts of the open cells
        self.tables = 0  # open ones
        self.seen = False

    def handle_starttag(self, tag, attrs):
        if tag in _OUTSIDE or not (self.open or tag == "table" and not self.seen):
            return
        ended = _ENDED.get(tag, ())
        while self.open and self.open[-1][0] in ended:
            self.end()
        row, cell = None, None
        if tag == "table":
            self.tables, self.seen = self.tables + 1, True
        elif tag == "tr" and self.tables == 1:
            row = []
            self.rows.append(row)
        elif tag in ("td", "th") and self.open[-1][1] is not None:
            named = {}
            for k, v in attrs:
                named.setdefault(k, "" if v is None else v)
            cell = []
            self.open[-1][1].append((named.get("rowspan"), named.get("colspan"), cell))
            self.cells.append(cell)
        if tag not in EMPTY:
            self.open.append((tag, row, cell))

    def end(self):
        tag, _, cell = self.open.pop()
        self.tables -= tag == "table"
        if cell is not None:
            self.cells.pop()

    def handle_endtag(self, tag):
        rank = RANK.get(tag, OTHER)
        for k in reversed(range(len(self.open))):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self.end()
                return
            if RANK.get(self.open[k][0], OTHER) > rank:
                return

    def handle_data(self, data):
        for cell in self.cells:
            cell.append(data)


def span(raw: str | None) -> int:
    if raw is None:
        return 1
    try:
        n = int(raw.strip())
    except ValueError:
        raise TableError(SPAN_EXPANSION_FAILED) from None
    if n < 1:
        raise TableError(SPAN_EXPANSION_FAILED)
    return n


def expand(html: str | None) -> tuple[int, int, list[tuple[int, int, str, str]]]:
    """Rows, columns and cells (row, column, text at the anchor, text over the span) of a block's first table.

    Each cell takes the first free column after the ones its row has used. A span over a taken place is an error; so are
    rows that differ in width or have holes, counting rows that only spans reach.
    """
    if not html or not html.strip():
        raise TableError(HTML_PARSE_ERROR)
    parser = _Tree()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):
        raise TableError(HTML_PARSE_ERROR) from None
    if not parser.seen:
        raise TableError(HTML_PARSE_ERROR)
    taken: dict[tuple[int, int], tuple[str, str]] = {}
    for r, row in enumerate(parser.rows):
        c = 0
        for down, across, pieces in row:
            height, width = span(down), span(across)
            text = "".join(pieces).strip()
            while (r, c) in taken:
                c += 1
            if height * width > MOST_CELLS or len(taken) + height * width > 4 * MOST_CELLS:
                raise TableError(SPAN_EXPANSION_FAILED)
            for y in range(r, r + height):
                for x in range(c, c + width):
                    if (y, x) in taken:
                        raise TableError(SPAN_EXPANSION_FAILED)
                    taken[y, x] = (text if (y, x) == (r, c) else ""), text
            c += width
    if not taken:
        return 0, 0, []
    rows, columns = max(y for y, _ in taken) + 1, max(x for _, x in taken) + 1
    if len(taken) != rows * columns:
        raise TableError(RECTANGULAR_INCONSISTENCY)
    return rows, columns, [(y, x, *taken[y, x]) for y, x in sorted(taken)]


GRID = "struct<error:string,n_rows:int,n_cols:int,cells:array<struct<r:int,c:int,text:string,filled:string>>>"
_CELL = pa.struct([("r", pa.int32()), ("c", pa.int32()), ("text", pa.string()), ("filled", pa.string())])
_GRID = pa.struct([("error", pa.string()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("cells", pa.list_(_CELL))])


def _grids(blocks: pa.Array) -> pa.Array:
    def one(block: str | None) -> dict:
        try:
            rows, columns, cells = expand(block)
        except TableError as e:
            return {"error": str(e), "n_rows": 0, "n_cols": 0, "cells": []}
        return {"error": None, "n_rows": rows, "n_cols": columns, "cells": [dict(zip(("r", "c", "text", "filled"), x)) for x in cells]}

    return pa.array([[one(b) for b in page] if page is not None else [] for page in blocks.to_pylist()], pa.list_(_GRID))


def grids(blocks: Column) -> Column:
    """The grid of each of a page's blocks: one Arrow round trip for a batch of pages."""
    return F.arrow_udf(_grids, f"array<{GRID}>")(blocks)
