"""Tables of HTML pages as rows of cells, and the cost records that published tables hold."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldbook.functions.scalars import money

#: Greatest spans that HTML knows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


@dataclass
class _Table:
    rows: list[list[str]] = field(default_factory=list)
    row: list[str] | None = None
    cell: list[str] | None = None
    wide: int = 1
    high: int = 1
    #: What cells of rows above still fill, by column: how many rows more, and the text.
    hanging: dict[int, tuple[int, str]] = field(default_factory=dict)

    def fill(self) -> None:
        """Cells that reach down from above into the next places of this row."""
        while (col := len(self.row)) in self.hanging:
            left, text = self.hanging.pop(col)
            self.row.append(text)
            if left > 1:
                self.hanging[col] = (left - 1, text)

    def end_cell(self) -> None:
        if self.cell is not None:
            text = " ".join("".join(self.cell).split())
            self.cell = None
            for _ in range(self.wide):
                self.fill()
                if self.high > 1:
                    self.hanging[len(self.row)] = (self.high - 1, text)
                self.row.append(text)

    def end_row(self) -> None:
        self.end_cell()
        if self.row is not None:
            self.fill()
            while self.hanging and max(self.hanging) >= len(self.row):  # a gap before a cell from above
                self.row.append("")
                self.fill()
            if any(self.row):
                self.rows.append(self.row)
            self.row = None


class _Tables(HTMLParser):
    """Keeps the open tables as a stack. A cell ends where the next one, its row or its table does, whether or not its tag is closed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[int, _Table]] = []
        self.done: dict[int, list[list[str]]] = {}
        self.seen = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.open.append((self.seen, _Table()))
            self.seen += 1
        elif self.open:
            table = self.open[-1][1]
            if tag in ("tr", "thead", "tbody", "tfoot"):
                table.end_row()
                table.row = [] if tag == "tr" else None
                if tag != "tr":
                    table.hanging.clear()
            elif tag in ("td", "th"):
                table.end_cell()
                table.row = [] if table.row is None else table.row
                spans = dict(attrs)
                table.wide = self._span(spans.get("colspan"), MOST_COLUMNS) or 1
                high = self._span(spans.get("rowspan"), MOST_ROWS)
                table.high = MOST_ROWS if high == 0 else high
                table.cell = []
            elif tag == "br":
                self.handle_data(" ")

    @staticmethod
    def _span(text: str | None, most: int) -> int:
        text = (text or "").strip()
        return min(int(text), most) if text.isascii() and text.isdigit() and len(text) < 10 else 1

    def handle_endtag(self, tag: str) -> None:
        if self.open:
            table = self.open[-1][1]
            if tag in ("td", "th"):
                table.end_cell()
            elif tag in ("tr", "thead", "tbody", "tfoot"):
                table.end_row()
            elif tag == "table":
                self._end_table()

    def _end_table(self) -> None:
        at, table = self.open.pop()
        table.end_row()
        self.done[at] = table.rows

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][1].cell is not None:
            self.open[-1][1].cell.append(data)

    def finish(self, html: str) -> dict[int, list[list[str]]]:
        self.feed(html)
        self.close()
        while self.open:
            self._end_table()
        return self.done


ROWS = "page_id long, block int, row int, header string, cells array<string>"


def page_tables(pages: DataFrame) -> DataFrame:
    """Rows of all tables of ``pages`` (``page_id``, ``html``): ``block`` and ``row`` from 0 in the page's order, ``cells``, and ``header``, the lower-cased first row.

    Entities are decoded, white space is one blank, cells that span rows or columns stand in each of them, inner tables count by themselves and give no text to the
    outer cell, unclosed tags end where HTML ends them. Rows without any text go. Null or empty html and pages without tables give no row; a page is
    the unit of work, nothing is shuffled.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "block", "row", "header", "cells"]
        for batch in batches:
            out = []
            for page, html in zip(batch["page_id"], batch["html"]):
                for block, rows in sorted(_Tables().finish(html).items()):
                    out += [(page, block, n, " ".join(rows[0]).lower(), cells) for n, cells in enumerate(rows)]
                if len(out) > 2000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    return pages.where("html is not null and page_id is not null and contains(lower(html), '<table')").select(F.col("page_id").cast("long"), "html").mapInPandas(read, ROWS)


# What the header rows of published tables say, and where their cells stand.
ROSTER_WORDS = ("roster cost", "conference")
SPEND_WORDS = (("athletic department annual expenses",), ("fy 2025", "spending rank"))
SPEND_DIVISION, SPEND_CONFERENCE, SPEND_AMOUNT = 2, 3, 5


def cost_records(tables: DataFrame) -> DataFrame:
    """``route`` (``roster``, ``spend``), ``team``, ``conference``, ``amount`` and the ``page_id`` of tables whose header row speaks of such costs.

    A roster's amount is the last cell of three or more. Spending counts for rows of six cells or more whose division is FBS. Rows whose
    amount isn't a whole number go. Of several records of a team and route the last (by page, table and row) counts.
    """
    says = lambda words: F.expr(" and ".join(f"contains(header, '{w}')" for w in words))
    size, cell = F.size("cells"), lambda k: F.get("cells", F.lit(k))
    roster = F.struct(F.lit("roster").alias("route"), cell(1).alias("conference"), money(F.element_at("cells", -1)).alias("amount"))
    spend = F.struct(F.lit("spend").alias("route"), cell(SPEND_CONFERENCE).alias("conference"), money(cell(SPEND_AMOUNT)).alias("amount"))
    is_roster = says(ROSTER_WORDS) & (size >= 3)
    is_spend = (says(SPEND_WORDS[0]) | says(SPEND_WORDS[1])) & (size > SPEND_AMOUNT) & (F.upper(F.trim(cell(SPEND_DIVISION))) == "FBS")
    found = F.filter(F.array(F.when(is_roster, roster), F.when(is_spend, spend)), lambda x: x["amount"].isNotNull())
    rows = tables.where("row > 0").select("page_id", "block", "row", cell(0).alias("team"), F.explode(found).alias("x"))
    last = F.max_by(F.struct("x.conference", "x.amount", "page_id"), F.struct("page_id", "block", "row")).alias("x")
    return rows.groupBy("x.route", "team").agg(last).select("route", "team", "x.*")
