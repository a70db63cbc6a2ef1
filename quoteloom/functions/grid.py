"""HTML table to rectangular grid: spans stay ranges, and Spark expands them."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A browser reads a larger colspan as this one.
MAX_ACROSS = 1000
#: A row of a table: runs of columns (from, to) that show one text.
RUNS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("c0", T.IntegerType()), T.StructField("c1", T.IntegerType()), T.StructField("text", T.StringType())])))


def _span(given: str | None) -> int:
    """Leading digits of a span attribute; 1 where there are none or they say nothing."""
    digits = re.match(r"\s*\+?(\d{1,9})", given or "")
    return max(1, int(digits[1])) if digits else 1


class _Cells(HTMLParser):
    """Collects, per ``tr``, the cells as (text pieces, rowspan, colspan)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self.rows.append([])
            self.depth = 0
        elif tag in ("td", "th") and self.rows:
            a = dict(attrs)
            self.rows[-1].append(([], _span(a.get("rowspan")), min(MAX_ACROSS, _span(a.get("colspan")))))
            self.depth = 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.depth = 0

    def handle_data(self, data: str) -> None:
        piece = data.strip()
        if self.depth and piece:
            self.rows[-1][-1][0].append(piece)


def html_runs(html: str) -> list[list[tuple[int, int, str]]]:
    """Per row the runs (first column, column behind the last, text) that make up its whole width; free places are empty runs.

    A sweep over the rows keeps what reaches into a row as runs sorted by column, apart from each other. A cell takes the first
    free column. Where it is wider than the free place it covers what comes from above, for as many rows as it has; what it
    covers shows again below it. A rowspan ends with the table.
    """
    parser = _Cells()
    parser.feed(html)
    rows: list[list[tuple[int, int, str]]] = []
    active: list[tuple[int, int, int, str]] = []  # from, to, row behind the last, text
    again: dict[int, list[tuple[int, int, int, str]]] = {}

    def hide(part: tuple[int, int, int, str], until: int) -> None:
        if part[0] < part[1] and part[2] > until:
            again.setdefault(until, []).append(part)

    for r, cells in enumerate(parser.rows):
        active = [x for x in active if x[2] > r]
        for a, b, until, text in again.pop(r, ()):
            # it shows in the gaps only; the rest waits for what lies over it to end
            k = max(0, bisect_left(active, (a,)) - 1)
            while a < b:
                while k < len(active) and active[k][1] <= a:
                    k += 1
                over = active[k] if k < len(active) and active[k][0] < b else None
                if over is not None and over[0] <= a:
                    hide((a, min(b, over[1]), until, text), over[2])
                    a = over[1]
                    continue
                end = b if over is None else over[0]
                insort(active, (a, end, until, text))
                a, k = end, k + 1
        c = k = 0
        for pieces, down, across in cells:
            while k < len(active) and active[k][0] <= c:
                c = max(c, active[k][1])
                k += 1
            end, until, at = c + across, r + down, k
            while at < len(active) and active[at][0] < end:
                a, b, below, text = active[at]
                hide((a, min(b, end), below, text), until)
                at += 1
            tail = [(end, *active[at - 1][1:])] if at > k and active[at - 1][1] > end else []
            active[k:at] = [(c, end, until, " ".join(pieces)), *tail]
            c, k = end, k + 1
        rows.append([(a, b, text) for a, b, _, text in active])
    width = max((row[-1][1] for row in rows if row), default=0)
    out = []
    for row in rows:
        line, c = [], 0
        for a, b, text in [*row, (width, width, "")]:
            if a > c:
                line.append((c, a, ""))
            if b > a:
                line.append((a, b, text))
            c = b
        out.append(line)
    return out


def html_grid(html: str) -> list[list[str]]:
    """Every cell repeated over the rows and columns it spans; missing places are empty."""
    return [[text for a, b, text in row for _ in range(b - a)] for row in html_runs(html)]


@F.pandas_udf(RUNS)
def html_runs_udf(html: pd.Series) -> pd.Series:
    return pd.Series([[[{"c0": a, "c1": b, "text": t} for a, b, t in row] for row in html_runs(h)] if h and "<tr" in h else None for h in html], dtype="object")


def grid_of(runs: Column) -> Column:
    """The rectangular grid of a table, as rows of texts."""
    return F.transform(runs, lambda row: F.flatten(F.transform(row, lambda x: F.array_repeat(x["text"], x["c1"] - x["c0"]))))
