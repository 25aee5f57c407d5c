"""HTML to Markdown as one Arrow-batched column function."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .parts import by_parts
from .text import image_refs

BLOCKS = {"p", "div", "section", "article", "header", "footer", "main"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Writer(HTMLParser):
    """Collects blocks of Markdown; ``cells`` is the table row being read, ``hidden`` the tag whose content is dropped."""

    def __init__(self, extra_cell: bool):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.lead = [], "", ""
        self.lists, self.table, self.cells, self.cell = [], None, None, ""
        self.hidden, self.pre, self.extra_cell = None, False, extra_cell

    def flush(self, lead: str = "") -> None:
        text = self.text if self.pre else re.sub(r"[ \t\r\f\v]+", " ", self.text).strip()
        if text.strip():
            self.out.append(self.lead + text)
        self.text, self.lead = "", lead

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag in ("script", "style"):
            self.hidden = tag
        elif re.fullmatch("h[1-6]", tag):
            self.flush("#" * int(tag[1]) + " ")
        elif tag in BLOCKS:
            self.flush()
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.flush("  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag == "blockquote":
            self.flush("> ")
        elif tag == "hr":
            self.flush()
            self.out.append("---")
        elif tag == "br":
            self.text += "\n"
        elif tag in MARKS:
            self.text += MARKS[tag]
        elif tag == "pre":
            self.flush()
            self.pre = True
        elif tag == "table":
            self.flush()
            self.table = []
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th"):
            self.cell = ""
        elif tag == "img":
            a = dict(attrs)
            self.text += f"![{a.get('alt') or ''}]({a.get('src') or ''})"

    def handle_endtag(self, tag):
        if self.hidden:
            self.hidden = None if tag == self.hidden else self.hidden
        elif re.fullmatch("h[1-6]|li|blockquote", tag) or tag in BLOCKS:
            self.flush()
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists = self.lists[:-1]
        elif tag in MARKS:
            self.text += MARKS[tag]
        elif tag == "pre":
            self.text = "```\n" + self.text.strip("\n") + "\n```"
            self.flush()
            self.pre = False
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(" ".join(self.cell.split()))
            self.cell = ""
        elif tag == "tr" and self.table is not None and self.cells is not None:
            self.table.append(self.cells + [""] * self.extra_cell)
            self.cells = None
        elif tag == "table" and self.table is not None:
            self.out += table_of(self.table)
            self.table = None

    def handle_data(self, data):
        if self.hidden:
            return
        if self.table is not None and self.cells is not None:
            self.cell += data
        else:
            self.text += data


def table_of(cells: list[list[str]]) -> list[str]:
    """Lines of a Markdown table whose first row is its header; short rows end in empty cells."""
    columns = max(map(len, cells), default=0)
    lines = []
    for number, row in enumerate(cells):
        full = [*row, *[""] * (columns - len(row))]
        lines.append(f"| {' | '.join(full)} |")
        if number == 0:
            lines.append("|" + " --- |" * columns)
    return lines


def to_markdown(html: str, extra_cell: bool = False) -> str:
    w = _Writer(extra_cell)
    w.feed(html)
    w.close()
    w.flush()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(w.out)).strip() + "\n"


def markdown_of(html: Column, extra_cell: bool = False) -> Column:
    """Markdown of an HTML column.  ``extra_cell`` ends each table row with an empty cell, for tables made that way before."""

    return by_parts(lambda pages: pa.array([None if t is None else to_markdown(t, extra_cell) for t in pages], pa.string()), "string", html)


def table_lines(markdown: Column) -> Column:
    """Number of lines that start a table row."""
    return F.size(F.split(markdown, r"\n\|", -1)) - 1


def metadata(path: Column, markdown: Column) -> Column:
    """struct<title, images, table_count>: the file's name without its ending, the images in order, the lines that start a
    table row."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.struct(stem.alias("title"), image_refs(markdown).alias("images"), table_lines(markdown).alias("table_count"))
