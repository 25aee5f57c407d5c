"""Parents and children: sections by headings, windows of tokens with sentence boundaries.

A text becomes its parents with their children in one Arrow pass, which counts
every token once; rows, ids and images are made of that by array functions.  A
token is a word, a CJK character or a mark.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.parts import by_parts
from ..functions.text import image_refs, stable_id, without_images

TOKEN = r"[一-鿿]|[^\W一-鿿]+|[^\w\s]"
#: Where a window may end, best first.
BOUNDARIES = ["。", "\n\n", "！", "\n", "？", "；", "，", "、", "  "]
CUT_MARK = " [表格截断]"


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("(?U)" + TOKEN), F.lit(0)))


_TOKEN, _IMAGE = re.compile(TOKEN), re.compile(r"!\[([^\]]*)\]\(([^)]*)\)")


def count(text: str) -> int:
    return len(_TOKEN.findall(text))


def _tables(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of table lines."""
    return [m.span() for m in re.finditer(r"(?m)(?:^[ \t]*\|.*(?:\n|\Z)){2,}", text)]


def _pieces_of_table(table: str, size: int) -> list[str]:
    """A table's rows in pieces of at most ``size`` tokens, each under the header; wider rows are cut."""
    lines = table.rstrip("\n").split("\n")
    head, rows = lines[:2], []
    room = max(8, size - count("\n".join(head)))
    for row in lines[2:]:
        spans = [m.span() for m in re.finditer(TOKEN, row)]
        rows += [row] if len(spans) <= room else [row[spans[i][0] : spans[min(i + room, len(spans)) - 1][1]] for i in range(0, len(spans), room)]
    out, own = [], []
    for row in rows:
        if own and count("\n".join([*own, row])) > room:
            out.append(own)
            own = []
        own.append(row)
    out.append(own)
    parts = ["\n".join([*head, *own]) for own in out if own or len(out) == 1]
    return [p + CUT_MARK for p in parts[:-1]] + parts[-1:]


def windows(text: str, size: int, overlap: int, lookback: int | None = None) -> list[str]:
    """Windows of at most ``size`` tokens that share ``overlap`` with the one before; a table at a window's start goes whole."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    back = overlap + 15 if lookback is None else lookback
    tables, out, at = _tables(text), [], 0
    starts = [s for s, _ in spans]

    while at < len(spans):
        table = next(((a, b) for a, b in tables if a <= starts[at] < b), None)
        if table:
            whole = text[starts[at] : table[1]].strip("\n")
            n = count(whole)
            out += [whole] if n <= size else _pieces_of_table(whole, size)
            at += n
            continue
        end = min(at + size, len(spans))
        stop = spans[end - 1][1]
        if end < len(spans):
            for reach, marks in ((back, "。！？"), (2 * back, "。！？"), (back, None)):
                low = spans[max(at + 1, end - reach)][0] if end - reach > at else spans[at][1]
                part = text[low:stop]
                places = [part.rfind(m) for m in marks] if marks else [next((p for p in (part.rfind(b) for b in BOUNDARIES) if p >= 0), -1)]
                if max(places) >= 0:
                    stop = low + max(places) + 1
                    break
            end = next((k for k in range(end, at, -1) if spans[k - 1][1] <= stop), at + 1)
        piece = text[starts[at] : max(stop, spans[end - 1][1])].strip()
        if piece:
            out.append(piece)
        if end >= len(spans):
            break
        at = max(at + 1, end - overlap)
    return out


def split(text: Column, size: Column | int, overlap: int, lookback: int | None = None) -> Column:
    """array<string> of a text's windows; ``size`` may differ by row."""

    def run(texts: list, sizes: list) -> pa.Array:
        return pa.array([[] if t is None else windows(t, int(n), overlap, lookback) for t, n in zip(texts, sizes)], pa.list_(pa.string()))

    return by_parts(run, "array<string>", text, size if isinstance(size, Column) else F.lit(size))


_COLON_TITLE = re.compile(r"(?m)^(\*\*[^*\n]+\*\*)[ ]*：")
_CHAPTER = re.compile(r"#\s|\s*- \*\*[^*]+\*\*\s*$")
_SECTION = re.compile(r"##\s|\s*\*\*\d+、[^*]+\*\*\s*$")


def section_list(text: str) -> list[tuple[str, str, str]]:
    """(prefix, title, body) of each section: one starts at each second-level heading or numbered bold line.

    The headings keep their marks.  The latest first-level heading leads the
    prefix of every section below it and makes none itself: its own text, and
    what stands before any heading, joins the next section.  Without any heading
    the whole text is one section without a title.
    """
    found, chapter, title, body = [], "", None, []
    text = _COLON_TITLE.sub(r"\1\n", text)
    for line in text.split("\n"):
        opens = "chapter" if _CHAPTER.match(line) else "section" if _SECTION.match(line) else None
        if opens is None:
            body.append(line)
            continue
        if title is not None:
            found.append((chapter, title, "\n".join(body).strip()))
            body = []
        title = line.strip()
        chapter = title if opens == "chapter" else chapter
    if title is None:
        return [("", "", text.strip())] if text.strip() else []
    found.append((chapter, title, "\n".join(body).strip()))
    out, waiting = [], []
    for chapter, title, body in found:
        if body:
            waiting.append(body)
        if title != chapter and waiting:
            out.append((f"{chapter}\n{title}" if chapter else title, title, "\n\n".join(waiting)))
            waiting = []
    return out


def sections(text: Column) -> Column:
    """array<struct<prefix, title, body>> of a text, in one Arrow pass."""

    kind = pa.list_(pa.struct([(c, pa.string()) for c in ("prefix", "title", "body")]))

    def run(texts: list) -> pa.Array:
        return pa.array([[] if t is None else [dict(zip(("prefix", "title", "body"), s)) for s in section_list(t)] for t in texts], kind)

    return by_parts(run, "array<struct<prefix:string,title:string,body:string>>", text)


def tree(text: str, size: int, overlap: int, parent_size: int, lookback: int | None, parent_lookback: int | None) -> list[dict]:
    """The parents of a text in order, each with its place, its headings and text, and its children."""
    out = []
    for section, (prefix, title, body) in enumerate(section_list(text)):
        lead = count(prefix)
        whole = lead + count(body) <= parent_size
        for part, block in enumerate([body] if whole else windows(body, max(1, parent_size - lead), 0, parent_lookback)):
            if not block.strip(" "):
                continue
            under = f"{prefix}\n" if prefix else ""
            pieces = windows(_IMAGE.sub("", block), max(1, size - lead), overlap, lookback)
            out.append({"section": section, "part": part, "title": title, "whole": under + block, "children": [{"content": under + p, "tokens": lead + count(p)} for p in pieces]})
    return out


TREE = "array<struct<section:int,part:int,title:string,whole:string,children:array<struct<content:string,tokens:int>>>>"
TREES = pa.list_(pa.struct([("section", pa.int32()), ("part", pa.int32()), ("title", pa.string()), ("whole", pa.string()), ("children", pa.list_(pa.struct([("content", pa.string()), ("tokens", pa.int32())])))]))


def chunk_tree(docs: DataFrame, size: int = 300, overlap: int = 40, parent_size: int = 2000, lookback: int | None = None, parent_lookback: int | None = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per child: key, parent_section, parent_part, parent_id, title, parent_content, images, chunk_index, content, tokens.

    A parent is a section, cut without overlap where it is over ``parent_size``
    with its headings; children are windows of its text without images.  Each
    stands under its headings, whose tokens come off both budgets.
    """

    def trees(texts: list) -> pa.Array:
        return pa.array([[] if t is None else tree(t, size, overlap, parent_size, lookback, parent_lookback) for t in texts], TREES)

    parents = docs.select(key, F.inline(by_parts(trees, TREE, F.col(text))))
    rows = parents.select(
        key, F.col("section").alias("parent_section"), F.col("part").alias("parent_part"), stable_id(F.col(key), F.col("section"), F.col("part")).alias("parent_id"), "title",
        without_images(F.col("whole")).alias("parent_content"), image_refs(F.col("whole")).alias("images"), F.posexplode("children").alias("chunk_index", "_c"),
    )
    return rows.select(*[c for c in rows.columns if c != "_c"], "_c.content", "_c.tokens")
