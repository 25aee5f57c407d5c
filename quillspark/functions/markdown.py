"""Markdown cleaning over all lines of an Arrow batch at once.

The lines of a batch's texts lie in one array beside the number of their text.
A pass finds the lines that it may touch by matching patterns on the whole array,
looks closer at those alone, and drops or replaces lines; each change is noted
with its kind, so the report comes from the same pass as the text.  Lines of code
fences, and what stands between them, are never touched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .parts import by_parts

#: Headings that carry nothing.
NOISE = ["THANKS", "BUSINESS", "CONTENTS", "TABLE OF CONTENTS", "目录", "01", "02", "03", "04", "05", "06", "07", "08", "09", "10"]
#: The longest heading, and the length from which sentence marks make one a sentence.
HEADING_CHARS, SENTENCE_CHARS = 120, 30
#: Bounds of garbage, of a merged line, of two parts of a broken sentence, of a list item, of a line that is split and of its body, of a passage said twice.
GARBAGE_CHARS, MERGED_CHARS, BROKEN_CHARS, ITEM_CHARS, PAGED_CHARS, PAGED_BODY, PASSAGE_CHARS = (4, 48), 600, 8, 360, 100, 20, (14, 120)
#: For repeated headings, how far apart, how many lines of body, and how much text lies between and below.
REPEAT_LINES, REPEAT_BODY, GAP_CHARS, BODY_CHARS = 16, 30, 20, 30
#: How near another numbered line must be, and what a report keeps of its edits.
NEAR_LINES, DETAILS, DETAIL_CHARS = 8, 200, 200
#: The kinds of edits.
KINDS = [
    "converted_bold_headings", "demoted_heading_lines", "removed_noise_headings", "removed_empty_headings", "merged_repeated_headings", "demoted_h1_after_first", "removed_page_residue",
    "removed_ocr_garbage_fragments", "split_paged_long_lines", "converted_numbered_bodies", "removed_repeated_paragraph_text", "normalized_ocr_spacing", "cleaned_inline_tags",
    "normalized_list_bullets", "merged_soft_wraps", "merged_broken_sentences", "removed_invisible_chars", "collapsed_whitespace", "cleaned_link_markup",
]
#: Character classes and patterns.
_HAN, _HAN_OR_MARK, _WIDE = "⺀-鿿", "⺀-鿿　-〿", "⺀-鿿　-〿＀-￯"
_HEADING, _EMPTY_HEADING = r"^#{1,6}\s+(.*)$", r"^#{1,6}\s*$"
_BOLD_TITLE = r"^\s*\*\*(\d+[、.．)）]+\s*[^*]+?)\*\*\s*$"
_IMAGE_LINE, _IMAGE = r"(?i)^\s*(?:<!--\s*image\s*-->|!\[[^\]]*\]\([^)]*\))\s*$", r"!\[[^\]]*\]\([^)]*\)"
_PAGE = r"(?i)^\s*(?:(?:PART|PAGE|页)\s*)?0?\d{1,3}(?:\s*[-–]\s*\d{1,3})?\s*$"
_TABLE, _QUOTE, _TAG, _RULE = r"^\s*\|.*\|\s*$", r"^\s*>\s?", r"^\s*</?[a-zA-Z][^>]*>\s*$", r"^\s*[-*_](?:[-*_]\s*){2,}$"
_ITEM, _BULLET, _MARKER = r"^\s*(?:[-*+]\s+|[·•]{1,4}\s+|\d{1,3}(?:[、.．）)]|\s)\s*\S)", r"^\s*[·•]{1,4}\s*", r"^\s*(?:[-*+]\s+|·•{1,4}\s+)"
_NUMBERED = [r"^\s*\d{1,2}[、.．)）]\s+(\S.*?)\s*$", r"^\s*\d{1,2}\s+(\S.*?)\s*$", r"^\s*\d{1,2}([^\d\s].*?)\s*$"]
_NUMBER, _ONLY_MARKS = r"^\s*\d{1,3}[.、．)）]?\s*", r"[\d\s.,;:，。；：、]+"
_GAP = rf"(?<=[{_WIDE}])\s+(?=[{_WIDE}])"
_SUB_SUP, _INVISIBLE, _SPACES = r"(?i)</?(?:sub|sup)>", "[​‌‍­]", r"(?<=\S)[ \t]{2,}(?=\S)"
_LINK, _EMPTY_LINK = r"(?<!!)\[([^\]]*)\]\(https?://[^)\s]+\)", r"(?<!!)\[\]\(\)"
_DOUBLED_MARK, _DOUBLED_HAN, _ENDED = r"([，。；：、！？])\1", rf"([{_HAN}])\1", r"[。！？…]\s*$"
_BROKEN_END, _SENTENCE_END = rf"[{_HAN}，、：；％%]$", "[。；;]"
#: Characters searched for passages at once.
BLOCK = 1 << 18

_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def _wide(pattern: str) -> str:
    """A pattern for Arrow, whose white space and digits are ASCII, with the wider ones."""
    return pattern.replace(r"[^\d\s]", rf"[^\p{{Nd}}{_SPACE}]").replace(r"[^)\s]", rf"[^){_SPACE}]").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]").replace(r"\d", r"\p{Nd}")


class Lines:
    """The lines of some texts, what became of them so far, and the edits."""

    def __init__(self, texts: list[str], report: bool = True):
        lists = [re.split(_BREAKS, t) for t in texts]
        self.n, self.text = len(texts), pa.array([x for own in lists for x in own], pa.string())
        self.doc = np.repeat(np.arange(self.n), [len(x) for x in lists])
        fence = self.has(r"^\s*```")
        before = np.cumsum(fence) - fence
        first = np.r_[0, np.cumsum([len(x) for x in lists])[:-1]] if self.n else np.zeros(0, int)
        inside = (before - before[first][self.doc]) % 2 == 1 if len(fence) else fence
        self.code = fence | inside
        #: (kind, text, line) of each edit, in order
        self.edits: list[tuple[str, int, str]] = []
        self.report = report

    def has(self, pattern: str) -> np.ndarray:
        return pc.match_substring_regex(self.text, _wide(pattern)).to_numpy(zero_copy_only=False) if len(self.text) else np.zeros(0, bool)

    def free(self, pattern: str) -> np.ndarray:
        """Lines outside code that match."""
        return self.has(pattern) & ~self.code

    def at(self, places: Iterable[int]) -> list[tuple[int, str]]:
        places = np.asarray(places, np.int64)
        return list(zip(places.tolist(), self.text.take(pa.array(places)).to_pylist()))

    def note(self, kind: str, i: int, line: str) -> None:
        if self.report:
            self.edits.append((kind, int(self.doc[i]), line))

    def put(self, new: dict[int, str]) -> None:
        """Replace lines by place."""
        if new:
            mask = np.zeros(len(self.text), bool)
            mask[list(new)] = True
            self.text = pc.replace_with_mask(self.text, pa.array(mask), pa.array([new[i] for i in sorted(new)], pa.string()))

    def keep(self, stays: np.ndarray) -> None:
        if not stays.all():
            self.text, self.doc, self.code = self.text.filter(pa.array(stays)), self.doc[stays], self.code[stays]

    def drop(self, kind: str, gone: np.ndarray) -> None:
        for i, x in self.at(np.flatnonzero(gone)):
            self.note(kind, i, x)
        self.keep(~gone)

    def change(self, kind: str, places: Iterable[int], by: Callable[[str], str | None]) -> None:
        """Replace those of the lines for which ``by`` gives another one."""
        new = {}
        for i, x in self.at(places):
            y = by(x)
            if y is not None and y != x:
                self.note(kind, i, x)
                new[i] = y
        self.put(new)

    def texts(self) -> list[str]:
        cuts = np.searchsorted(self.doc, np.arange(self.n + 1)).tolist()
        lines = self.text.to_pylist()
        return ["\n".join(lines[a:b]) for a, b in zip(cuts, cuts[1:])]


def _title(line: str) -> str:
    return line.lstrip("#").strip()


def bold_headings(x: Lines, **_) -> None:
    """A whole bold line with a numbered title becomes a second-level heading."""

    def by(line: str) -> str | None:
        title = re.match(_BOLD_TITLE, line).group(1).strip()
        return f"## {title}" if len(title) <= HEADING_CHARS else None

    x.change("converted_bold_headings", np.flatnonzero(x.free(_BOLD_TITLE)), by)


def junk_headings(x: Lines, noise: Iterable[str] = NOISE, **_) -> None:
    """Headings of noise or page numbers go; very long ones, and longer ones with sentence marks, become text."""
    dense = {re.sub(r"\s+", "", n).upper() for n in noise if n}
    gone, text = np.zeros(len(x.text), bool), []
    for i, line in x.at(np.flatnonzero(x.free(_HEADING))):
        title = _title(line)
        bare = re.sub(r"\s+", "", title).upper()
        if bare in dense or re.fullmatch(r"0?\d{1,2}", bare) or re.match(_PAGE, title):
            gone[i] = True
            x.note("removed_noise_headings", i, line)
        elif len(title) > HEADING_CHARS or (len(title) >= SENTENCE_CHARS and re.search(_SENTENCE_END, title)):
            text.append(i)
    x.change("demoted_heading_lines", text, _title)
    x.keep(~gone)


def empty_headings(x: Lines, **_) -> None:
    x.drop("removed_empty_headings", x.free(_EMPTY_HEADING))


def recognition_garbage(x: Lines, **_) -> None:
    """Short lines that look like failed character recognition go: doubled marks, or characters torn apart by gaps.  A list
    item is judged without its marker; a torn line stays if the next one goes on in the same script."""
    torn = x.has(rf"[{_WIDE}]\s+[{_WIDE}]") | x.has("|".join(rf"{m}\s*{m}" for m in "，。；：、！？")) | ((x.has(_SUB_SUP) | x.has(_INVISIBLE)) & x.has(f"[{_HAN}，。；：、！？]"))
    other = x.has(_HEADING) | x.has(_IMAGE_LINE) | x.has(_IMAGE) | x.has(_TABLE) | x.has(_QUOTE) | x.has(_TAG) | x.has(_RULE)
    places = np.flatnonzero(torn & ~other & ~x.code)
    if not len(places):
        return
    blank, starts = x.has(r"^\s*$"), x.has(rf"^\s*[{_HAN_OR_MARK}]") & ~x.has(_HEADING) & ~x.has(_IMAGE_LINE) & ~x.has(_TABLE) & ~x.has(_ITEM) & ~x.has(_QUOTE) & ~x.has(_TAG) & ~x.has(_RULE)
    filled = np.flatnonzero(~blank)
    gone = np.zeros(len(blank), bool)
    for i, line in x.at(places):
        content = re.sub(_MARKER, "", line.strip(), count=1)
        gaps = len(re.findall(_GAP, content))
        compact = re.sub(r"\s+", "", re.sub(_INVISIBLE, "", re.sub(_SUB_SUP, "", content)))
        if not GARBAGE_CHARS[0] <= len(compact) <= GARBAGE_CHARS[1]:
            continue
        strong = bool(re.search(_DOUBLED_MARK, compact)) or (bool(re.search(_DOUBLED_HAN, compact)) and gaps >= 1)
        if re.search(_ENDED, compact):
            gone[i] = strong and gaps >= 2
            continue
        after = np.searchsorted(filled, i, "right")
        goes_on = after < len(filled) and x.doc[filled[after]] == x.doc[i] and starts[filled[after]]
        gone[i] = strong or ((gaps >= 2 or ("，" in compact and gaps == 1)) and not goes_on)
    x.drop("removed_ocr_garbage_fragments", gone)


def spacing(x: Lines, **_) -> None:
    """Sub- and superscript tags, gaps between wide characters, zero-width characters and odd spaces, repeated spaces."""

    def free(pattern: str) -> np.ndarray:
        return np.flatnonzero(x.free(pattern) & ~x.has(_IMAGE_LINE))

    x.change("cleaned_inline_tags", free(_SUB_SUP), lambda s: re.sub(_SUB_SUP, "", s))
    x.change("normalized_ocr_spacing", free(rf"[{_WIDE}]\s+[{_WIDE}]"), lambda s: re.sub(_GAP, "", s))
    x.change("removed_invisible_chars", free("[​‌‍­ 　]"), lambda s: re.sub("[ 　]", " ", re.sub(_INVISIBLE, "", s)))
    x.change("collapsed_whitespace", np.flatnonzero(x.free(r"\S[ \t]{2,}\S") & ~x.has(_IMAGE_LINE) & ~x.has(_TABLE)), lambda s: re.sub(_SPACES, " ", s))


def page_residue(x: Lines, **_) -> None:
    """Lines that hold a page number alone go."""
    x.drop("removed_page_residue", x.free(_PAGE) & ~x.has(_HEADING) & ~x.has(_IMAGE_LINE))


def _alone(x: Lines) -> np.ndarray:
    """Lines that are never joined to others."""
    return x.code | x.has("|".join(f"(?:{p})" for p in (_HEADING, _IMAGE, _TABLE, _BULLET, _ITEM, _QUOTE, _TAG, _RULE))) | x.has(_IMAGE_LINE)


def wrapped_lines(x: Lines, **_) -> None:
    """Neighbouring plain lines become one, up to MERGED_CHARS characters, without a space between wide characters; over blank
    lines only where a sentence was cut between wide characters.  Of identical neighbours one stays."""
    blank = x.has(r"^\s*$") & ~x.code
    plain = ~blank & ~_alone(x)
    # only where the line before, blank ones aside, is a plain one of the same text
    filled = np.flatnonzero(~blank)
    joins = np.flatnonzero(plain[filled[1:]] & plain[filled[:-1]] & (x.doc[filled[1:]] == x.doc[filled[:-1]])) + 1
    if not len(joins):
        return
    lines, stays = x.text.to_pylist(), np.ones(len(blank), bool)
    new: dict[int, list[str]] = {}
    size: dict[int, int] = {}
    head, last = -1, -1
    for k in joins.tolist():
        before, i = int(filled[k - 1]), int(filled[k])
        if before != last:
            head = before
        last, line = i, lines[i]
        own, gap = line.strip(), i - before > 1
        if not gap and line == lines[before]:
            stays[i] = False
            x.note("removed_repeated_paragraph_text", i, line)
            continue
        end = lines[before].rstrip()
        total = size.get(head, len(lines[head].strip())) + len(own)
        if total > MERGED_CHARS or (gap and not (total >= BROKEN_CHARS and re.search(_BROKEN_END, end) and re.match(f"[{_HAN_OR_MARK}]", own))):
            head = i
            continue
        between = "" if re.match(f"[{_WIDE}]", end[-1:]) and re.match(f"[{_HAN_OR_MARK}]", own) else " "
        parts = new.setdefault(head, [lines[head]])
        parts[-1] = parts[-1].rstrip()
        parts += [between, line.lstrip()]
        size[head] = total + len(between)
        stays[i] = False
        if gap:
            stays[before + 1] = False
        x.note("merged_broken_sentences" if gap else "merged_soft_wraps", i, line)
    x.put({i: "".join(p) for i, p in new.items()})
    x.keep(stays)


def external_links(x: Lines, **_) -> None:
    """Links to the web leave their text; empty links go."""
    x.change("cleaned_link_markup", np.flatnonzero(x.free(r"\]\(https?://|\[\]\(\)")), lambda s: re.sub(_EMPTY_LINK, "", re.sub(_LINK, lambda m: m.group(1).strip(), s)))


def repeated_headings(x: Lines, **_) -> None:
    """A heading goes where the same one stands within REPEAT_LINES lines above, only images and little text lie between, and
    its own body has an image and little text without an end of a sentence."""
    places = np.flatnonzero(x.free(_HEADING))
    titles = [_title(line) for _, line in x.at(places)]
    gone = np.zeros(len(x.text), bool)
    picture = x.has(_IMAGE_LINE)

    def seen(a: int, b: int) -> str:
        return "".join(re.sub(_IMAGE, "", line).strip() for i, line in x.at(range(a, b)) if not picture[i])

    for k, (i, title) in enumerate(zip(places.tolist(), titles)):
        for m in range(k + 1, len(places)):
            j = int(places[m])
            if j - i > REPEAT_LINES or x.doc[j] != x.doc[i]:
                break
            if gone[j] or titles[m] != title or not title:
                continue
            end = int(places[m + 1]) if m + 1 < len(places) else len(x.text)
            end = min(end, j + 1 + REPEAT_BODY, int(np.searchsorted(x.doc, x.doc[j], "right")))
            body = seen(j + 1, end)
            if picture[i + 1 : j].any() and picture[j + 1 : end].any() and len(seen(i + 1, j)) <= GAP_CHARS and len(body) <= BODY_CHARS and not re.search(_SENTENCE_END, body):
                gone[j] = True
                x.note("merged_repeated_headings", j, x.text[j].as_py())
            break
    x.keep(~gone)


def _number_body(line: str) -> str | None:
    """What follows the number of a numbered line."""
    found = next((m for m in (re.match(p, line) for p in _NUMBERED) if m), None)
    return found.group(1) if found else None


def numbered_lists(x: Lines, **_) -> None:
    """Numbered lines become list items, number and all, where another one stands within NEAR_LINES lines."""
    places = []
    for i, line in x.at(np.flatnonzero(x.free(r"^\s*\d{1,2}(?:\s+\S|[^\d\s])") & ~x.has(_HEADING) & ~x.has(_IMAGE_LINE))):
        body = _number_body(line)
        if body is not None and len(body) <= ITEM_CHARS and not re.fullmatch(_ONLY_MARKS, body):
            places.append(i)
    p = np.array(places, np.int64)
    near = (np.diff(p) <= NEAR_LINES) & (x.doc[p[1:]] == x.doc[p[:-1]])
    x.change("converted_numbered_bodies", p[np.r_[near, False] | np.r_[False, near]] if len(p) else p, lambda s: f"- {s.strip()}")


def said_twice(text: str) -> tuple[int, int, int] | None:
    """(start of a passage, start and end of its repeat) where a text says a passage twice in a row: the longest one of
    PASSAGE_CHARS characters, then the first; white space and the case of ASCII letters don't count."""
    places = np.array([i for i, c in enumerate(text) if not c.isspace()], np.int64)
    codes = np.array([ord(c.lower() if c.isascii() else c) for c in text if not c.isspace()], np.uint32)
    for k in range(min(PASSAGE_CHARS[1], len(codes) // 2), PASSAGE_CHARS[0] - 1, -1):
        same = np.r_[0, np.cumsum(codes[k:] == codes[:-k])]
        found = np.flatnonzero(same[k:] - same[:-k] == k)
        if len(found):
            s = int(found[0])
            return int(places[s]), int(places[s + k]), int(places[s + 2 * k - 1]) + 1
    return None


def _may_repeat(lines: list[str]) -> set[int]:
    """Numbers of the lines that say a passage twice in a row, found for all lines at once: such a line agrees with itself,
    moved by the passage's length, over that length."""
    found: set[int] = set()
    start = 0
    while start < len(lines):
        end, size = start, 0
        while end < len(lines) and (end == start or size < BLOCK):
            size, end = size + len(lines[end]) + 1, end + 1
        bare = ["".join(x.split()) for x in lines[start:end]]
        codes = np.frombuffer("\n".join(bare).encode("utf-32-le"), np.uint32).copy()
        upper = (codes >= 65) & (codes <= 90)
        codes[upper] += 32
        ends = np.flatnonzero(codes == 10)
        codes[ends] = 0x110000 + np.arange(len(ends))  # no line end is like another
        for k in range(PASSAGE_CHARS[0], min(PASSAGE_CHARS[1], len(codes) // 2) + 1):
            run, width = codes[k:] == codes[:-k], 1
            while width < k and len(run):
                step = min(width, k - width)
                run, width = run[:-step] & run[step:], width + step
            found.update((start + np.searchsorted(ends, np.flatnonzero(run))).tolist())
        start = end
    return found


def paged_lines(x: Lines, **_) -> None:
    """A long numbered line in which a title is followed by a passage said twice becomes a heading and one body."""
    long = pc.greater_equal(pc.utf8_length(x.text), PAGED_CHARS).to_numpy(zero_copy_only=False) if len(x.text) else np.zeros(0, bool)
    new: dict[int, str] = {}
    for i, line in x.at(np.flatnonzero(long & x.free(r"^(?:#{1,6}\s+)?\s*\d{1,2}[、.．)）]?\s+\S") & ~x.has(_IMAGE_LINE))):
        content = _title(line) if re.match(_HEADING, line) else line
        if len(content) < PAGED_CHARS or not (re.match(_NUMBERED[1], content) or re.match(_NUMBERED[0], content)):
            continue
        found = said_twice(content)
        if not found or not content[: found[0]].strip():
            continue
        title, body = re.sub(_NUMBER, "", content[: found[0]]).strip(), (content[found[0] : found[1]] + content[found[2] :]).strip()
        if title and len(title) <= HEADING_CHARS and not re.search(_SENTENCE_END, title) and not re.fullmatch(r"[\d\s]+", title) and len(body) >= PAGED_BODY:
            x.note("split_paged_long_lines", i, line)
            new[i] = f"## {title}\n{body}"
    if new:
        x.put(new)
        halves = pc.split_pattern(x.text, "\n")
        times = halves.value_lengths().to_numpy()
        x.text, x.doc, x.code = halves.flatten(), np.repeat(x.doc, times), np.repeat(x.code, times)


def repeated_text(x: Lines, **_) -> None:
    """Of identical neighbouring lines one stays, and a passage said twice in a row within a line is said once; headings,
    images, blank lines and code are exempt."""
    other = x.code | x.has(_HEADING) | x.has(_IMAGE_LINE) | x.has(r"^\s*$")
    lines = x.text.to_pylist()
    open_ = np.flatnonzero(~other)
    twice = {int(open_[k]) for k in _may_repeat([lines[i] for i in open_])}
    gone, new, before, body = np.zeros(len(lines), bool), {}, -2, None
    for i in open_.tolist():
        line = lines[i]
        own = line.strip()
        if before == i - 1 and x.doc[i] == x.doc[i - 1] and own == body:
            gone[i], before = True, i
            x.note("removed_repeated_paragraph_text", i, line)
            continue
        found = said_twice(line) if i in twice else None
        if found:
            new[i] = line[: found[1]] + line[found[2] :]
            x.note("removed_repeated_paragraph_text", i, line)
            own = new[i].strip()
        before, body = i, own
    x.put(new)
    x.keep(~gone)


def bullets(x: Lines, **_) -> None:
    """Marks before a line become a list item."""
    x.change("normalized_list_bullets", np.flatnonzero(x.free(_BULLET) & ~x.has(_HEADING)), lambda s: re.sub(_BULLET, "- ", s, count=1))


def single_title(x: Lines, one_title: np.ndarray, **_) -> None:
    """First-level headings after the first go down a level, in texts for which it is wanted."""
    places = np.flatnonzero(x.free(r"^#\s+.*$"))
    places = places[one_title[x.doc[places]]]
    later = np.r_[False, x.doc[places[1:]] == x.doc[places[:-1]]] if len(places) else np.zeros(0, bool)
    x.change("demoted_h1_after_first", places[later], lambda s: f"## {_title(s)}")


#: The passes in order.
PASSES = [
    bold_headings, junk_headings, empty_headings, recognition_garbage, spacing, page_residue, wrapped_lines, external_links, repeated_headings, numbered_lists, paged_lines, repeated_text, bullets, single_title,
]
RESULT = pa.struct([("markdown", pa.string()), ("counts", pa.map_(pa.string(), pa.int64())), ("details", pa.list_(pa.struct([("kind", pa.string()), ("line", pa.string())])))])
REPORT = "markdown string, counts map<string, bigint>, details array<struct<kind: string, line: string>>"


def clean_texts(texts: list[str], one_title: list[bool], skip: Iterable[str] = (), noise: Iterable[str] = NOISE, report: bool = True) -> tuple[list[str], list[dict[str, int]], list[list[dict]]]:
    """The cleaned texts, the number of edits of each kind, and the first DETAILS edits; without ``report`` no edits are kept."""
    x = Lines(texts, report)
    for f in PASSES:
        if f.__name__ not in skip:
            f(x, noise=noise, one_title=np.array(one_title, bool))
    counts, details = [dict.fromkeys(KINDS, 0) for _ in texts], [[] for _ in texts]
    for kind, doc, line in x.edits:
        counts[doc][kind] += 1
        if len(details[doc]) < DETAILS:
            details[doc].append({"kind": kind, "line": line[:DETAIL_CHARS]})
    return x.texts(), counts, details


def cleaned(text: Column, one_title: Column | bool = False, skip: Iterable[str] = (), layout: bool = False, noise: Iterable[str] = NOISE, report: bool = True) -> Column:
    """struct<markdown, counts, details> of a text, or the Markdown alone without ``report``; a null text gives null.

    ``one_title`` also leaves one first-level heading; ``skip`` names passes to
    leave out; with ``layout`` bold lines stay, as headings come from boxes;
    ``noise`` lists headings that go.  Line breaks of any kind become plain ones.
    """
    left_out, listed = {*skip, *(["bold_headings"] if layout else [])}, list(noise)

    def run(own: list, one: list) -> pa.Array:
        some = [i for i, t in enumerate(own) if t is not None]
        got = zip(*clean_texts([own[i] for i in some], [bool(one[i]) for i in some], left_out, listed, report))
        rows: list = [None] * len(own)
        for i, (t, counts, details) in zip(some, got):
            rows[i] = {"markdown": t, "counts": list(counts.items()), "details": details} if report else t
        return pa.array(rows, RESULT if report else pa.string())

    return by_parts(run, f"struct<{REPORT}>" if report else "string", text, F.lit(one_title) if isinstance(one_title, bool) else F.coalesce(one_title, F.lit(False)))


def clean(rows: DataFrame, text: str, one_title: Column | bool = False, skip: Iterable[str] = (), layout: bool = False, noise: Iterable[str] = NOISE, report: bool = False) -> DataFrame:
    """``rows`` with ``markdown``, the column ``text`` after all passes, and with ``report`` also ``counts`` and ``details``."""
    done = cleaned(F.col(text), one_title, skip, layout, noise, report)
    if not report:
        return rows.withColumn("markdown", done)
    return rows.withColumn("_clean", done).select(*rows.columns, "_clean.*")
