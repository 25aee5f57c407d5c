"""Whole texts before and after cleaning, for each rule, and the report of what was done."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import markdown

LONG = " ".join(f"word{i}" for i in range(20))  # 129 characters
SAID = "the beds are watered before noon "
TEXTS = {
    # numbered bold lines become headings, others stay
    "**3、Watering**\ntext": "## 3、Watering\ntext",
    "**3.** tail": "**3.** tail",
    "**12） Light and shade **": "## 12） Light and shade",
    f"**1、{LONG}**": f"**1、{LONG}**",
    "a **3、word** inside": "a **3、word** inside",
    # headings of noise or page numbers go, longer ones become text
    "# Thanks\n## table  of contents\nbody": "body",
    "## 07\n## 7\n## 12\n## 2024\n### PART 03\n### Page 4 - 5\nbody": "## 2024\nbody",
    f"# {LONG}": LONG,
    "## 这是一个看起来像标题但其实是完整句子的很长很长的一行文字。后面还有": "这是一个看起来像标题但其实是完整句子的很长很长的一行文字。后面还有",
    "## 短句。": "## 短句。",
    "#  \nbody\n###": "body",
    # failed recognition: strong marks, weak ones without a continuation, list items without their markers
    "土壤，，湿润\n# A": "# A",
    "土 壤 湿 润\n# A": "# A",
    "- 土 壤 湿 润": "",
    "土 壤 湿 润\n\n续长": "土壤湿润\n\n续长",
    "土壤， 湿润\n- item": "- item",
    "土 壤湿润。": "土壤湿润。",
    "土土 壤 ，，湿润。": "",
    "# 土 壤 湿 润": "# 土壤湿润",
    "好 ，，": "好，，",  # three characters are too few
    # spacing
    "H<sub>2</sub>O and x<SUP>2</SUP>": "H2O and x2",
    "# 水分， 充足 的 土壤。 很好": "# 水分，充足的土壤。很好",
    "zero​width soft­hyphen no break": "zerowidth softhyphen no break",
    "a  b   c\t\td": "a b c d",
    "| a  |  b |": "| a  |  b |",
    "  led  by": "  led by",
    # lines that hold a page number
    "7\nbody\n\nPAGE 3\n\n12 - 13\n\nPart 01\n\n页 5\n\n2024": "body\n\n\n\n\n\n2024",
    # wrapped lines
    "a soft\nwrapped line\n\nanother": "a soft wrapped line\n\nanother",
    "水分充足的，\n\n土壤。": "水分充足的，土壤。",
    "种子\n\n发芽": "种子\n\n发芽",  # under eight characters
    "水分充足的土壤！\n\n种子发芽": "水分充足的土壤！\n\n种子发芽",  # not the middle of a sentence
    "水分充足的土\n\n\n壤需要照料\n再来": "水分充足的土壤需要照料再来\n",
    "plain\n- item\n> quote\n<div>\n---\n| a |\n![](a.png)\nplain": "plain\n- item\n> quote\n<div>\n---\n| a |\n![](a.png)\nplain",
    # links
    "[t](http://a.b/c) and []() and [u](https://x.y) [v](w.md)": "t and  and u [v](w.md)",
    "![shot](https://a.b/c.png)": "![shot](https://a.b/c.png)",
    # repeated headings between pictures
    "## A\n![](a.png)\n## A\n![](b.png)": "## A\n![](a.png)\n![](b.png)",
    "## A\n<!-- image -->\nfew words\n## A\ncaption\n<!-- image -->\n## B": "## A\n<!-- image -->\nfew words\ncaption\n<!-- image -->\n## B",
    "## A\n![](a.png)\n## A\nits own body": "## A\n![](a.png)\n## A\nits own body",
    "## A\n![](a.png)\nfar more text than a gap may hold\n## A\n![](b.png)": "## A\n![](a.png)\nfar more text than a gap may hold\n## A\n![](b.png)",
    "## A\ntext\n## A\n![](b.png)": "## A\ntext\n## A\n![](b.png)",
    "## A\n![](a.png)\n## A\n短。\n![](b.png)": "## A\n![](a.png)\n## A\n短。\n![](b.png)",
    # numbered lines keep their numbers as list items
    "1、seeds\n2、roots": "- 1、seeds\n- 2、roots",
    "1. seeds\n\ntext\n\n2) roots\n\n3 stems": "- 1. seeds\n\ntext\n\n- 2) roots\n\n- 3 stems",
    "1、seeds\n" + "\n".join(f"- {c}" for c in "abcdefgh") + "\n2、roots": "1、seeds\n" + "\n".join(f"- {c}" for c in "abcdefgh") + "\n2、roots",
    "1、2、3\n4、5": "1、2、3\n4、5",
    "1、alone": "1、alone",
    # a title before a passage that is said twice
    f"03 Watering {SAID}{SAID}and once more before the evening comes, when it is cool": f"## Watering\n{SAID} and once more before the evening comes, when it is cool",
    f"03、 {SAID}{SAID}and once more before the evening comes, when it is cool outside": f"03、 {SAID} and once more before the evening comes, when it is cool outside",
    # identical neighbours, but not headings and images; a passage said twice in a line
    "- same\n- same\n\n- same": "- same\n\n- same",
    "## A\n## A\n![](a.png)\n![](a.png)": "## A\n## A\n![](a.png)\n![](a.png)",
    "- one\n  - one \n- one": "- one",
    f"- so {SAID}{SAID.upper()}end": f"- so {SAID} end",
    "- short short short": "- short short short",
    # marks before a line
    "·one\n••two\n  • three": "- one\n- two\n- three",
    "# A\n# B\n## C\n# D": "# A\n## B\n## C\n## D",
    # code is left alone, from its fence to the next
    "```\n# THANKS\n7\nsame\nsame\n·x\n```\n·y": "```\n# THANKS\n7\nsame\nsame\n·x\n```\n- y",
    "  ```py\na  b\n# 07": "  ```py\na  b\n# 07",
    "inline ``` mark\n·y": "inline ``` mark\n- y",
    "": "",
    "a\r\nb\r\n": "a b\n",
    "- a - b\n": "- a\n- b\n",
}


@pytest.fixture(scope="module")
def results(spark):
    rows = spark.createDataFrame([(t, 1) for t in TEXTS] + [(None, 1)], "t string, counts int").withColumnRenamed("counts", "Details")
    got = markdown.clean(rows.select("t"), "t", one_title=True, report=True).collect()
    assert markdown.clean(rows, "t").columns == ["t", "Details", "markdown"]
    return {r["t"]: r for r in got}


@pytest.mark.parametrize("text", TEXTS)
def test_whole_texts(results, text):
    assert results[text]["markdown"] == TEXTS[text]


def test_a_null_text(results):
    r = results[None]
    assert r["markdown"] is None and r["counts"] is None and r["details"] is None


def test_reports(results):
    """Counts by kind are those of the details; a text that stays has none."""
    for text, r in results.items():
        if text is not None:
            assert set(r["counts"]) == set(markdown.KINDS)
            assert Counter(d["kind"] for d in r["details"]) == {k: n for k, n in r["counts"].items() if n}
            assert bool(r["details"]) or r["markdown"] == re.sub("\r\n| ", "\n", text)
    assert {k for r in results.values() if r["counts"] for k, n in r["counts"].items() if n} == set(markdown.KINDS)
    assert [tuple(d) for d in results["7\nbody\n\nPAGE 3\n\n12 - 13\n\nPart 01\n\n页 5\n\n2024"]["details"]] == [("removed_page_residue", x) for x in ("7", "PAGE 3", "12 - 13", "Part 01", "页 5")]
    assert [tuple(d) for d in results["H<sub>2</sub>O and x<SUP>2</SUP>"]["details"]] == [("cleaned_inline_tags", "H<sub>2</sub>O and x<SUP>2</SUP>")]


def test_details_are_bounded(spark):
    rows = spark.createDataFrame([("\n".join(f"·{'x' * 300}{i}" for i in range(250)),)], "t string")
    r = markdown.clean(rows, "t", report=True).first()
    assert r["counts"]["normalized_list_bullets"] == 250 and len(r["details"]) == 200 and len(r["details"][0]["line"]) == 200


def test_merged_lines_end_at_a_length(spark):
    parts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    r = markdown.clean(spark.createDataFrame([("\n".join(parts),)], "t string"), "t").first()["markdown"].split("\n")
    assert " ".join(r) == " ".join(parts) and all(len(x) <= 600 for x in r) and all(len(a) + len(p) > 590 for a, p in zip(r, parts) if a != r[-1])


def test_options(spark):
    rows = spark.createDataFrame([("**1、Plan**\n·one\n# Appendix", True), ("# A\n# B", False), ("# A\n# B", None), ("# A\n# B", True)], "t string, deck boolean")
    one = lambda **k: markdown.clean(rows, "t", **k).first()["markdown"]
    assert one(layout=True, skip=["bullets"]) == "**1、Plan**\n·one\n# Appendix"
    assert one(noise=["appendix"]) == "## 1、Plan\n- one"
    assert [r["markdown"] for r in markdown.clean(rows, "t", one_title=F.col("deck")).collect()] == ["## 1、Plan\n- one\n# Appendix", "# A\n# B", "# A\n# B", "# A\n## B"]


def brute(text):
    """The longest passage that a text says twice in a row, by trying all."""
    norm = [(i, c.lower() if c.isascii() else c) for i, c in enumerate(text) if not c.isspace()]
    codes = "".join(c for _, c in norm)
    for k in range(min(120, len(codes) // 2), 13, -1):
        for s in range(len(codes) - 2 * k + 1):
            if codes[s : s + k] == codes[s + k : s + 2 * k]:
                return norm[s][0], norm[s + k][0], norm[s + 2 * k - 1][0] + 1
    return None


def test_passages_said_twice():
    random.seed(3)
    draw = lambda: "".join(random.choice("ab \t" if random.random() < 0.5 else "abcdefGH ") for _ in range(random.randint(0, 60)))
    lines = []
    for _ in range(400):
        a = draw()
        lines.append(draw() + a + random.choice(["", " ", "  ", "\t"]) + (a.upper() if random.random() < 0.3 else a) + "x" if random.random() < 0.5 else a)
    want = [brute(x) for x in lines]
    assert [markdown.said_twice(x) for x in lines] == want and sum(w is not None for w in want) > 50
    block, markdown.BLOCK = markdown.BLOCK, 500
    try:
        assert {i for i, w in enumerate(want) if w} <= markdown._may_repeat(lines)
    finally:
        markdown.BLOCK = block


def test_batches_give_what_texts_give(spark):
    """Lines of one text never meet those of the next."""
    texts = [t for t in TEXTS if t] * 2
    alone = [markdown.clean_texts([t], [False])[0][0] for t in texts]
    assert markdown.clean_texts(texts, [False] * len(texts))[0] == alone


def test_columns_without_nulls(spark):
    rows = spark.range(2).select(F.concat(F.lit("·a"), F.col("id").cast("string")).alias("t"))
    assert sorted(r["markdown"] for r in markdown.clean(rows.select(F.coalesce("t", F.lit("")).alias("t")), "t").collect()) == ["- a0", "- a1"]
    assert markdown.clean(rows.where("false"), "t", report=True).collect() == []
