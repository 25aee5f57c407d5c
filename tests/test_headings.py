"""Whole texts with their layouts: levels, decorative headings, and the forms a layout comes in."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import headings


def box(title, page, width, height=10.0, x0=0.0, **more):
    return {"type": "title", "text": title, "page_idx": page, "bbox": [x0, 0.0, x0 + width, height], **more}


def repaired(spark, text, payload, **how):
    docs = spark.createDataFrame([(1, text, payload if isinstance(payload, str) or payload is None else json.dumps(payload))], "doc_id long, text string, layout string")
    r = headings.repair(docs, **how).first()
    return r["markdown"], r["hierarchy"].asDict()


TEXT = "# Guide\n\nwords\n\n## Authors\n\n# Growing\n\ntext\n\n# Soil\n\n# Water\nlast\n"
BLOCKS = [box("Guide", 0, 90), box("Authors", 0, 95), box("Growing", 1, 60), box("Soil", 1, 20), box("Water!", 1, 20), {"type": "text", "text": "words", "page_idx": 0}]
WANT = "# Guide\n\nwords\n\n## Authors\n\n## Growing\n\ntext\n\n### Soil\n\n### Water\nlast\n"


@pytest.mark.parametrize("payload", [BLOCKS, {"content_list": BLOCKS}, {"pdf_info": BLOCKS}, {"content_list": [], "pdf_info": BLOCKS}, json.dumps(BLOCKS)])
def test_payload_forms(spark, payload):
    text, report = repaired(spark, TEXT, payload)
    assert text == WANT
    assert report == {"layout_title_count": 5, "markdown_heading_count": 5, "matched_headings": 5, "adjusted_levels": 3, "removed_decorative": 0}


@pytest.mark.parametrize("payload", [None, "", "not json", "7", "{}", "[]", '{"content_list": {"a": 1}}', '[1, "x", null]', '[{"type": "title", "text": "Growing"}]', '[{"type": "title", "text": "Growing", "bbox": [1, 2]}]'])
def test_without_titles_nothing_changes(spark, payload):
    assert repaired(spark, TEXT, payload)[0] == TEXT


def test_block_fields(spark):
    """Titles by level instead of type, text and bounds under other names, pages that lack a number."""
    blocks = [{"text_level": 1, "content": " Growing ", "box": [0, 0, 50, 10]}, {"text_level": 0, "text": "Soil", "bbox": [0, 0, 50, 10]}, {"type": "title", "text": "", "content": "Guide", "bbox": ["0", 0, 60, 10, 7]}]
    docs = spark.createDataFrame([(json.dumps(blocks),)], "j string").select(F.inline(headings.layout_items(F.col("j"))))
    assert [tuple(r) for r in docs.collect()] == [("Growing", True, 0, 0.0, 0.0, 50.0, 10.0), ("Soil", False, 0, 0.0, 0.0, 50.0, 10.0), ("Guide", True, 0, 0.0, 0.0, 60.0, 10.0)]


def levels(spark, lines, blocks, **how):
    """The new lines of a text of headings."""
    return repaired(spark, "\n".join(lines), blocks, **how)[0].split("\n")


def test_the_first_heading_leads(spark):
    # unmatched, it is level 1 all the same, and no other title of the first page is
    assert levels(spark, ["## Cover", "# Sub", "## Part"], [box("Sub", 0, 90), box("Part", 0, 20)]) == ["# Cover", "## Sub", "## Part"]
    # matched on a later page, it has that page's level
    assert levels(spark, ["# Late", "# Early"], [box("Late", 3, 50), box("Early", 1, 50)]) == ["## Late", "## Early"]


def test_other_unmatched_headings_stay(spark):
    assert levels(spark, ["# A title", "# Lost", "#### Deep"], [box("A title", 0, 90)]) == ["# A title", "# Lost", "#### Deep"]
    long = "x" * 121
    assert levels(spark, ["# A title", f"# {long}"], [box("A title", 0, 90), box(long, 1, 50)]) == ["# A title", f"# {long}"]


def test_leaders_grids_and_others(spark):
    cover = [box("Cover", 0, 90)]
    page = lambda *widths: [box(f"Part {chr(97 + i)}", 1, w) for i, w in enumerate(widths)]
    lines = lambda n, mark="####": ["# Cover", *[f"{mark} Part {chr(97 + i)}" for i in range(n)]]
    assert levels(spark, lines(1), cover + page(30)) == ["# Cover", "## Part a"]  # alone on its page
    assert levels(spark, lines(3), cover + page(50, 40, 10)) == ["# Cover", "## Part a", "### Part b", "### Part c"]  # 1.25 times as large
    assert levels(spark, lines(4), cover + page(49, 40, 40, 40)) == ["# Cover", *["### " + x[5:] for x in lines(4)[1:]]]
    assert levels(spark, lines(3, "#"), cover + page(49, 40, 40)) == ["# Cover", *["## " + x[2:] for x in lines(3, "#")[1:]]]
    assert levels(spark, lines(3, "####"), cover + page(49, 40, 40)) == ["# Cover", *["### " + x[5:] for x in lines(3)[1:]]]  # their own level, three at most
    assert levels(spark, lines(3), cover + page(49, 40, 40), most_levels=5) == ["# Cover", *lines(3)[1:]]


def test_chapters(spark):
    """A lone title after a numbered page is a sub-page, but on the last page and on numbered ones; a numbered page may hold
    several titles, and its number may be a block that is no title."""
    lines = ["# Cover", "# One", "# Two", "# Alone", "# Next", "# Also", "# End"]
    blocks = [box("Cover", 0, 90), {"type": "text", "text": "01", "page_idx": 1}, box("One", 1, 50), box("Two", 1, 30), box("Alone", 2, 30), {"type": "text", "text": "02 Next", "page_idx": 3}, box("Next", 3, 30), box("Also", 4, 30), box("End", 5, 30)]
    assert levels(spark, lines, blocks) == ["# Cover", "## One", "### Two", "### Alone", "## Next", "### Also", "## End"]


def test_decorative_headings(spark):
    lines = ["# Cover", "## 01", "# THANKS", "# Part 2", "text", "# 2024"]
    text, report = repaired(spark, "\n".join(lines), [box("Cover", 0, 90), box("01", 1, 20)])
    assert text.split("\n") == ["# Cover", "", "", "", "text", "# 2024"] and report["removed_decorative"] == 3
    # where no heading matches, those that match nothing stay
    assert levels(spark, ["# 01", "# Else"], [box("Cover", 0, 90)]) == ["# 01", "# Else"]


def test_spellings(spark):
    blocks = [box("Cover", 0, 90), box("A Long Title, in full", 1, 50), box("same", 2, 50), box("Same", 1, 20), box("!!!", 1, 99), box("y" * 201, 1, 99)]
    got = levels(spark, ["# Cover", "# Long  title", "# S-a-m-e", "# ---"], blocks)
    assert got == ["# Cover", "## Long  title", "### S-a-m-e", "# ---"]  # the later of equal titles counts; a title of marks matches nothing


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "[]", "x"), (2, "", None, "x"), (3, "a\r\n# b ##\r\n", json.dumps([box("b", 0, 9)]), "x"), (None, "# c", None, "x")], "doc_id long, text string, layout string, level string")
    got = {r["doc_id"]: r["markdown"] for r in headings.repair(docs).collect()}
    assert got == {1: None, 2: "", 3: "a\r\n# b ##\r\n", None: "# c"}
    assert headings.repair(docs.where("false")).collect() == []
