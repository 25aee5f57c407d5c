"""Text operators on small fixtures."""

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.functions import html, markdown, parts, text
from quillspark.operators import chunking


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def test_normalised_hash(spark):
    for a, b in (("Ｆｕｌｌ　Width", "fullwidth"), ("Straße", "STRASSE"), ("a　b\u001cc", "abc")):
        assert one(spark, a, text.normalized) == one(spark, b, text.normalized)
    assert one(spark, None, text.content_hash) is None


def test_links_and_images(spark):
    assert one(spark, "[[ b ]] [[a]] [[b]] [[ ]]", text.wiki_links) == ["b", "a"]
    r = one(spark, "x ![茶](tea.png) ![](b.png)", text.image_refs)
    assert [(i["alt"], i["ref"]) for i in r] == [("茶", "tea.png"), ("", "b.png")]
    assert one(spark, "x ![茶](tea.png)y", text.without_images) == "x y"


def test_file_types(spark):
    assert [one(spark, p, text.file_type) for p in ("a/B.PDF", "x.jpeg", "x.exe", "noend")] == ["text", "image", None, None]
    assert one(spark, "/api/" + "0a" * 16 + "/x", text.metric_path) == "/api/{id}/x"


def test_html(spark):
    page = "<h1>Title</h1><p><strong>Bold</strong> text<script>no</script></p><ul><li>one</li><li>two<ol><li>a</li></ol></li></ul><table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table><img alt='x' src='i.png'><a href='u'>link</a>"
    m = one(spark, page, html.markdown_of)
    for part in ("# Title", "**Bold** text", "- one", "  1. a", "| A | B |\n| --- | --- |\n| 1 | 2 |", "![x](i.png)", "link"):
        assert part in m
    assert "no" not in m and "](u)" not in m and m.endswith("\n")
    assert m == "# Title\n**Bold** text\n- one\n- two\n  1. a\n| A | B |\n| --- | --- |\n| 1 | 2 |\n![x](i.png)link\n"
    assert "| A | B |  |" in one(spark, page, lambda c: html.markdown_of(c, True))
    assert one(spark, None, html.markdown_of) is None and one(spark, "", html.markdown_of) == "\n"


PAGES = {
    "<blockquote>said <em>so</em></blockquote><hr><p>after</p>": "> said *so*\n---\nafter\n",
    "<p>one<br>two <i>three</i> <b>four</b> <code>x = 1</code></p>": "one\ntwo *three* **four** `x = 1`\n",
    "<pre>\n a  b\n\n  c\n</pre><p>d</p>": "```\n a  b\n\n  c\n```\nd\n",
    "<div>a<script>if (x) { '</style>' }</script><style>p {}</style>b</div>": "ab\n",
    "<ol><li>x<ul><li>y</li></ul></li><li>z</li></ol>": "1. x\n  - y\n2. z\n",
    "<section>a</section><article>b</article><footer>c</footer>": "a\nb\nc\n",
    "<table><tr><th>A</th></tr><tr><td>1</td><td>2</td></tr></table>": "| A |  |\n| --- | --- |\n| 1 | 2 |\n",
    "<table></table>": "\n",
}


def test_html_rules(spark):
    rows = spark.createDataFrame([(t,) for t in PAGES], "t string").select("t", html.markdown_of(F.col("t")).alias("m"))
    assert {r["t"]: r["m"] for r in rows.collect()} == PAGES


def test_metadata(spark):
    rows = spark.createDataFrame([("up/A page.v2.html", "![x](a.png)\n| a |\n| - |\n![](b.png)"), (".hidden", ""), ("plain", None)], "p string, m string")
    got = [r["d"] for r in rows.select(html.metadata(F.col("p"), F.col("m")).alias("d")).collect()]
    assert (got[0]["title"], [(i["alt"], i["ref"]) for i in got[0]["images"]], got[0]["table_count"]) == ("A page.v2", [("x", "a.png"), ("", "b.png")], 2)
    assert (got[1]["title"], got[1]["images"], got[1]["table_count"]) == (".hidden", [], 0) and got[2]["title"] == "plain"


def test_bold_titles_and_wide_rows(spark):
    """A bold title before a colon stands on its own line; a table row over the budget is cut, no token of it lost."""
    docs = spark.createDataFrame([(1, "**1、Soil** ：wet\n**2、Light**：bright\nmore")], "doc_id long, text string")
    assert [(r["title"], r["content"]) for r in chunking.chunk_tree(docs).collect()] == [("**1、Soil**", "**1、Soil**\n：wet".replace("：", "")), ("**2、Light**", "**2、Light**\nbright\nmore")]
    table = "| a | b |\n| --- | --- |\n| " + " ".join(f"w{i}" for i in range(100)) + " | end |\n"
    pieces = chunking.windows(table, 40, 0)
    assert len(pieces) > 2 and all(p.startswith("| a | b |\n| --- | --- |\n") for p in pieces) and all(p.endswith(chunking.CUT_MARK) for p in pieces[:-1])
    import re

    assert {f"w{i}" for i in range(100)} <= set(re.findall(r"w\d+", "\n".join(pieces)))


def test_tokens_are_counted_alike(spark):
    text = "Ünïcode été, 日本語 x2! ¿qué?"
    assert one(spark, text, chunking.token_count) == chunking.count(text)


def test_sections_and_chunks(spark):
    docs = spark.createDataFrame(
        [
            (1, "start\n# Book\nforeword\n## One\nfirst text.\n## Two\nsecond text.\n# Late\n## Three\nthird\n# Alone\nlost"),
            (2, "no heading at all"),
            (3, ""),
            (4, None),
            (5, "## Long\n" + " ".join(f"w{i}" for i in range(200))),
            (6, "## Pic\n\n![a cat](cat.png)\n\ntext"),
        ],
        "doc_id long, text string",
    )
    rows = chunking.chunk_tree(docs, 30, 0, 100).orderBy("doc_id", "parent_section", "parent_part", "chunk_index").collect()
    one = [r for r in rows if r["doc_id"] == 1]
    assert [(r["title"], r["parent_content"], r["content"]) for r in one] == [
        ("## One", "# Book\n## One\nstart\n\nforeword\n\nfirst text.".replace("start\n\nforeword", "start\nforeword"), "# Book\n## One\nstart\nforeword\n\nfirst text."),
        ("## Two", "# Book\n## Two\nsecond text.", "# Book\n## Two\nsecond text."),
        ("## Three", "# Late\n## Three\nthird", "# Late\n## Three\nthird"),
    ]
    assert [r["content"] for r in rows if r["doc_id"] == 2] == ["no heading at all"]
    assert not [r for r in rows if r["doc_id"] in (3, 4)]
    long = [r for r in rows if r["doc_id"] == 5]
    assert len({r["parent_id"] for r in long}) == 3 and all(r["tokens"] <= 30 and r["content"].startswith("## Long\n") for r in long)
    assert sorted({w for r in long for w in r["content"].split()[2:]}) == sorted(f"w{i}" for i in range(200))
    (pic,) = [r for r in rows if r["doc_id"] == 6]
    assert pic["images"] and "cat.png" not in pic["parent_content"] and pic["content"].startswith("## Pic\n") and pic["content"].endswith("text")


def test_windows_lose_nothing():
    import re

    words = " ".join(f"w{i}." + ("\n\n" if i % 9 == 0 else "") for i in range(1500))
    parts = chunking.windows(words, 120, 20)
    assert {w for p in parts for w in re.findall(r"w\d+", p)} == set(re.findall(r"w\d+", words))
    assert all(len(re.findall(chunking.TOKEN, p)) <= 120 for p in parts)
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| r{i} | v{i} |" for i in range(100))
    pieces = chunking.windows(table, 50, 0)
    assert all(p.startswith("| a | b |") for p in pieces) and all(p.endswith(chunking.CUT_MARK) for p in pieces[:-1])
    assert {f"r{i}" for i in range(100)} <= set(re.findall(r"r\d+", "\n".join(pieces)))


def test_functions_hold_a_part_of_a_batch(spark):
    """Results leave the worker part by part, in order, with nulls, empty texts and one longer than a part."""
    sizes = spark.createDataFrame([(i, None if i % 7 == 3 else "Ab c" * (i % 50)) for i in range(400)] + [(400, "x" * (6 << 20)), (401, "Ａ ｂ")], "id long, t string").coalesce(1)
    seen = parts.by_parts(lambda texts: pa.array([len(texts)] * len(texts)), "long", F.repeat(F.coalesce("t", F.lit("")), 2000))
    assert sizes.where("id < 400").select(seen.alias("n")).agg(F.max("n")).first()[0] < 400
    want = {r["id"]: None if r["t"] is None else hashlib.sha256("".join(unicodedata.normalize("NFKC", r["t"]).casefold().split()).encode()).hexdigest() for r in sizes.collect()}
    assert {r["id"]: r["h"] for r in sizes.select("id", text.content_hash(F.col("t")).alias("h")).collect()} == want


def test_trees_and_cleaned_texts_leave_part_by_part(spark):
    """Over several parts of a batch, rows and results stay together; edits are kept for a report alone."""
    docs = spark.createDataFrame([(i, None if i == 5 else f"## T{i}\nbody  {i}\n\n" + "w " * 30000) for i in range(300)], "doc_id long, text string").coalesce(1)
    trees = chunking.chunk_tree(docs).groupBy("doc_id").agg(F.min("title").alias("title")).collect()
    assert {(r["doc_id"], r["title"]) for r in trees} == {(i, f"## T{i}") for i in range(300) if i != 5}
    got = markdown.clean(docs, "text").select("doc_id", F.substring("markdown", 1, 20).alias("m")).collect()
    assert all(r["m"] is None if r["doc_id"] == 5 else r["m"].startswith(f"## T{r['doc_id']}\nbody {r['doc_id']}") for r in got) and len(got) == 300
    x = markdown.Lines(["a"], report=False)
    x.note("kind", 0, "a")
    assert x.edits == []  # nothing is kept for a report that no one asked for
