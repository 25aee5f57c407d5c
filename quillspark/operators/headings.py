"""Heading levels from the layout of page titles, by joins and windows, and Markdown rewritten with them.

``headings``: doc, line, level, title, in the order of the text; ``items``: doc,
ord, page, title, is_title, x0, y0, x1, y1, the blocks of a layout in its order.

A heading takes the place and size of the layout title it matches.  On the first
page the document's first heading is level 1 and others are level 2.  On other
pages a single title after a numbered chapter is level 3, a title clearly larger
than the next is level 2 and leads others of level 3, four or more without such a
leader are level 3, and the rest keep their level, 2 at least.  Headings that
match nothing keep theirs, but for the first, which is level 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: How much larger a leader is than the next, titles of a grid, longest title block, longest heading, longest number mark.
LEADER, TILES, BLOCK_CHARS, HEADING_CHARS, MARK_CHARS = 1.25, 4, 200, 120, 4
#: Titles that decorate, and titles that begin with a number.
NOISE, NUMBERED = r"(?i)^(?:(?:part\s*)?\d{1,3}|thanks|business|contents)$", r"(?i)^(?:part\s*)?\d{1,3}\s"
_HEADING = r"^(#{1,6})\s+(\S.*?)\s*$"
LEVELS = "doc, line, level"


def plain(title: Column) -> Column:
    """What two spellings of a title share: letters and digits, in lower case."""
    return F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}]+", ""))


def layout_items(payload: Column) -> Column:
    """array<struct<title, is_title, page, x0, y0, x1, y1>> of a layout's JSON: a list of blocks, or an object that holds it
    as ``content_list`` or ``pdf_info``.  Other JSON, and none, gives no blocks; a block without four bounds has none."""
    v = F.try_parse_json(payload)
    lists = [F.try_variant_get(v, p, "array<variant>") for p in ("$.content_list", "$.pdf_info", "$")]
    found = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<variant>"))

    def text(x: Column, *names: str) -> Column:
        return F.coalesce(*[F.nullif(F.btrim(F.try_variant_get(x, f"$.{n}", "string")), F.lit("")) for n in names], F.lit(""))

    def block(x: Column) -> Column:
        level = F.try_variant_get(x, "$.text_level", "string")
        boxes = [F.try_variant_get(x, f"$.{n}", "array<double>") for n in ("bbox", "box")]
        box = F.coalesce(*[F.when(F.size(b) > 0, b) for b in boxes], F.array().cast("array<double>"))
        titled = (F.try_variant_get(x, "$.type", "string") == "title") | (level.isNotNull() & ~level.isin("", "0", "false"))
        bounds = [F.get(box, i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
        page = F.coalesce(F.try_variant_get(x, "$.page_idx", "int"), F.lit(0))
        return F.struct(text(x, "text", "content").alias("title"), F.coalesce(titled, F.lit(False)).alias("is_title"), page.alias("page"), *bounds)

    return F.transform(F.filter(found, lambda x: F.schema_of_variant(x).startswith("OBJECT")), block)


def _numbered(title: Column) -> Column:
    return title.rlike(NUMBERED) | ((F.length(title) <= MARK_CHARS) & title.rlike(NOISE))


def matched(headings: DataFrame, items: DataFrame) -> DataFrame:
    """Each heading with ``hit``, its layout title: the last one that is equal in ``plain`` form, else the first that contains it
    or lies in it.  Decorative and very long titles, and those without a letter or digit, match nothing; nor do headings of
    over HEADING_CHARS characters.

    A document's distinct titles are one array, so pairs of headings and titles never become rows.
    """
    boxed = items.where("is_title and title <> '' and x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    area = F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    titles = boxed.where((F.length("title") <= BLOCK_CHARS) & ~F.col("title").rlike(NOISE)).select("doc", "ord", "page", plain(F.col("title")).alias("key"), area.alias("area"), "x0").where("key <> ''")
    titles = titles.groupBy("doc", "key").agg(F.min("ord").alias("first"), F.max_by(F.struct("page", "area", "x0"), "ord").alias("box"))
    titles = titles.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "key", "box"))).alias("_titles"))
    h = headings.withColumn("key", plain(F.col("title"))).join(titles, "doc", "left")
    equal = F.get(F.filter("_titles", lambda t: t["key"] == F.col("key")), F.lit(0))
    within = F.get(F.filter("_titles", lambda t: F.contains(t["key"], F.col("key")) | F.contains(F.col("key"), t["key"])), F.lit(0))
    hit = F.coalesce(equal, F.when(F.length("key") >= 2, within))
    return h.withColumn("hit", F.when(F.length("title") <= HEADING_CHARS, hit)).drop("_titles")


def levels(headings: DataFrame, items: DataFrame, most_levels: int = 3) -> DataFrame:
    """(doc, line, level) of every heading; level 0 is a decorative one, which goes.

    Documents without a title block keep their levels and all headings; so do those where no heading matches, but for
    decorative ones that do.
    """
    m = matched(headings, items).withColumn("noise", F.col("title").rlike(NOISE))
    whole, on_page = Window.partitionBy("doc"), Window.partitionBy("doc", "page")
    m = m.withColumn("counts", F.col("hit").isNotNull() & ~F.col("noise")).withColumn("any", F.max("counts").over(whole)).withColumn("start", F.min("line").over(whole))
    # the level of the first heading spelt like the title that was matched
    spelt = headings.groupBy("doc", plain(F.col("title")).alias("_key")).agg(F.min_by("level", "line").alias("_own"))
    m = m.withColumn("_key", F.col("hit.key")).join(spelt, ["doc", "_key"], "left").drop("_key")

    p = m.where("counts").select("doc", "line", "hit.box.*", "start", F.coalesce("_own", F.lit(2)).alias("own"))
    ranked = on_page.orderBy(F.desc("area"), F.desc("x0"), "line")
    p = p.withColumn("rank", F.row_number().over(ranked)).withColumn("n", F.count("*").over(on_page)).withColumn("top", F.min("line").over(on_page))
    p = p.withColumn("ratio", F.max(F.when(F.col("rank") == 1, F.col("area"))).over(on_page) / F.max(F.when(F.col("rank") == 2, F.col("area"))).over(on_page))
    p = p.withColumn("first", F.min("page").over(whole)).withColumn("last", F.max("page").over(whole))
    numbers = items.where(_numbered(F.col("title"))).select("doc", "page").distinct().withColumn("numbered", F.lit(True))
    p = p.join(numbers, ["doc", "page"], "left").withColumn("numbered", F.coalesce("numbered", F.lit(False)))
    # pages come in the order of their first headings
    before = Window.partitionBy("doc").orderBy("top").rangeBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("chapter", F.coalesce(F.max("numbered").over(before), F.lit(False)))
    level = (
        F.when(F.col("page") == F.col("first"), F.when(F.col("line") == F.col("start"), 1).otherwise(2))
        .when((F.col("n") == 1) & (F.col("page") != F.col("last")) & F.col("chapter") & ~F.col("numbered"), 3)
        .when(F.col("ratio").isNull() | (F.col("ratio") >= LEADER), F.when(F.col("rank") == 1, 2).otherwise(3))
        .when(F.col("n") >= TILES, 3)
        .otherwise(F.greatest("own", F.lit(2)))
    )
    placed = p.select("doc", "line", F.least(level, F.lit(most_levels)).alias("_level"))
    out = m.select("doc", "line", F.col("level").alias("_old"), "noise", "any", "start", F.col("hit").isNotNull().alias("_hit")).join(placed, ["doc", "line"], "left")
    gone = F.col("noise") & (F.col("any") | F.col("_hit"))
    first = F.when(F.col("any") & (F.col("line") == F.col("start")), 1)
    return out.select("doc", "line", F.when(gone, 0).otherwise(F.coalesce("_level", first, "_old")).cast("int").alias("level"))


def headings_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, line, level and title of the heading lines of Markdown texts."""
    lines = docs.select(F.col(key).alias("doc"), F.posexplode(F.split(text, "\r?\n", -1)).alias("line", "_x")).where(F.col("_x").rlike(_HEADING))
    return lines.select("doc", "line", F.length(F.regexp_extract("_x", _HEADING, 1)).alias("level"), F.regexp_extract("_x", _HEADING, 2).alias("title"))


def repair(docs: DataFrame, key: str = "doc_id", text: str = "text", layout: str = "layout", most_levels: int = 3) -> DataFrame:
    """``docs`` with ``markdown``, the text with its headings' levels put right by the layout, and ``hierarchy``, what was done.

    ``key`` names a row; ``layout`` is a layout's JSON.  Decorative headings leave
    an empty line; lines end with a line break; a null text stays null.
    """
    h = headings_of(docs, key, text)
    items = docs.select(F.col(key).alias("doc"), F.posexplode(layout_items(F.col(layout))).alias("ord", "_b")).select("doc", "ord", "_b.*")
    new = levels(h, items, most_levels).withColumnRenamed("level", "_new")
    both = h.join(new, ["doc", "line"])
    line = F.when(F.col("_new") == 0, "").when(F.col("_new") != F.col("level"), F.concat_ws(" ", F.repeat(F.lit("#"), F.col("_new")), "title"))
    hits = matched(h, items).where(F.col("hit").isNotNull() & ~F.col("title").rlike(NOISE)).groupBy("doc").agg(F.count("*").alias("matched_headings"))
    changes = both.groupBy("doc").agg(
        F.map_from_entries(F.collect_list(F.when(line.isNotNull(), F.struct("line", line.alias("x"))))).alias("_changes"),
        F.count("*").alias("markdown_heading_count"), F.sum((F.col("_new") == 0).cast("long")).alias("removed_decorative"),
        F.sum(((F.col("_new") != 0) & (F.col("_new") != F.col("level"))).cast("long")).alias("adjusted_levels"),
    )
    titles = items.where("is_title and title <> '' and y1 is not null").groupBy("doc").agg(F.count("*").alias("layout_title_count"))
    facts = changes.join(titles, "doc", "left").join(hits, "doc", "left").withColumnRenamed("doc", "_doc")
    names = ["layout_title_count", "markdown_heading_count", "matched_headings", "adjusted_levels", "removed_decorative"]
    lines = F.split(F.col(text), "\r?\n", -1)
    written = F.array_join(F.transform(lines, lambda x, i: F.coalesce(F.try_element_at("_changes", i), x)), "\n")
    out = docs.join(facts, docs[key] == facts["_doc"], "left")
    markdown = F.when(F.size("_changes") > 0, written).otherwise(F.col(text)).alias("markdown")
    return out.select(*[docs[c] for c in docs.columns], markdown, F.struct(*[F.coalesce(n, F.lit(0)).alias(n) for n in names]).alias("hierarchy"))
