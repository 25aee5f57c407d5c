"""Operator 2: document fingerprints as bottom-k sketches, in DataFrame functions alone.

A text's words (lower case, split at white space) give the 64-bit hashes of all
its five-word shingles, a shorter text the one of its whole sequence.  The
sketch is the k smallest distinct hashes in rising order.  Sketches of parts
merge to the sketch of the whole; two of them estimate resemblance and
containment, one the number of distinct shingles.

Defined results: a null text counts as the empty one; a text without words has
the empty sketch, which is entirely like another empty one and unlike any
other; a text of few shingles has them all and its estimates are exact.  Rows
with a null doc_id are not in the order of documents: for them the next
document is the empty text.  Repeated doc_ids follow each other by a hash of
their text.  Other columns are ignored, whatever their names; an empty table gives
an empty result.  Equal hashes count once, so ties don't arise.  A very long text
is read whole; its shingles are one array of a row, its sketch has at most k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import id_and_text

K, WORDS = 128, 5
#: Documents a range of ids is meant to have, and the most ranges (their bounds are a literal of the plan).
RANGE, MOST_RANGES = 1_000, 4_096


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The bottom-k sketch of a text as array<bigint>."""

    def hashes(w: Column) -> Column:
        several = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) == 0, none).when(F.size(w) < words, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(several)

    found = _once(F.array_remove(F.split(F.lower(text), r"\s+"), ""), hashes)
    return F.slice(F.sort_array(F.array_distinct(found)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets behind two sketches."""
    return _once(F.struct(merge(a, b, k).alias("u"), F.array_intersect(a, b).alias("i")), lambda x: F.when(F.size(x["u"]) == 0, 1.0).otherwise(F.size(F.array_intersect(x["u"], x["i"])) / F.size(x["u"])))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63) + 1) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_all(sketches: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key.  Hashes are reduced to k per key and salt first, so that no key's rows meet in one task."""
    hashes = sketches.select(*keys, F.explode(column).alias("_h")).withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(64))).distinct()
    for by in ([*keys, "_salt"], keys):
        hashes = hashes.withColumn("_turn", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_turn") <= k).drop("_turn")
    return hashes.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """(doc_id, sketch, fingerprint, n_shingles) of every whole text."""
    return id_and_text(docs).select("doc_id", sketch(F.col("text"), k, words).alias("sketch")).select("doc_id", "sketch", as_text(F.col("sketch")).alias("fingerprint"), distinct_shingles(F.col("sketch"), k).alias("n_shingles"))


def with_next(docs: DataFrame, carry: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, text, next_text, ...) in falling order of doc_id, the first document being next to the last.

    Ids are cut into ranges at approximate quantiles.  The first document of a
    range also goes, marked, to the range above it, so that every range finds
    its followers at home: texts are shuffled once and no task has all rows.
    ``carry`` are further columns over ``text``, computed once for each row and
    given for the next document too, as ``next_<name>``.
    """
    spark, rows = docs.sparkSession, id_and_text(docs)
    n = rows.where("doc_id is not null").count()
    ranges = min(MOST_RANGES, max(1, n // RANGE))
    shares = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(rows.select(F.percentile_approx("doc_id", shares, 100_000)).first()[0] or [])) if shares else []
    place = F.lit(0)
    if bounds:
        table, width = F.array(*[F.lit(b).cast("long") for b in bounds]), len(bounds).bit_length()
        # how many bounds are at most doc_id, by halving
        place = F.aggregate(F.array(*[F.lit(1 << s) for s in reversed(range(width))]), F.lit(0), lambda a, s: F.when((a + s <= len(bounds)) & (F.get(table, a + s - 1) <= F.col("doc_id")), a + s).otherwise(a))
    spread = -1 - F.pmod(F.xxhash64("text"), F.lit(64)).cast("int")
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), spread).otherwise(place))
    firsts = sorted((r[0], r[1]) for r in rows.where("doc_id is not null").groupBy("part").agg(F.max("doc_id")).collect())  # a row per range
    above = [p for p, _ in firsts[1:]] + [firsts[0][0]] if firsts else []
    marks = spark.createDataFrame([(first, up) for (_, first), up in zip(firsts, above)], "first_id long, above int")
    rows = rows.join(F.broadcast(marks), F.col("doc_id") == F.col("first_id"), "left").drop("first_id")
    rows = rows.select("doc_id", "text", F.posexplode(F.array_compact(F.array("part", "above"))).alias("copy", "part")).repartition("part")
    rows = rows.select("*", *[c.alias(name) for name, c in (carry or {}).items()])
    order = Window.partitionBy("part").orderBy("copy", F.desc("doc_id"), F.xxhash64("text"), "text")
    known = F.col("doc_id").isNotNull()
    nexts = [F.when(known, F.lead(c).over(order)).alias(f"next_{c}") for c in ("text", *(carry or {}))]
    return rows.select("*", *nexts).where("copy = 0").drop("copy", "part").withColumn("next_text", F.coalesce("next_text", F.lit("")))


def edited_fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each document with its own sketch and the sketch of its edited text: the last third replaced by the next document's start."""
    rows = with_next(docs, {"sketch": sketch(F.col("text"), k, words)})
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), k, words).alias("edited_sketch"), F.coalesce("next_sketch", F.array().cast("array<bigint>")).alias("next_sketch"))
    return rows.select("*", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
