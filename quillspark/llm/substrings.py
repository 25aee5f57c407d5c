"""Operator 13: exact substring removal by seed and extend.

A window is LENGTH consecutive words.  Words of windows that occur more than
once anywhere are removed, so what goes are the maximal repeats of at least
LENGTH words.

1. Seeds.  Runs of SEED words are hashed and winnowed: of the SEED-word runs in a
   window the one with the least hash, the last of equal ones, is the window's
   anchor.  Equal windows have equal anchors at equal places, so documents that
   share a window share an anchor.  Neighbouring windows with one anchor are a
   *unit*: the anchor with the words that its windows reach to either side.
2. Join on anchors.  Occurrences are counted by anchor.  Most anchors occur once
   and are done with.  Where all units of an anchor are equal, all their windows
   repeat; so do those of any unit that occurs twice.
3. Extend.  Other units of a shared anchor are compared by how far they agree to
   both sides of it: a unit reaches l words to the left and as many to the right
   as a window leaves, for each l, and each such extension is a window, met by
   the others of its anchor in a partially aggregated count.
4. Windows found twice, put together per text, are the maximal repeats; their
   words go.

Only distinct texts and distinct units are extended, and everything that is
counted by key is aggregated before it is shuffled, so copies and frequent
passages cost a row a task.  Nothing grows with the number of pairs.  Anchors
are hashed from one half of the words' XXH3-128, units and windows from the
other, so equality is that of 128 bits.

Defined results: a null text counts as the empty one and has no words; texts of
fewer than LENGTH words keep them all, and the empty rest has the digest of the
empty string; repeated rows are documents of their own, so both lose what they
share; a null doc_id stays null; other columns are ignored; an empty table gives
an empty one.  Ties between equal hashes within a window fall to the last
place.  Texts are taken in parts of at most 4 MB, a longer text by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, staged

LENGTH, SEED = 35, 12
#: Bases of the two rolling hashes (odd, so that they have inverses modulo 2^64).
_ANCHOR, _WINDOW = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


class Rolling:
    """Hashes of all runs of so many words in a sequence of word hashes, as a polynomial modulo 2^64."""

    def __init__(self, words: np.ndarray, base: int):
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self._powers(base, len(words)), out=self.sums[1:])
        self.back = self._powers(pow(base, -1, 1 << 64), len(words))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out) if n else out

    def runs(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        x = (self.sums[start + length] - self.sums[start]) * self.back[start]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def split(text: str) -> list[bytes]:
    """The words: runs of anything but the space and U+0009 to U+000D."""
    return text.encode().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two independent 64-bit hashes of each word."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)


def last_least(x: np.ndarray, width: int) -> np.ndarray:
    """The position of the last least value in each run of ``width`` values."""
    at, span = np.arange(len(x)), 1
    while span < width and len(at):
        step = min(span, width - span)
        if len(at) <= step:
            return at[:0]
        a, b = at[:-step], at[step:]
        at, span = np.where(x[b] <= x[a], b, a), span + step
    return at


def units(hashes: np.ndarray, ends: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Over concatenated texts that end at ``ends``: (text, anchor hash, unit hash, first window, number of windows) of every unit."""
    anchors = Rolling(hashes[:, 0], _ANCHOR)
    grams = anchors.runs(np.arange(max(0, len(hashes) - seed + 1)), seed)
    at = last_least(grams, length - seed + 1)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    first = np.flatnonzero(text[: len(at)] == text[length - 1 : length - 1 + len(at)])
    if not len(first):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    at = at[first]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[first[1:]] != text[first[:-1]])])
    n = np.diff(np.r_[new, len(first)])
    first, at = first[new], at[new]
    whole = Rolling(hashes[:, 1], _WINDOW).runs(first, n + length - 1)
    # the unit is its words and the place of the anchor among them
    whole = (whole ^ n.astype(np.uint64) ^ ((at - first).astype(np.uint64) << np.uint64(32))) * np.uint64(_ANCHOR)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    return text[first], grams[at], whole, first - starts[text[first]], n


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text and 128 bits of its hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def _marks(length: int, seed: int):
    names = ["k1", "k2", "n_words", "whole", "anchor", "unit", "first", "n"]

    def run(batches):
        for b in batches:
            for part in slices(b):
                words = [split(t) for t in part.column("text").to_pylist()]
                ends = np.cumsum([len(w) for w in words])
                text, anchor, unit, first, n = units(word_hashes([w for own in words for w in own]), ends, length, seed)
                cuts = pa.array(np.searchsorted(text, np.arange(len(words) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (anchor.view(np.int64), unit.view(np.int64), first.astype(np.int32), n.astype(np.int32))]
                sizes = pa.array([len(w) for w in words], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), sizes, pa.array([digest(w) for w in words], pa.string()), *lists], names)

    return run


def _windows(length: int):
    """The window hashes of the asked units of each text."""

    def run(batches):
        for b in batches:
            for part in slices(b):
                for text, asked in zip(part.column("text").to_pylist(), part.column("asked").to_pylist()):
                    roll = Rolling(word_hashes(split(text))[:, 1], _WINDOW)
                    first, n = np.array([u["first"] for u in asked]), np.array([u["n"] for u in asked])
                    cuts = np.r_[0, np.cumsum(n)]
                    found = roll.runs(np.repeat(first - cuts[:-1], n) + np.arange(cuts[-1]), length)
                    lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(found.view(np.int64)))
                    names, kinds = ["anchor", "unit", "many"], [pa.int64(), pa.int64(), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([*[pa.array([u[c] for u in asked], k) for c, k in zip(names, kinds)], lists], [*names, "windows"])

    return run


def _kept(length: int):
    """The words of each text that no repeated window covers: how many went, and the digest of the rest or the rest itself."""

    def run(batches):
        for b in batches:
            for part in slices(b):
                gone, rest = [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("found").to_pylist()):
                    words = split(text)
                    edge = np.zeros(len(words) + 1, np.int64)
                    first, mask = np.array([u["first"] for u in found], np.int64), np.array([u["mask"] for u in found], np.int64)
                    k = np.arange(64)
                    start = (first[:, None] + k)[(mask[:, None] >> k) & 1 > 0]
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + length, -1)
                    stays = np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()
                    gone.append(len(words) - len(stays))
                    rest.append(b" ".join([words[i] for i in stays]).decode())
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(gone, pa.int64()), pa.array(rest, pa.string())], ["k1", "k2", "gone", "rest"])

    return run


def drop_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row; with ``texts`` also ``kept``, the words left joined by one space.

    ``length`` is at most ``seed`` + 61, so that a unit's windows fit a mask.
    """
    if not 0 < seed <= length < seed + 62:
        raise ValueError("length must lie between seed and seed + 61")
    keyed, key = _keyed(docs), ["k1", "k2"]
    marks = keyed.select("k1", "k2", "text").mapInArrow(_marks(length, seed), "k1 long, k2 long, n_words long, whole string, anchor array<long>, unit array<long>, first array<int>, n array<int>")
    one = [F.first(c).alias(c) for c in ("n_words", "whole", "anchor", "unit", "first", "n")]
    marks = staged(marks.groupBy(*key).agg(F.count("*").alias("copies"), *one), "repeat-marks")

    every = marks.select("k1", "k2", "n_words", "copies", F.inline(F.arrays_zip("anchor", "unit", "first", "n")))
    shared = every.groupBy("anchor").agg(F.sum("copies").alias("times"), F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    # written, so that the join below deals both sides out by itself and adaptive execution can split a frequent anchor
    shared = staged(shared.where("times > 1"), "repeat-anchors")
    met = staged(every.join(shared, "anchor").select("k1", "k2", "n_words", "copies", "anchor", "unit", "first", "n", (F.col("lo") == F.col("hi")).alias("same")), "repeat-units")

    # distinct units of anchors with differing ones: how often they occur, and a text to extend them in
    unlike = met.where("not same").groupBy("anchor", "unit").agg(F.sum("copies").alias("times"), F.min(F.struct("k1", "k2", "first", "n")).alias("at"))
    unlike = staged(unlike.select("anchor", "unit", (F.col("times") > 1).alias("many"), "at.*"), "repeat-unlike")
    asked = unlike.groupBy(*key).agg(F.collect_list(F.struct("anchor", "unit", "many", "first", "n")).alias("asked"))
    # a text with no copy whose windows don't all repeat for sure is needed to cut it
    own = met.where("copies = 1").join(unlike.where("many").select("anchor", "unit", "many"), ["anchor", "unit"], "left")
    own = staged(own.withColumn("sure", F.col("same") | F.coalesce("many", F.lit(False))), "repeat-own")
    state = own.groupBy(*key, "n_words").agg(F.sum(F.when(F.col("sure"), F.col("n")).otherwise(0)).alias("sure"))
    state = staged(state.select("k1", "k2", (F.col("sure") == F.col("n_words") - (length - 1)).alias("gone_whole")), "repeat-state")

    needed = state.where("not gone_whole").select("k1", "k2", F.lit(True).alias("cut")).join(asked, key, "full_outer")
    held = keyed.groupBy(*key).agg(F.first("text").alias("text")).join(needed, key)
    held = staged(held.select("k1", "k2", "text", F.coalesce("cut", F.lit(False)).alias("cut"), "asked"), "repeat-texts")

    extended = held.where("asked is not null").select("text", "asked").mapInArrow(_windows(length), "anchor long, unit long, many boolean, windows array<long>")
    windows = staged(extended.select("anchor", "unit", "many", F.posexplode("windows").alias("j", "window")), "repeat-windows")
    twice = windows.groupBy("anchor", "window").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi"), F.max("many").alias("many"))
    twice = twice.where("lo <> hi or many").select("anchor", "window")
    masks = windows.where("not many").join(twice, ["anchor", "window"], "left_semi").groupBy("anchor", "unit").agg(F.sum(F.expr("shiftleft(1L, j)")).alias("mask"))

    # units that repeat for sure need no mask; each of the others occurs once
    sure = own.where("sure").select("k1", "k2", "first", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    found = sure.unionByName(own.where("not sure").join(masks, ["anchor", "unit"]).select("k1", "k2", "first", "mask"))
    found = found.groupBy(*key).agg(F.collect_list(F.struct("first", "mask")).alias("found"))
    cut = held.where("cut").select("k1", "k2", "text").join(found, key).mapInArrow(_kept(length), "k1 long, k2 long, gone long, rest string")
    cut = cut.select("k1", "k2", "gone", F.sha2("rest", 256).alias("sha"), *(["rest"] if texts else []))

    copied = (F.col("copies") > 1) & (F.col("n_words") >= length)
    whole = F.coalesce("gone_whole", F.lit(False)) | copied
    result = marks.select("k1", "k2", "n_words", "whole", "copies").join(state, key, "left").join(cut, key, "left")
    result = result.select(
        "k1", "k2", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"),
        *([F.when(whole, "").otherwise(F.col("rest")).alias("rest")] if texts else []),
    )
    rows = keyed.join(result, key)
    kept = [F.coalesce("rest", F.regexp_replace(F.regexp_replace("text", "[ \\t-\\r]+", " "), "^ | $", "")).alias("kept")] if texts else []
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256", *kept)
