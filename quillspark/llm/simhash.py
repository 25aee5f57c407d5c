"""Operator 9: SimHash near-duplicates by vantage-point trees over Hamming distance.

1. Fingerprints: 64 bits by majority over the XXH64 of all word shingles.
2. Distinct fingerprints (with their smallest doc_id) are dealt to shards, the
   leaves of a vantage-point tree that the driver builds from a bounded sample.
   Each has one home; it also visits the shards on the far side of a boundary
   that its ball of the given radius crosses.  Of two linked fingerprints with
   different homes, at least the one on the inner side of the first boundary
   between them visits the other's home, so no pair is lost, and outer ones
   needn't visit inner shards.
3. Each shard searches the visitors among its residents by a tree of the same
   kind, pruned by the same triangle bounds, down to blocks that are compared
   in full.  Of the links found it returns a spanning forest.
4. Components of the forests, and back to the documents.

The number of shards follows the number of distinct fingerprints; a sample only
chooses vantage points and radii, so it affects balance, never results.

Defined results: a null text counts as the empty one; texts without words have
fingerprint zero, which links like any other; rows with a null doc_id get a
fingerprint, link with nothing and have a null component_id; repeated rows get
the same result each; other columns are ignored; an empty table gives an empty
result.  A bit that exactly half the hashes set is 0.  A very long text is hashed
whole and costs memory in proportion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, free_name, id_and_text, slices, staged

AT_ONCE = 512
#: Fingerprints the driver may take to choose vantage points from.
SAMPLE = 8192
#: Residents a shard is meant to have.  Visits grow with the depth of the tree between shards, while the tree inside a
#: shard prunes as well without sending anything, so shards are as large as a task easily holds (17 bytes a row).
SHARD = 32_768
#: Pairs compared at once in a block.
BLOCK = 1 << 19


def shingle_hashes(text: str, words: int = 4) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence where there are fewer words; none without words."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, "<u8")
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], "<u8")
    flat, ends, hash_of = b" ".join(found), np.cumsum([len(w) + 1 for w in found]), xxhash.xxh64_intdigest
    starts = [0, *ends[:-words].tolist()]
    return np.array([hash_of(flat[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], "<u8")


def majority(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes as a signed 64-bit number: bits set in over half of them."""
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: str, words: int = 4) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, print), the fingerprint of every whole text as a long."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                prints = [fingerprint(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "print"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, print long")


def _far(x: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ v).astype(np.int16)


def _vantage(x: np.ndarray) -> tuple[np.uint64, int] | None:
    """The candidate whose distances spread most, and the radius that halves ``x``; None if nothing is split."""
    best = None
    for v in x[:: max(1, len(x) // 8)][:8]:
        d = _far(x[:2048], v)
        if best is None or d.std() > best[0]:
            best = (d.std(), v)
    d = _far(x, best[1])
    radius = int(np.median(d))
    if (d <= radius).all():
        radius -= 1
    return (best[1], radius) if (d <= radius).any() else None


def grow(x: np.ndarray, depth: int):
    """A tree as nested (vantage, radius, inner, outer); None is a leaf."""
    cut = _vantage(x) if depth and len(x) > 1 else None
    if cut is None:
        return None
    d = _far(x, cut[0])
    return (*cut, grow(x[d <= cut[1]], depth - 1), grow(x[d > cut[1]], depth - 1))


def _sides(d: np.ndarray, radius: int, home: np.ndarray, reach: int):
    """For each side of a boundary (who goes there, who of them lives there)."""
    inner = d <= radius
    yield (home & inner) | (~home & (d - reach <= radius)), home & inner
    yield (home & ~inner) | (d + reach > radius) & (~home | inner), home & ~inner


def route(x: np.ndarray, tree, reach: int, live_here: bool = True):
    """(shard, positions in x, which of them live there) for every shard; without ``live_here`` all only visit."""
    todo, leaf = [(tree, np.arange(len(x)), np.full(len(x), live_here))], 0
    while todo:
        node, at, home = todo.pop()
        if node is None:
            yield leaf, at, home
            leaf += 1
            continue
        v, radius, inner, outer = node
        for child, (go, live) in zip((inner, outer), _sides(_far(x[at], v), radius, home, reach)):
            todo.append((child, at[go], live[go]))


def near_pairs(x: np.ndarray, home: np.ndarray, reach: int):
    """Blocks of (i, j) within ``reach``: residents with each other and visitors with residents."""
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        live, visit = todo.pop()
        if not len(live):
            continue
        cut = _vantage(x[live]) if len(live) * (len(live) + len(visit)) > BLOCK and len(live) > 64 else None
        if cut is None:
            step = max(1, BLOCK // len(live))
            both = np.concatenate([live, visit])
            for s in range(0, len(both), step):
                i, j = np.nonzero(np.bitwise_count(x[both[s : s + step], None] ^ x[None, live]) <= reach)
                own = both[s + i] != live[j]
                yield both[s + i][own], live[j][own]
            continue
        at, lives = np.concatenate([live, visit]), np.arange(len(live) + len(visit)) < len(live)
        for go, stay in _sides(_far(x[at], cut[0]), cut[1], lives, reach):
            todo.append((at[stay], at[go & ~stay]))


def forest(n: int, pairs, holds=None) -> np.ndarray:
    """Smallest reachable position of each of n positions over blocks of pairs.

    With ``holds`` a pair links only where it says so; pairs whose ends are
    linked already aren't asked about.
    """
    label = np.arange(n)
    for i, j in pairs:
        step = len(i) if holds is None else 2048
        for s in range(0, len(i), max(1, step)):
            a, b = i[s : s + step], j[s : s + step]
            if holds is not None:
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                if len(a):
                    good = holds(a, b)
                    a, b = a[good], b[good]
            while len(a):
                la, lb = label[a], label[b]
                apart = la != lb
                if not apart.any():
                    break
                a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while ((deeper := label[label]) != label).any():
                    label = deeper
    return label


def near_duplicates(docs: DataFrame, words: int = 4, reach: int = 4, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = staged(fingerprints(docs, words), "fingerprints")
    least = staged(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("least")), "distinct")
    n = least.count()
    sampled = least.where(F.pmod(F.xxhash64("print"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 30)))
    sample = np.sort(np.array([r[0] for r in sampled.select("print").limit(2 * SAMPLE).collect()], np.int64)).view(np.uint64)
    tree = grow(sample, max(0, int(np.ceil(np.log2(max(n, 1) / shard))))) if len(sample) else None

    def deal(batches):
        for b in batches:
            x = b.column("print").to_numpy().view(np.uint64)
            for k, at, home in route(x, tree, reach):
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), b.column("print").take(pa.array(at)), b.column("least").take(pa.array(at)), pa.array(home)], ["shard", "print", "least", "home"])

    def link(t: pa.Table) -> pa.Table:
        t = t.sort_by("least")
        label = forest(t.num_rows, near_pairs(t.column("print").to_numpy().view(np.uint64), t.column("home").to_numpy(), reach))
        a = np.flatnonzero(label != np.arange(t.num_rows))
        ids = t.column("least").to_numpy()
        return pa.table({"a": ids[a], "b": ids[label[a]]})

    dealt = least.mapInArrow(deal, "shard int, print long, least long, home boolean")
    found = components(dealt.groupBy("shard").applyInArrow(link, "a long, b long"))
    named = least.join(found, F.col("least") == F.col("node"), "left").select(F.col("print").alias("of"), F.coalesce("component", "least").alias("component"))
    return prints.join(named, F.col("print") == F.col("of"), "left").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    )


#: The stage's signatures: BANDS groups of ROWS minima of shingle hashes.  Texts with a likeness of 0.8 share none of the
#: groups with a chance of (1 - 0.8^5)^24, 0.00007.  A candidate component is compared in tiles of two times TILE texts.
BANDS, ROWS, TILE = 24, 5, 4096
#: Pairs whose share of equal minima is lower by this than the similarity aren't compared in full: the share's standard error
#: is 0.037 at a likeness of 0.8.
MARGIN = 0.2
_MIX = np.random.default_rng(5).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def minima(u: np.ndarray) -> np.ndarray:
    """The least of the shingle hashes in each of BANDS x ROWS orders; the largest number without any."""
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for s in range(0, len(u), 4096):
        x = (u[s : s + 4096] ^ _MIX[0]) * _MIX[1]
        np.minimum(out, (x ^ (x >> np.uint64(32))).min(1), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    keys = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        keys = (keys ^ m[k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _in_full(one: bytes, other: bytes) -> float:
    """Jaccard likeness of two sets given as sorted hashes."""
    a, b = np.frombuffer(one, "<u8"), np.frombuffer(other, "<u8")
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def alike(docs: DataFrame, words: int = 5, similarity: float = 0.8, reach: int = 24) -> DataFrame:
    """(doc_id, text_key, component) of documents by shingle likeness, each link verified on whole shingle sets.

    1. Distinct sets of shingles that share a band of minima hang together in
       candidate components: each member of a band is tied to its least one, so
       no pairs are emitted.
    2. A component's texts meet in tiles of bounded size, small components
       several to a tile.  There the fingerprints of the distinct shingles are
       searched within ``reach`` bits by vantage-point trees, pairs that sizes or
       minima rule out fall away, and the whole sets of the others are compared,
       unless both are linked already.

    A likeness of 0.8 leaves fingerprints some 10 bits apart, give or take 3.  A
    component is named by the hash of a set.
    """
    import xxhash

    def describe(full: bool):
        names, kinds = ["doc_id", "text_key", "node", "print", "size", "bands"], (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        if full:
            names, kinds = ["group", "parts", "node", "print", "size", "minima", "shingles"], (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

        def run(batches):
            for b in batches:
                for part in slices(b):
                    rows = []
                    for t in part.column("text").to_pylist():
                        u = np.unique(shingle_hashes(t, words))
                        raw, m = u.tobytes(), minima(u)
                        node = int(np.uint64(xxhash.xxh64_intdigest(raw, 7)).view(np.int64))
                        rows.append((node, majority(u), len(u), m.astype("<u2").tobytes(), raw) if full else (node, majority(u), len(u), band_keys(m).tolist()))
                    yield pa.RecordBatch.from_arrays([part.column(names[0]), part.column(names[1]), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names)

        return run

    keyed = id_and_text(docs).where("doc_id is not null").withColumn("text_key", F.xxhash64("text"))
    marks = staged(keyed.mapInArrow(describe(False), "doc_id long, text_key long, node long, print long, size long, bands array<long>"), "marks")
    nodes = staged(marks.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("bands").alias("bands")), "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    least = banded.groupBy("band", "key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    tied = components(banded.join(least, ["band", "key"]).where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    tied = staged(tied.union(tied.select(F.col("component").alias("node"), "component").distinct()), "tied")
    sizes = tied.groupBy("component").agg(F.count("*").alias("n"))
    small = F.lit(max(1, -(-tied.count() // TILE)))
    members = tied.join(sizes, "component").join(nodes.select("node", "first"), "node").select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), F.col("component").alias("group"), F.ceil(F.col("n") / TILE).cast("long").alias("parts")
    )
    whole = keyed.dropDuplicates(["doc_id", "text_key"]).join(members, ["doc_id", "text_key"]).select("group", "parts", "text")
    sets = whole.mapInArrow(describe(True), "group long, parts long, node long, print long, size long, minima binary, shingles binary")
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j")))
    dealt = sets.withColumn("tile", F.explode(tiles)).select(
        F.when(F.col("parts") > 1, F.xxhash64("group")).otherwise(F.pmod(F.xxhash64("group"), small)).alias("group"), "tile.i", "tile.j", "node", "print", "size", "minima", "shingles", (part == F.col("tile.i")).alias("home")
    )

    def link(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        full, size = t.column("shingles").to_pylist(), t.column("size").to_numpy().astype(float)
        signs = np.frombuffer(b"".join(t.column("minima").to_pylist()), "<u2").reshape(t.num_rows, -1)

        def holds(a, b):
            good = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9
            good[good] = (signs[a[good]] == signs[b[good]]).mean(1) >= similarity - MARGIN
            good[good] = [_in_full(full[i], full[j]) >= similarity for i, j in zip(a[good].tolist(), b[good].tolist())]
            return good

        label = forest(t.num_rows, near_pairs(t.column("print").to_numpy().view(np.uint64), t.column("home").to_numpy(), reach), holds)
        a, ids = np.flatnonzero(label != np.arange(t.num_rows)), t.column("node").to_numpy()
        return pa.table({"a": ids[a], "b": ids[label[a]]})

    found = components(dealt.groupBy("group", "i", "j").applyInArrow(link, "a long, b long")).withColumnRenamed("node", "of")
    return marks.join(found, F.col("node") == F.col("of"), "left").select("doc_id", "text_key", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest doc_id (and text hash, where an id has several texts).

    Rows with no id stay; a null text counts as the empty one, and all texts
    without words are one group; of rows that repeat id and text one stays;
    other columns stay, whatever their names; an empty table stays empty.
    """
    first = alike(docs, words, similarity).groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    own_id, own_key = free_name(docs, "id"), free_name(docs, "key")
    chosen = first.select(F.col("first.doc_id").alias(own_id), F.col("first.text_key").alias(own_key))
    named = docs.where("doc_id is not null").withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_key, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = named.dropDuplicates([own_id, own_key]).join(chosen, [own_id, own_key], "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where("doc_id is null"))
