"""Operator 11: alignment of two tokenizers over the same bytes.

1. Each text is encoded by both tokenizers; a token's bytes follow from its id,
   so running sums of their lengths are byte offsets in the text.
2. ``pandas.merge_asof`` over a batch, keyed by document: the start of each token
   of one side finds the token of the other side that covers it.  Every
   overlapping pair of tokens is found from the later of its two starts, so the
   union of both directions, equal starts once, is all overlaps.  Where starts
   are equal the tokens before them end together: those places cut the groups.
3. A task gathers some BLOCK bytes of text into a block: the distinct id pairs
   linked in it, numbered, with the number of its documents that hold them, and
   for each document the numbers of its pairs and how often they are linked.
   Blocks are written; texts and links aren't needed again.
4. The blocks' counts are added up by pair; the best count of each id of A is a
   row per id of its vocabulary.  Counts come back to the blocks by a join, a
   row per block and distinct pair, and each block weighs its documents.

A pair has at most one row per block whatever it is in, and a block has a bounded
size whatever its documents, so no key is hot.  Corpus counts are exact.

Defined results: a null or empty text, or one whose joined bytes of either side
differ from a space and the text, has no tokens: zeros and the digest ''.
Strings of special tokens inside texts are plain text.  Repeated rows are
documents of their own; a null doc_id stays null; ties for the highest count of
an id all count as best; other columns are ignored; an empty table gives an
empty result.  Texts are taken in parts of at most 1 MB, a longer text by itself.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .chunks import _UNEVEN, LONGEST_KEPT, MOST_WORDS, BytePairs, Pieces, _tables, alphabet, join_ids
from .common import id_and_text, new_path, slices

#: Bytes of text aligned at once, and bytes of text of a block.
AT_ONCE, BLOCK = 1 << 20, 16 << 20
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
HELD = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary, pairs binary, in_docs binary"


class Side(BytePairs):
    """Byte-level BPE of a space and the text, strings of special tokens being plain text; ``bytes_of`` an id."""

    def __init__(self, path: str):
        super().__init__(path)
        self.lib.encode_special_tokens = self.words.encode_special_tokens = True
        special = [t for t in self.lib.get_added_tokens_decoder().values() if not t.special]
        self.added = [t.content for t in special]
        table, names = alphabet(), {i: t for t, i in self.lib.get_vocab(with_added_tokens=True).items()}
        self.bytes_of = [bytes(table[c] for c in names[i]) if i in names and all(c in table for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]

    def spaced(self, texts: pa.Array) -> list[bytes]:
        """Ids as 32-bit bytes of each text behind a space."""
        uneven = pc.match_substring_regex(texts, _UNEVEN)
        for a in self.added:
            uneven = pc.or_(uneven, pc.match_substring(texts, a))
        uneven = uneven.to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        even = np.flatnonzero(~uneven)
        if len(even):
            # every chunk but a line break stands behind a space, the first one too
            lists = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " ")
            chunks, ends = lists.flatten().dictionary_encode(), np.cumsum(lists.value_lengths().to_numpy())
            for i, ids in zip(even.tolist(), join_ids(self._table(chunks.dictionary), chunks.indices.to_numpy().astype(np.int64), ends)):
                out[i] = ids
        rest = np.flatnonzero(uneven)
        for i, ids in zip(rest.tolist(), self._spaced_out([" " + t for t in texts.take(pa.array(rest)).to_pylist()])):
            out[i] = ids
        return out


class Marked(Pieces):
    """SentencePiece ids of texts alone, without begin and end: each distinct marked word is segmented once, nothing is decoded."""

    def __init__(self, path: str):
        super().__init__(path)
        self.ids_of: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        known = self.ids_of
        if len(known) > MOST_WORDS:
            known.clear()
        lists = [self.marked(t) for t in texts]
        new = list({w for own in lists for w in own if w not in known})
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            # a word of no characters is a marker alone, which the library doesn't add to an empty text
            found = self.lib.encode([w.replace(self.MARK, " ") for w in part], num_threads=1)
            known.update((w, array("I", x if w else [self.lib.piece_to_id(self.MARK)]).tobytes()) for w, x in zip(part, found))
        out = [b"".join([known[w] for w in own]) for own in lists]
        for w in new:
            if len(w) > LONGEST_KEPT:
                del known[w]
        return out


class Both:
    """The two tokenizers of a worker, with what their ids stand for."""

    def __init__(self, bpe: str, pieces: str):
        self.a, self.b = Side(bpe), Marked(pieces)
        lib = self.b.lib
        names = [(i, lib.id_to_piece(i)) for i in range(lib.get_piece_size())]
        self.bytes_a, self.bytes_b = self.a.bytes_of, [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in names]
        self.sizes = [np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b)]
        most = len(str(max(len(self.bytes_a), len(self.bytes_b))))
        #: the decimal digits of every id, a row each, and their number
        self.digits = np.array([list(str(i).ljust(most + 1).encode()) for i in range(max(len(self.bytes_a), len(self.bytes_b)))], np.uint8)
        self.n_digits = np.array([len(str(i)) for i in range(len(self.digits))])

    @classmethod
    def of(cls, bpe: str, pieces: str) -> "Both":
        if ("both", bpe, pieces) not in _tables:
            _tables["both", bpe, pieces] = cls(bpe, pieces)
        return _tables["both", bpe, pieces]

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of each text; none where either side's bytes aren't a space and the text."""
        plain = texts.to_pylist()
        out = []
        for t, a, b in zip(plain, self.a.spaced(texts), self.b.ids(plain)):
            a, b = np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64)
            want = b" " + t.encode()
            if not t or b"".join([self.bytes_a[i] for i in a.tolist()]) != want or b"".join([self.bytes_b[i] for i in b.tolist()]) != want:
                a = b = a[:0]
            out.append((a, b))
        return out


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray):
    """Positions (i, j) of all overlapping tokens in order of their later starts, and which tokens of A and of B start
    where one of the other side does.  Tokens follow each other without gaps; starts rise over all documents."""
    a = pd.DataFrame({"doc": doc_a, "at": start_a, "i": np.arange(len(start_a))})
    b = pd.DataFrame({"doc": doc_b, "at": start_b, "j": np.arange(len(start_b))})
    j = pd.merge_asof(a, b, on="at", by="doc")["j"].to_numpy(np.int64)
    i = pd.merge_asof(b, a, on="at", by="doc")["i"].to_numpy(np.int64)
    same_a, same_b = start_b[j] == start_a, start_a[i] == start_b
    later = np.flatnonzero(~same_b)
    return np.r_[np.arange(len(j)), i[later]], np.r_[j, later], same_a, same_b


def group_digests(both: Both, a: np.ndarray, b: np.ndarray, same_a: np.ndarray, same_b: np.ndarray, docs_of_groups: np.ndarray) -> dict[int, str]:
    """SHA-256 of ``a1,a2|b1;...`` of each document, by its number."""
    group_a, group_b = np.cumsum(same_a) - 1, np.cumsum(same_b) - 1
    n = len(docs_of_groups)
    many_a, many_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    # tokens in the order of the text: groups, in each A before B
    place_a = np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(many_a)[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    ends = np.cumsum(many_a + many_b)
    mark[ends - many_b - 1], mark[ends - 1] = ord("|"), ord(";")
    rows, size = both.digits[ids], both.n_digits[ids]
    rows[np.arange(len(ids)), size] = mark
    text = rows[np.arange(rows.shape[1]) <= size[:, None]]
    last = np.flatnonzero(np.r_[docs_of_groups[1:] != docs_of_groups[:-1], True])
    cuts = np.r_[0, np.cumsum(size + 1)[ends[last] - 1]].tolist()
    held = memoryview(text)
    return {int(d): hashlib.sha256(held[x : y - 1]).hexdigest() for d, x, y in zip(docs_of_groups[last], cuts, cuts[1:])}


def align(both: Both, texts: pa.Array):
    """(counts by document as rows of COUNTS, digests, and for each linked id pair of a document: document, pair, links)."""
    coded = both.encode(texts)
    n, width = len(coded), len(both.bytes_b)
    a, b = (np.concatenate([c[k] for c in coded]) for k in (0, 1))
    counts = np.zeros((4, n), np.int64)
    counts[0], counts[1] = [len(c[0]) for c in coded], [len(c[1]) for c in coded]
    if not len(a):
        return counts, [""] * n, np.zeros((3, 0), np.int64)
    doc_a, doc_b = np.repeat(np.arange(n), counts[0]), np.repeat(np.arange(n), counts[1])
    start_a, start_b = (np.cumsum(s[x]) - s[x] for s, x in zip(both.sizes, (a, b)))
    i, j, same_a, same_b = overlaps(doc_a, start_a, doc_b, start_b)
    counts[2], counts[3] = np.bincount(doc_a[same_a], minlength=n), np.bincount(doc_a[i], minlength=n)
    digests = group_digests(both, a, b, same_a, same_b, doc_a[same_a])
    pairs, times = np.unique(doc_a[i] * (width * len(both.bytes_a)) + a[i] * width + b[j], return_counts=True)
    doc, pair = np.divmod(pairs, width * len(both.bytes_a))
    return counts, [digests.get(d, "") for d in range(n)], np.stack([doc, pair, times])


def _packed(x: np.ndarray) -> bytes:
    """Small numbers as 32-bit ones, all lowest bytes first, so that they compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _blocks(bpe: str, pieces: str):
    names = [c.split()[0] for c in HELD.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 4

    def emit(block: int, ids: list, parts: list):
        counts, digests, links = (list(x) for x in zip(*parts))
        counts, digests = np.concatenate(counts, axis=1), [d for own in digests for d in own]
        shift = np.cumsum([0, *[len(d) for d in (p[1] for p in parts)]])
        doc = np.concatenate([x[0] + s for x, s in zip(links, shift)])
        pairs, codes = np.unique(np.concatenate([x[1] for x in links]), return_inverse=True)
        times = np.concatenate([x[2] for x in links])
        cuts = np.searchsorted(doc, np.arange(len(digests) + 1))
        for at in range(0, len(digests), 256):
            own = list(zip(cuts[at : at + 256].tolist(), cuts[at + 1 : at + 257].tolist()))
            # a document's pairs rise, so their numbers are kept as differences
            held = [[_packed(np.diff(codes[x:y], prepend=0)) for x, y in own], [_packed(times[x:y]) for x, y in own]]
            n = len(own)
            columns = [[block] * n, pa.concat_arrays(ids).slice(at, n), *counts[:, at : at + n], digests[at : at + n], *held, [None] * n, [None] * n]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names)
        columns = [block, *[None] * 8, pairs.astype("<i8").tobytes(), _packed(np.bincount(codes, minlength=len(pairs)))]
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names)

    def run(batches):
        from pyspark import TaskContext

        both, block, held, ids, parts = Both.of(bpe, pieces), TaskContext.get().partitionId() << 32, 0, [], []
        for b in batches:
            for part in slices(b, AT_ONCE):
                ids.append(part.column("doc_id"))
                parts.append(align(both, part.column("text")))
                held += part.column("text").nbytes
                if held >= BLOCK:
                    yield from emit(block, ids, parts)
                    block, held, ids, parts = block + 1, 0, [], []
        if ids:
            yield from emit(block, ids, parts)

    return run


def _pairs(batches):
    """A row for each distinct pair of a block, with its number there."""
    for b in batches:
        for block, pairs, in_docs in zip(*(b.column(c).to_pylist() for c in ("block", "pairs", "in_docs"))):
            pairs, n = np.frombuffer(pairs, "<i8"), _unpacked(in_docs)
            for at in range(0, len(pairs), 1 << 16):
                own = pairs[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block)), pa.array(np.arange(at, at + len(own), dtype=np.int32)), pa.array(own), pa.array(n[at : at + len(own)].astype(np.int64))], ["block", "code", "pair", "n"])


def _weighed(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """A block's documents with the counts of their pairs."""
    code = answers.column("code").to_numpy()
    count, best = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
    count[code], best[code] = answers.column("count").to_numpy(), answers.column("best").to_numpy()
    sums, bests = [], []
    for codes, times in zip(docs.column("codes").to_pylist(), docs.column("times").to_pylist()):
        codes, times = np.cumsum(_unpacked(codes).astype(np.int64)), _unpacked(times).astype(np.int64)
        sums.append(int(count[codes] @ times))
        bests.append(int(times[best[codes]].sum()))
    kept = docs.select(["doc_id", *COUNTS])
    return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256"))


def aligned_blocks(docs: DataFrame, bpe: str, pieces: str) -> DataFrame:
    """The written blocks: a row per document, and a row per block with its pairs."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "alignment")
    id_and_text(docs).mapInArrow(_blocks(bpe, pieces), HELD).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(HELD).parquet(path)


def pair_counts(blocks: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(block, code, pair, n) of every block, and over all of them (pair, count, best): documents that hold the pair, and
    whether no pair with the same id of A is in more."""
    rows = blocks.where("pairs is not null").select("block", "pairs", "in_docs").mapInArrow(_pairs, "block long, code int, pair long, n long")
    total = rows.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.expr(f"pair div {width}"))
    most = total.groupBy("a").agg(F.max("count").alias("most"))  # a row per id of A's vocabulary at most
    return rows, total.join(F.broadcast(most), "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def cross_align(docs: DataFrame, bpe: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    width = len(Both.of(bpe, pieces).bytes_b)
    blocks = aligned_blocks(docs, bpe, pieces)
    rows, marked = pair_counts(blocks, width)
    answers = rows.select("block", "code", "pair").join(marked, "pair").select("block", "code", "count", "best")
    own = blocks.where("pairs is null").select("block", "doc_id", *COUNTS, "groups_sha256", "codes", "times")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_weighed, out)
