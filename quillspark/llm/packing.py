"""Operator 8: packing documents into sequences by best-two-fit.

Documents are encoded where they lie; only those longer than a sequence are cut
(the first piece takes the rest, all others are full).  Pieces are dealt by a
hash of their place in the table (so repeated ids and rows spread as well) into groups of a bounded size, the number of groups growing with the
table, and each group is packed on its histogram of lengths: a sequence is
filled greedily from the longest piece that fits, then its smallest piece is
replaced by the two unpacked ones that fit the widened gap more tightly, where
there are such.  Each group ends with at most a few open sequences.

Defined results: a null text counts as the empty one and has the end id alone;
a null doc_id stays null; repeated rows are packed each; an empty table gives
no rows; other columns are ignored.  Within a group pieces of one length are
taken by doc_id, piece and crc, so ties don't depend on the order of arrival.
A batch is encoded in parts of at most 4 MB of text, a longer text by itself.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import BytePairs
from .common import id_and_text, slices

#: Documents a group is meant to have; a group's rows are some 50 bytes each.
GROUP = 8192
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n tokens."""
    return ([n % most] if n % most else []) + [most] * (n // most)


def best_two_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length; sequences count from 0."""
    order = np.argsort(lengths, kind="stable")
    ends = np.searchsorted(lengths[order], np.arange(most + 2))
    left = np.diff(ends).tolist()  # by length
    mask = sum(1 << x for x in np.unique(lengths).tolist())
    bins: list[list[int]] = []

    def take(x: int) -> None:
        nonlocal mask
        left[x] -= 1
        if not left[x]:
            mask ^= 1 << x

    def largest(x: int) -> int:
        return (mask & ((2 << x) - 1)).bit_length() - 1 if x > 0 else -1

    while mask:
        own, gap = [], most
        while (x := largest(gap)) > 0:
            take(x)
            own.append(x)
            gap -= x
        if gap and len(own) > 1:
            least = own[-1]
            room, best = gap + least, (least, 0, 0)
            a = largest(room // 2)
            while a > 0 and best[0] < room:
                b = largest(room - a)
                if b == a and left[a] < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                a = largest(a - 1)
            if best[1]:
                own.pop()
                if not left[least]:
                    mask |= 1 << least
                left[least] += 1
                take(best[1])
                take(best[2])
                own += best[1:]
        bins.append(own)
    at = ends[:-1].copy()
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, own in enumerate(bins):
        place = 0
        for x in own:
            i = order[at[x]]
            at[x] += 1
            sequence[i], offset[i] = k, place
            place += x
    return sequence, offset


def cut_documents(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their ids (32-bit bytes) on demand."""
    schema = PIECE + (", ids binary" if with_ids else "")

    def run(batches):
        coder, end = BytePairs.of(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for part in slices(b):
                rows = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), coder.encode(part.column("text"))):
                    ids, start = ids + end, 0
                    for k, n in enumerate(cut(len(ids) // 4, most)):
                        own = ids[start * 4 : (start + n) * 4]
                        rows.append((doc, k, start, n, zlib.crc32(own), own))
                        start += n
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(zip(*rows), kinds))[: 5 + with_ids]], [x.split()[0] for x in schema.split(", ")])

    return id_and_text(docs).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 0, with_ids: bool = True, group: int = GROUP) -> DataFrame:
    """Every piece with its sequence_id and its offset there, gapless from 0."""
    groups = max(1, -(-docs.count() // group))
    pieces = cut_documents(docs, tokenizer, most, end_id, with_ids).withColumn("bin_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    schema = PIECE + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"

    def fill(t: pa.Table) -> pa.Table:
        # packing mustn't depend on the order in which rows arrive
        t = t.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "ids_crc32")])
        sequence, offset = best_two_fit(t.column("length").to_numpy(), most)
        own = t.column("bin_group")[0].as_py()
        return t.drop_columns(["bin_group"]).append_column("sequence_id", pa.array(sequence + (own << 32))).append_column("offset", pa.array(offset))

    return pieces.groupBy("bin_group").applyInArrow(fill, schema)
