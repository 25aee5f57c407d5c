"""Operator 5: SentencePiece encoding and decoding through a distinct-chunk table.

Every whole text is cut into marked words, the distinct ones are segmented once
per worker, and their ids are joined back by position.  Nothing is shuffled.

Defined results: a null text counts as the empty one; the empty text has the
begin and end ids alone and decodes to the empty text; repeated rows give
repeated results; a null doc_id stays null; columns other than doc_id and text
are ignored, whatever their names.  A batch is encoded in parts of at most 1 MB
of text, a longer text by itself.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .chunks import Pieces
from .common import id_and_text, slices

#: Id lists decoded at a time.
AT_ONCE = 256


def encode_pieces(docs: DataFrame, model: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, 32-bit little-endian) and decoded, or with ``digests`` the SHA-256 of both instead."""
    names = ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")

    def run(batches):
        coder = Pieces.of(model)
        for b in batches:
            for part in slices(b, 1 << 20):
                got = coder.encode(part.column("text").to_pylist())
                counts = [len(x) // 4 for x, _ in got]
                if digests:
                    one = [hashlib.sha256(x).hexdigest() for x, _ in got]
                    two = [hashlib.sha256(d.encode()).hexdigest() for _, d in got]
                else:
                    one, two = pa.array([x for x, _ in got], pa.binary()), [d for _, d in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(one), pa.array(two, pa.string())],
                    ["doc_id", "n_tokens", *[x.split()[0] for x in names.split(", ")]],
                )

    return id_and_text(docs).mapInArrow(run, f"doc_id long, n_tokens long, {names}")


def decode_pieces(ids: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) back to (doc_id, decoded), with the library's own decoder."""

    def run(batches):
        import numpy as np

        lib = Pieces.of(model).lib
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                lists = [np.frombuffer(x or b"", "<u4").tolist() for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lib.decode(lists, num_threads=1), pa.string())], ["doc_id", "decoded"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded string")
