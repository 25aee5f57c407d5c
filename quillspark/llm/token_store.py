"""Operator 4: token ids as raw binary shards with a minimal perfect hash index.

Texts are dealt to tasks by ranges of doc_id and sorted there; each task encodes
its range and writes one shard of two files into the folder given:

``*.ids``  the ids of its documents one after another, little-endian unsigned
           16-bit (32-bit where the vocabulary needs it), nothing else;
``*.idx``  NumPy arrays: the documents' keys and offsets in file order, and a
           minimal perfect hash over the distinct keys, built in levels of bits,
           whose slots hold a 32-bit fingerprint, the first row and the number of rows.

A key is found in constant time: a bit or two, a rank, one slot, one comparison.
The number of shards follows the bytes of the texts.
File names carry a random part and only committed tasks put theirs into the
manifest, so retried, speculative and lost tasks leave nothing that is read.

Defined results: a null text counts as the empty one (the end id alone); rows
with a null doc_id come first, are stored and scanned, and can't be looked up;
repeated doc_ids are stored in turn (in no fixed order among themselves) and a
lookup returns each of their rows; an empty table gives an empty store; other
columns are ignored.  A batch is encoded in parts of at most 4 MB of text, a
longer text by itself.
"""

from __future__ import annotations

import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .chunks import BytePairs
from .common import id_and_text, new_path, slices

AT_ONCE = 256
#: Bytes of text that a shard is meant to have, and levels of the hash; a level takes some three fifths of the keys it gets.
SHARD_BYTES, LEVELS = 32 << 20, 32
MANIFEST = "shard int, ids_path string, idx_path string, n_docs long, n_tokens long, least long, most long"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser over keys; two seeds give independent hashes."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build_hash(keys: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The minimal perfect hash of distinct int64 keys, and by slot the position of its key.

    At each level the keys left are hashed into twice as many bits; those alone
    at theirs set it, the others go on to the next level.  A key's slot is the
    rank of its bit over all levels.  The few keys that no level takes are
    listed, in order, behind the others.
    """
    left, bits, sizes = np.arange(len(keys)), [], []
    owner = []
    while len(left) and len(sizes) < LEVELS:
        n = -(-2 * len(left) // 64) * 64
        at = _at(keys[left], len(sizes), n)
        alone = np.bincount(at, minlength=n)[at] == 1
        own = np.full(n, -1, np.int64)
        own[at[alone]] = left[alone]
        bits.append(np.packbits(own >= 0, bitorder="little").view("<u8"))
        owner.append(own[own >= 0])
        sizes.append(n)
        left = left[~alone]
    left = left[np.argsort(keys[left])]
    words = np.concatenate(bits or [np.zeros(0, "<u8")])
    ones = np.bitwise_count(words).astype(np.int64)
    return {"bits": words, "rank": np.cumsum(ones) - ones, "sizes": np.array(sizes, np.int64), "rest": keys[left]}, np.concatenate([*owner, left]).astype(np.int64)


def _at(keys: np.ndarray, level: int, n: int) -> np.ndarray:
    return (_mix(keys, level + 1) % np.uint64(n)).astype(np.int64)


def find(keys: np.ndarray, ix: dict[str, np.ndarray], prints: np.ndarray) -> np.ndarray:
    """Slots of the keys, -1 where the stored fingerprint differs."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, n in enumerate(ix["sizes"].tolist()):
        at = _at(keys[left], level, n) + base
        word, bit = ix["bits"][at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit) & np.uint64(1) > 0
        below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        out[left[hit]] = (ix["rank"][at >> 6] + below)[hit]
        left, base = left[~hit], base + n
    rest = ix["rest"]
    if len(rest) and len(left):
        at = np.minimum(np.searchsorted(rest, keys[left]), len(rest) - 1)
        out[left] = np.where(rest[at] == keys[left], len(prints) - len(rest) + at, -1)
    known = out >= 0
    out[known] = np.where(prints[out[known]] == _print(keys[known]), out[known], -1)
    return out


def _print(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 0) >> np.uint64(32)).astype(np.uint32)


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, shards: int | None = None) -> str:
    """Encode every document, append ``end_id``, write the shards and their manifest; returns the folder."""
    spark = docs.sparkSession
    folder = (folder or new_path(spark, "tokens")).rstrip("/")

    def run(batches):
        from pyspark import TaskContext

        coder = BytePairs.of(tokenizer)
        kind = np.dtype("<u2" if coder.lib.get_vocab_size() <= 1 << 16 else "<u4")
        shard, end = TaskContext.get().partitionId(), np.array([end_id], kind).tobytes()
        store, root = _files(folder)
        name, keys, missing, counts, out = f"{shard:06d}-{uuid.uuid4().hex}", [], [], [], None
        for b in batches:
            for part in slices(b):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}.ids")
                got = [np.frombuffer(x, "<u4").astype(kind).tobytes() + end for x in coder.encode(part.column("text"))]
                out.write(b"".join(got))
                counts += [len(x) // kind.itemsize for x in got]
                missing.append(part.column("doc_id").is_null().to_numpy(zero_copy_only=False))
                keys.append(part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        keys, missing = np.concatenate(keys).astype(np.int64), np.concatenate(missing)
        known = np.flatnonzero(~missing)
        one, first, rows = np.unique(keys[known], return_index=True, return_counts=True)
        hashed, slots = build_hash(one)
        held = io.BytesIO()
        np.savez(held, width=kind.itemsize, keys=keys, missing=missing, offsets=np.concatenate([[0], np.cumsum(counts)]), **hashed, prints=_print(one[slots]), first=known[first][slots] if len(known) else first, rows=rows[slots])
        with store.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(held.getvalue())
        bounds = [[int(one[0])], [int(one[-1])]] if len(one) else [[None], [None]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}.ids"]), pa.array([f"{folder}/{name}.idx"]), *[pa.array(x, pa.int64()) for x in ([len(keys)], [int(sum(counts))], *bounds)]],
            [x.split()[0] for x in MANIFEST.split(", ")],
        )

    rows = id_and_text(docs)
    if not shards:
        shards = max(1, -(-int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    rows = rows.repartitionByRange(shards, "doc_id")
    rows.sortWithinPartitions("doc_id").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard with ``base``, the number of ids in the shards before it."""
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("base", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)))


def _open(store_of, idx_path: str):
    store, path = store_of(idx_path)
    with store.open_input_stream(path) as f:
        return dict(np.load(io.BytesIO(f.read())))


FOUND = "doc_id long, start long, n_tokens long, ids binary"
FOUND_CRC = "doc_id long, start long, n_tokens long, ids_crc32 long"
OUT, OUT_CRC = [pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last]) for last in (("ids", pa.binary()), ("ids_crc32", pa.int64()))]


def _payload(f, ix: dict, base: int, rows: np.ndarray, digests: bool):
    """The given rows of an open payload file as record batches, ids as 32-bit bytes or their crc32."""
    width, off = int(ix["width"]), ix["offsets"]
    for at in range(0, len(rows), AT_ONCE):
        own, ids = rows[at : at + AT_ONCE], []
        for r in own:
            ids.append(np.frombuffer(f.read_at(int(off[r + 1] - off[r]) * width, int(off[r]) * width), f"<u{width}").astype("<u4").tobytes())
        last = pa.array([zlib.crc32(x) for x in ids], pa.int64()) if digests else pa.array(ids, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ix["keys"][own], pa.int64(), mask=ix["missing"][own]), pa.array(off[own] + base, pa.int64()), pa.array(off[own + 1] - off[own], pa.int64()), last],
            [x.split()[0] for x in (FOUND_CRC if digests else FOUND).split(", ")],
        )


def read_store(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """Every document of the store, each found by its key through the shard's hash index."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ix = _open(_files, row["idx_path"])
                keys = ix["keys"][~ix["missing"]]
                slots = find(np.unique(keys), ix, ix["prints"])
                if (slots < 0).any():
                    raise RuntimeError(f"the index of {row['idx_path']} doesn't know its own keys")
                first, count = ix["first"][slots], ix["rows"][slots]
                rows = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(first) else first, count) + np.arange(count.sum())
                store, path = _files(row["ids_path"])
                with store.open_input_file(path) as f:
                    yield from _payload(f, ix, row["base"], np.sort(np.concatenate([np.flatnonzero(ix["missing"]), rows]).astype(np.int64)), digests)

    shards = manifest(spark, folder)
    return shards.repartition(max(1, spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").count())).mapInArrow(run, FOUND_CRC if digests else FOUND)


def lookup(spark: SparkSession, folder: str, keys: DataFrame, digests: bool = False) -> DataFrame:
    """The stored rows of the distinct ``doc_id`` of ``keys``; unknown ones give no row.

    The shards' ranges of keys don't overlap, so a key is routed by a search
    among their bounds, 24 bytes a shard of SHARD_BYTES of text; keys then meet
    their shard's files by an equi-join, and each shard is opened once.
    """
    shards = manifest(spark, folder)
    bounds = shards.where("least is not null").select("shard", "least", "most").orderBy("least").toArrow()
    number, least, most = [bounds.column(c).to_numpy() for c in bounds.column_names]

    def route(batches):
        for b in batches:
            want = b.column("doc_id").to_numpy(zero_copy_only=False)
            at = np.searchsorted(least, want, "right") - 1
            own = at >= 0
            own[own] = want[own] <= most[at[own]]
            yield pa.RecordBatch.from_arrays([pa.array(want[own], pa.int64()), pa.array(number[at[own]], pa.int32())], ["doc_id", "at"])

    def read(t: pa.Table) -> pa.Table:
        row = t.slice(0, 1).to_pylist()[0]
        own = np.sort(t.column("doc_id").to_numpy())
        ix = _open(_files, row["idx_path"])
        slots = find(own, ix, ix["prints"])
        slots = slots[slots >= 0]
        rows = np.concatenate([np.arange(f, f + c) for f, c in zip(ix["first"][slots], ix["rows"][slots])] or [np.zeros(0)]).astype(np.int64)
        rows = rows[np.isin(ix["keys"][rows], own)]
        store, path = _files(row["ids_path"])
        with store.open_input_file(path) as f:
            return pa.Table.from_batches(_payload(f, ix, row["base"], rows, digests), OUT_CRC if digests else OUT)

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    routed = wanted.mapInArrow(route, "doc_id long, at int").join(shards.select("shard", "base", "ids_path", "idx_path"), F.col("at") == F.col("shard")).drop("at")
    return routed.groupBy("shard").applyInArrow(read, FOUND_CRC if digests else FOUND)
