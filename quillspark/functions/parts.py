"""Python functions over texts that hold a few megabytes at a time, whatever an Arrow batch holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

#: Bytes of text taken at once.
PART = 4 << 20


def parts(texts: pa.Array, most_bytes: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, end) of slices of at most PART bytes; a longer text by itself."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, before + (most_bytes or PART), "right")))
        yield at, to
        at, before = to, int(sizes[to - 1])


def by_parts(f: Callable[..., pa.Array], kind: str, text: Column, *others: Column) -> Column:
    """``f`` of lists of a part's values; each part's results leave the worker before the next part is taken."""

    def run(batches):
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            for a, b in parts(columns[0]):
                yield f(*[c.slice(a, b - a).to_pylist() for c in columns])
                pa.default_memory_pool().release_unused()  # workers outlive their tasks

    if others:

        @F.arrow_udf(kind)
        def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            yield from run(batches)

        return several(text, *others)

    @F.arrow_udf(kind)
    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    return one(text)
