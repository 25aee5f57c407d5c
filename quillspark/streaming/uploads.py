"""Uploads that arrive in a folder, as a stream: each file's hash is looked up in its scope before it counts as a file.

The state is a row per scope and hash, so a restart from the checkpoint knows
what came before, and files that arrive again, whatever their names, are told
from new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import extension, file_type
from ..sources.files import checked

FILES = "path string, modificationTime timestamp, length long, content binary"
SCOPE = ["tenant_id", "kb_id", "product_id"]
OUT = "tenant_id string, kb_id string, product_id string, sha256 string, path string, size long, type string, status int, first_path string"


def arriving(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """Files below ``folder/<tenant>/<base>/<product>/`` as they arrive, with hash, type and why one is refused; a file below
    ``force/`` of its product is taken although its hash is known."""
    rows = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    parts = F.split(F.regexp_replace("path", r"^.*?" + _quoted(folder), ""), "/")
    forced = F.get(parts, F.lit(3)) == "force"
    rows = rows.select(
        F.get(parts, F.lit(0)).alias("tenant_id"), F.get(parts, F.lit(1)).alias("kb_id"), F.get(parts, F.lit(2)).alias("product_id"), forced.alias("forced"),
        F.sha2("content", 256).alias("sha256"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("at"), extension(F.col("path")).alias("extension"), file_type(F.col("path")).alias("type"),
    )
    return checked(rows)


def _quoted(folder: str) -> str:
    plain = folder.rstrip("/").removeprefix("file://")
    return r"\Q" + plain + r"\E/"


class _KnownHashes(StatefulProcessor):
    """The path under which a scope first had a hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "path string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        files = pd.concat(list(rows)).sort_values(["at", "path"], kind="stable")
        first = self.first.get()[0] if self.first.exists() else None
        status, known = [], []
        for path, forced in zip(files["path"], files["forced"]):
            known.append(first)
            status.append(200 if first is None or forced else 409)
            first = path if first is None else first
        self.first.update((first,))
        yield pd.DataFrame({**dict(zip([*SCOPE, "sha256"], key)), "path": files["path"], "size": files["size"], "type": files["type"], "status": status, "first_path": known})

    def close(self) -> None:
        pass


def judged(files: DataFrame) -> DataFrame:
    """A status for each file: 200 taken, 409 its scope has the hash (``first_path`` says where), 400 its type, 413 its size.

    Refused files leave no trace in the state.  A stream in append mode; needs a
    RocksDB state store.
    """
    good = files.where("refused is null").groupBy(*SCOPE, "sha256")
    taken = good.transformWithStateInPandas(_KnownHashes(), OUT, "Append", "None")
    bad = files.where("refused is not null").select(*SCOPE, "sha256", "path", "size", "type", F.when(F.col("refused") == "size", 413).otherwise(400).alias("status"), F.lit(None).cast("string").alias("first_path"))
    return taken.unionByName(bad)
