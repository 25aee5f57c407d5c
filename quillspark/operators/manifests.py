"""A log of numbered manifests in a shared folder: what a set of Parquet tables consists of, committed by exclusive renames.

A manifest is a small JSON document that names folders.  Folders are written
first, under names no one else uses, and become visible together when a manifest
that names them gets the next number.  Of two writers that want one number the
second is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the number."""


class Log:
    """Manifests ``path/_log/<number>.json``, of which the one with the greatest number is current."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop
        self._folder = self._hadoop.fs.Path(f"{self.path}/_log")
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _name(self, number: int):
        return self._hadoop.fs.Path(self._folder, f"{number:012d}.json")

    def numbers(self) -> list[int]:
        if not self._files.exists(self._folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._folder)]
        return sorted(int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit())

    def read(self, number: int | None = None) -> dict:
        """The manifest of a number, or the current one; an empty one where there is none yet."""
        if number is None:
            number = (self.numbers() or [0])[-1]
        if not number:
            return {"number": 0}
        file = self._files.open(self._name(number))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(file)).decode())
        finally:
            file.close()

    def commit(self, manifest: dict) -> dict:
        """Write the manifest that follows ``manifest["number"]``; ``Conflict`` where that number is taken."""
        new = manifest | {"number": manifest.get("number", 0) + 1}
        self._files.mkdirs(self._folder)
        draft = self._hadoop.fs.Path(self._folder, f".{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.fs.Options.Rename, 1)
        options[0] = self._hadoop.fs.Options.Rename.NONE
        try:
            self._hadoop.fs.FileContext.getFileContext(self._folder.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, self._name(new["number"]), options)
        except Exception as e:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"manifest {new['number']} of {self.path} is another writer's") from e
            raise
        return new

    def update(self, change: Callable[[dict], dict], tries: int = 5) -> dict:
        """Commit ``change`` of the current manifest, once more on what another writer committed meanwhile."""
        for left in range(tries, 0, -1):
            try:
                return self.commit(change(self.read()))
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    def folder(self, name: str) -> str:
        """A folder that no manifest names yet."""
        return f"{name}-{uuid.uuid4().hex}"

    def write(self, rows: DataFrame, name: str) -> str:
        """Write rows into a new folder, whose name a manifest may then take up."""
        folder = self.folder(name)
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def rows(self, folders: Iterable[str], schema: str) -> DataFrame:
        """The rows of the given folders; none of them gives none."""
        paths = [f"{self.path}/{f}" for f in folders]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def drop(self, folders: Iterable[str]) -> None:
        """Delete folders that no manifest names."""
        for f in folders:
            self._files.delete(self._hadoop.fs.Path(f"{self.path}/{f}"), True)
