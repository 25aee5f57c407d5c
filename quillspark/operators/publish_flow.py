"""Publishing a file's parents and vectors together, so that readers see both or neither, and a job that stops is recovered.

A job writes its vectors and parents as new folders, checks that as many vectors
lie there as were submitted, and makes both visible by one manifest: the switch.
Before it, the old state holds and a stopped job has failed; after it, the new
state holds and what is left is a clean-up that can be done again: vectors that
the job didn't write and parents that it doesn't keep go from the scopes where
its files may have published.

Tables are the folders that the manifest lists.  Of a parent's rows the one in
the last folder counts; vectors that later went are listed by id, so a clean-up
writes ids, not vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .manifests import Conflict, Log
from .publishing import SCOPE, TRIPLE
from .snapshots import next_versions

PARENTS = "tenant_id string, kb_id string, parent_id string, file_id long, content string, content_sha256 string, status string, doc_version long"
VECTORS = "vector_id string, file_id long, tenant_id string, kb_id string, parent_id string, chunk_index long, embedding array<float>, doc_version long"
SCOPES = "file_id long, tenant_id string, kb_id string"
#: States of a job before the switch, and after it.
BEFORE, AFTER = ("embedding", "vector_verified", "switching"), ("switched", "cleanup_pending", "committed_failed")


class Stopped(RuntimeError):
    """Raised by tests in place of a lost driver."""


class Base:
    """The parents and vectors of a knowledge base behind one log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, Log(spark, path)

    def parents_at(self, m: dict) -> DataFrame:
        parts = [self.log.rows([f], PARENTS).withColumn("_part", F.lit(i)) for i, f in enumerate(m.get("parents", []))]
        if not parts:
            return self.log.rows([], PARENTS)
        rows = reduce(DataFrame.unionByName, parts)
        rest = [c for c in rows.columns if c not in (*TRIPLE, "_part")]
        last = rows.groupBy(*TRIPLE).agg(F.max_by(F.struct(*rest), "_part").alias("_r"))
        return last.select(*TRIPLE, "_r.*").select(*[c.split()[0] for c in PARENTS.split(", ")])

    def vectors_at(self, m: dict) -> DataFrame:
        gone = self.log.rows(m.get("gone", []), "_folder string, vector_id string")
        rows = [self.log.rows([f], VECTORS).withColumn("_folder", F.lit(f)) for f in m.get("vectors", [])]
        if not rows:
            return self.log.rows([], VECTORS)
        # an id may be written again after it went, so what went is named with the folder it lay in
        return reduce(DataFrame.unionByName, rows).join(gone, ["_folder", "vector_id"], "left_anti")

    def parents(self) -> DataFrame:
        return self.parents_at(self.log.read())

    def vectors(self) -> DataFrame:
        return self.vectors_at(self.log.read()).drop("_folder")

    def jobs(self) -> dict[str, dict]:
        return self.log.read().get("jobs", {})

    def _job(self, job: str, **what) -> dict:
        return self.log.update(lambda m: m | {"jobs": m.get("jobs", {}) | {job: m.get("jobs", {}).get(job, {}) | what}})

    def publish(self, job: str, parents: DataFrame, vectors: DataFrame, scopes: DataFrame, expected: int | None = None, stop: Callable[[str], None] = lambda step: None) -> str:
        """Publish a batch of files; returns the job's last state.

        ``parents``: tenant_id, kb_id, parent_id, file_id, content; ``vectors``:
        vector_id, file_id, tenant_id, kb_id, parent_id, chunk_index, embedding;
        ``scopes``: file_id, tenant_id, kb_id of the files' present scopes and of
        those where they may have published before.
        ``expected`` is the number of chunks submitted; without it the vectors
        themselves are counted before they are written.  ``stop`` is called
        after each step, for tests.
        """
        if job in self.jobs():
            raise ValueError(f"there is a job {job}")
        base = self.log.read()
        self._job(job, state="embedding", expected=expected)
        stop("embedding")
        try:
            new = parents.withColumn("content_sha256", F.sha2("content", 256)).withColumn("status", F.lit("active"))
            versions = next_versions(self.parents_at(base), new, *TRIPLE)
            folder = {k: self.log.folder(k) for k in ("vectors", "parents", "scopes")}
            self._job(job, folders=folder)
            self._put(vectors.join(versions, TRIPLE, "left").withColumn("doc_version", F.coalesce("target_version", F.lit(1))), VECTORS, folder["vectors"])
            found = self.log.rows([folder["vectors"]], "vector_id string").count()
            wanted = vectors.count() if expected is None else expected
            if found != wanted:
                raise ValueError(f"{found} vectors of job {job} were written instead of {wanted}")
            self._put(scopes, SCOPES, folder["scopes"])
            self._job(job, state="vector_verified", indexed=found)
            stop("vector_verified")
            self._put(new.join(versions.withColumnRenamed("target_version", "doc_version"), TRIPLE), PARENTS, folder["parents"])
            self._job(job, state="switching")
            stop("switching")
            self._switch(job, base, folder)
        except Stopped:
            raise
        except Exception as e:
            self._job(job, state="failed", error=str(e)[:2000])
            raise
        stop("switched")
        try:
            return self._clean_up(job, stop)
        except Stopped:
            raise
        except Exception as e:  # the new state is live: the clean-up is done again by ``recover``
            return self._job(job, state="committed_failed", error=str(e)[:2000])["jobs"][job]["state"]

    def _put(self, rows: DataFrame, schema: str, folder: str) -> None:
        kinds = dict(c.split(" ", 1) for c in schema.split(", "))
        rows.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()]).write.parquet(f"{self.log.path}/{folder}")

    def _switch(self, job: str, base: dict, folder: dict) -> None:
        def change(m: dict) -> dict:
            # versions were counted on the parents of ``base``
            if m.get("parents", []) != base.get("parents", []):
                raise Conflict(f"other parents were published while job {job} ran")
            jobs = m["jobs"] | {job: m["jobs"][job] | {"state": "switched"}}
            return m | {"parents": [*m.get("parents", []), folder["parents"]], "vectors": [*m.get("vectors", []), folder["vectors"]], "jobs": jobs}

        for _ in range(5):
            try:
                self.log.commit(change(self.log.read()))
                return
            except Conflict as e:
                if "other parents" in str(e):
                    raise
        raise Conflict(f"job {job} found no free number")

    def _clean_up(self, job: str, stop: Callable[[str], None] = lambda step: None) -> str:
        """Drop what the job's files left in their scopes; doing it again changes nothing."""
        m = self._job(job, state="cleanup_pending")
        stop("cleanup_pending")
        folder = m["jobs"][job]["folders"]
        scopes = self.log.rows([folder["scopes"]], SCOPES).distinct()
        # vectors of later jobs aren't this one's to drop, nor is a parent that a later job has published again
        at, place = m["vectors"].index(folder["vectors"]), m["parents"].index(folder["parents"]) + 1
        older = self.vectors_at(m | {"vectors": m["vectors"][:at]})
        gone = self.log.rows([], "_folder string, vector_id string")
        if at:
            gone = older.join(scopes, ["file_id", *SCOPE], "left_semi").select("_folder", "vector_id")
        gone_folder = self.log.write(gone, "gone")
        kept = self.log.rows(m["parents"][place - 1 : place], PARENTS).union(self.log.rows(m["parents"][place:], PARENTS)).select(*TRIPLE).distinct()
        own = self.parents_at(m | {"parents": m["parents"][:place]}).where("status <> 'deleted'").join(scopes, ["file_id", *SCOPE], "left_semi")
        deleted_folder = self.log.folder("parents")
        self._put(own.join(kept, TRIPLE, "left_anti").withColumn("status", F.lit("deleted")), PARENTS, deleted_folder)

        def change(now: dict) -> dict:
            jobs = now["jobs"] | {job: now["jobs"][job] | {"state": "done"}}
            return now | {"parents": [*now["parents"], deleted_folder], "gone": [*now.get("gone", []), gone_folder], "jobs": jobs}

        return self.log.update(change)["jobs"][job]["state"]

    def recover(self) -> dict[str, str]:
        """End jobs that stopped: before the switch they have failed and their folders go; after it the clean-up is done."""
        ended = {}
        for job, what in self.jobs().items():
            if what["state"] in BEFORE:
                ended[job] = self._job(job, state="failed", error="stopped before the switch")["jobs"][job]["state"]
                self.log.drop(what.get("folders", {}).values())
            elif what["state"] in AFTER:
                ended[job] = self._clean_up(job)
        return ended
