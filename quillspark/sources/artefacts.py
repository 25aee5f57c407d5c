"""Files that belong to documents: images given as base64 and layouts, written by the tasks that hold them.

A file is written under a name of its own and then renamed, so it is there whole
or not at all, and one written again by another attempt is the same.  What was
written is a committed table; a document refers to nothing that isn't in it.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WRITTEN = "name string, path string, size long"
#: Where documents refer to their images, and where the refs are served from.
REF, SERVED = "images/", "/media/images/"


def safe(name: Column) -> Column:
    """Whether a name stays in the folder it is put in."""
    return name.isNotNull() & ~name.rlike(r"[/\\\x00]") & ~name.isin("", ".", "..")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) into ``folder``: the table of what was written.  Names that leave the folder are refused; of equal
    names one file stays."""
    folder = folder.rstrip("/")

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for b in batches:
            names, sizes = [], []
            for name, content in zip(b.column("name").to_pylist(), b.column("content")):
                draft = f"{root}/.{uuid.uuid4().hex}"
                data = content.as_buffer()
                with store.open_output_stream(draft) as f:
                    f.write(data)
                store.move(draft, f"{root}/{name}")
                names.append(name)
                sizes.append(data.size)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f"{folder}/{n}" for n in names], pa.string()), pa.array(sizes, pa.int64())], ["name", "path", "size"])

    good = rows.where(safe(F.col("name")) & F.col("content").isNotNull()).select("name", "content")
    table = f"{folder}/_written-{uuid.uuid4().hex}"
    good.mapInArrow(run, WRITTEN).write.parquet(table)
    return rows.sparkSession.read.schema(WRITTEN).parquet(table).dropDuplicates(["name"])


def with_images(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "markdown", images: str = "images") -> DataFrame:
    """``docs`` with ``text`` pointing to the images that were written and ``image_list``, its images as alt and ref.

    ``images`` maps names to data URIs.  An image is a file named by the hash of
    its content, so equal ones are written once.  Names that aren't plain, URIs
    without base64 and what can't be decoded are left out, and references to them
    stay as they are.
    """
    from ..functions.text import extension, image_refs

    each = docs.select(F.col(key).alias("_doc"), F.explode(images).alias("_name", "_uri")).where(safe(F.col("_name")))
    head, body = F.substring_index("_uri", ",", 1), F.regexp_replace(F.regexp_extract("_uri", r"(?s)^[^,]*,(.*)$", 1), r"\s", "")
    content = F.when(F.contains(head, F.lit("base64")) & (body != ""), F.try_to_binary(body, F.lit("base64")))
    each = each.select("_doc", "_name", content.alias("content")).where("content is not null")
    named = each.withColumn("name", F.concat(F.sha2("content", 256), extension(F.col("_name"))))
    written = write_files(named.select("name", "content").dropDuplicates(["name"]), folder).select("name")
    refs = named.select("_doc", "_name", "name").join(written, "name", "left_semi")
    refs = refs.groupBy("_doc").agg(F.map_from_entries(F.collect_set(F.struct("_name", F.concat(F.lit(SERVED), "name")))).alias("_refs"))
    both = docs.join(refs, docs[key] == refs["_doc"], "left")
    # what follows each place where an image's reference begins
    parts = F.split(F.col(text), rf"(?<=!\[[^\]]{{0,1000}}\]\(){REF}", -1)
    name = lambda p: F.regexp_extract(p, r"^([^)\s]+)\)", 1)
    put = lambda p: F.coalesce(F.concat(F.try_element_at("_refs", name(p)), F.substr(p, F.length(name(p)) + 1)), F.concat(F.lit(REF), p))
    rewritten = F.when(F.col("_refs").isNull(), F.col(text)).otherwise(F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(put(p))), ""))
    others = [docs[c] for c in docs.columns if c != text]
    return both.select(*others, rewritten.alias(text)).withColumn("image_list", image_refs(F.col(text)))


def write_layouts(docs: DataFrame, folder: str, key: str = "doc_id", parts: tuple[str, ...] = ("content_list", "middle_json")) -> DataFrame:
    """Write each document's layout columns, JSON texts, as ``<key>.<part>.json``: (key, part, path, size) of the files."""
    each = docs.select(F.col(key).cast("string").alias("_key"), F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("json")) for p in parts])).alias("_p"))
    each = each.where("_p.json is not null").select("_key", "_p.part", F.concat_ws(".", "_key", "_p.part", F.lit("json")).alias("name"), F.encode("_p.json", "UTF-8").alias("content"))
    written = write_files(each.select("name", "content"), folder)
    return each.select(F.col("_key").alias(key), "part", "name").join(written, "name").select(key, "part", "path", "size")
