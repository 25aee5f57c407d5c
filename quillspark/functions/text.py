"""Text functions over columns: fingerprints, titles, links, images, paths."""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .parts import by_parts

#: Extensions that may be uploaded, by type.
TEXT_EXTENSIONS = [".pdf", ".docx", ".pptx", ".html", ".md", ".txt"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".bmp"]


def squeezed(text: Column) -> Column:
    """Lower case without white space; JVM-side form of ``normalized`` for text without compatibility characters."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def squeezed_hash(text: Column) -> Column:
    return F.sha2(squeezed(text), 256)


def _normalized(text: str) -> str:
    return "".join(unicodedata.normalize("NFKC", text).casefold().split())


def normalized(text: Column) -> Column:
    """NFKC, then case folding, then no white space of any kind: Unicode rules that the JVM functions don't have."""
    return by_parts(lambda texts: pa.array([None if t is None else _normalized(t) for t in texts], pa.string()), "string", text)


def content_hash(text: Column) -> Column:
    """SHA-256 of the normalised text, of which only the hash leaves the worker."""
    return by_parts(lambda texts: pa.array([None if t is None else hashlib.sha256(_normalized(t).encode()).hexdigest() for t in texts], pa.string()), "string", text)


def wiki_links(text: Column) -> Column:
    """Distinct trimmed targets of ``[[target]]``, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1)), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


_IMAGE = r"!\[([^\]]*)\]\(([^)]*)\)"


def image_refs(text: Column) -> Column:
    """array<struct<alt, ref>> of the images of a Markdown text."""
    alts, refs = (F.regexp_extract_all(text, F.lit(_IMAGE), F.lit(i)) for i in (1, 2))
    return F.arrays_zip(alts.alias("alt"), refs.alias("ref"))


def without_images(text: Column) -> Column:
    return F.regexp_replace(text, _IMAGE, "")


def extension(path: Column) -> Column:
    """The lower-case ending with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def file_type(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(TEXT_EXTENSIONS), "text").when(e.isin(IMAGE_EXTENSIONS), "image")


def metric_path(path: Column) -> Column:
    """A request path with 32-digit ids replaced, so that metrics don't grow with ids."""
    return F.regexp_replace(path, "/[0-9a-f]{32}(?=/|$)", "/{id}")


def truncated(text: Column, most: int, mark: str = "…") -> Column:
    """At most ``most`` characters, the mark included."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(mark)), F.lit(mark))).otherwise(text)


def stable_id(*parts: Column) -> Column:
    """An id that a task that runs again gives once more."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def name_id(namespace: str, name: Column) -> Column:
    """The name-based id (version 5) of a name within a namespace id, as 32 hexadecimal digits: SHA-1 of both with the
    version and the variant put in.  A null name gives null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), variant, F.substring(digest, 18, 15))


def parent_name(tenant_id: Column, kb_id: Column, title: Column, content: Column) -> Column:
    """What a parent without an id is named by: its scope, its title, and the hash of its content, white space and case aside."""
    plain = lambda c: F.lower(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\u00a0\u3000]+", " ")))
    return F.concat_ws("|", tenant_id, kb_id, plain(title), F.sha2(plain(content), 256))
