"""Identity: file, element, chunk and citation ids, fingerprints and versions. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmere.functions.text import blank_to_null


def file_id(relative_path: Column) -> Column:
    return F.substring(F.sha2(relative_path, 256), 1, 16)


def fingerprint(text: Column) -> Column:
    """Content id of a text that is neither empty nor the word None; those raise an error."""
    t = F.trim(text)
    return F.when((t == "") | (t == "None") | t.isNull(), F.raise_error(F.lit("content is empty")).cast("string")).otherwise(F.concat(F.lit("content_sha256:"), F.substring(F.sha2(t, 256), 1, 12)))


def first_named(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns])


def locator(c: dict[str, Column]) -> Column:
    """source_locator, else page, sheet, image or section, else body:1. Absent columns may be left out."""
    at = lambda k: c.get(k, F.lit(None)).cast("string")
    named = [F.concat(F.lit(f"{n}:"), at(k)) for n, k in (("page", "page_number"), ("sheet", "sheet_name"), ("image", "image_index"), ("section", "section_heading"))]
    return F.coalesce(at("source_locator"), *named, F.lit("body:1"))


def citation_id(relative_path: Column, source_type: Column, where: Column, start: Column, index: Column) -> Column:
    return F.concat(relative_path, F.lit("#"), source_type, F.lit(":"), F.translate(where, ":/ ", "---"), F.lit(":start-"), start, F.lit(":chunk-"), index)


def chunk_id(owner: Column, source_type: Column, where: Column, index: Column, start: Column, text: Column) -> Column:
    base = F.concat_ws(":", owner, source_type, where, index, start)
    return F.concat_ws(":", base, F.substring(F.sha1(F.concat_ws(":", base, text)), 1, 10))


def uuid5(namespace: str, name: Column) -> Column:
    """Version 5 UUID of a name, as text; the namespace is a UUID as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    high = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F)).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(high, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def embedding_text(text: Column, *context: Column) -> Column:
    prefix = F.concat_ws(" | ", *[blank_to_null(c) for c in context])
    return F.when(prefix == "", text).otherwise(F.concat(prefix, F.lit("\n\n"), text))
