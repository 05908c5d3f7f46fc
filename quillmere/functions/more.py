"""Paths, safe casts, canonical JSON, Unicode forms, pseudonyms and redaction."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from quillmere.functions.text import collapse

SENSITIVE = ("password", "secret", "token", "api_key", "authorization", "cookie")


@pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    """NFKC, case-folded, white space collapsed: there is no built-in for it."""
    return x.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


def match_text(text: Column) -> Column:
    """The form in which texts are compared; ASCII needs no Python."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(collapse(text))).otherwise(nfkc(text))


def pseudonym(email: Column, key: str = "") -> Column:
    """16 hex digits that stand for an e-mail address: sha256, or HMAC-SHA256 where there is a key."""
    address = F.lower(F.trim(email))
    if not key:
        return F.substring(F.sha2(address, 256), 1, 16)

    @pandas_udf(StringType())
    def keyed(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else hmac.new(key.encode(), t.encode(), hashlib.sha256).hexdigest()[:16])

    return keyed(address)


def relative_source_path(path: Column, root: str = "documents") -> Column:
    """What follows the first path segment named root; the whole path without one."""
    parts = F.split(path, "/")
    at = F.array_position(parts, root).cast("int")
    return F.when(at > 0, F.array_join(F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(1))), "/")).otherwise(path)


def short_path(path: Column, keep: int = 2) -> Column:
    """The last `keep` segments, behind an ellipsis if there are more."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.when(F.size(parts) > keep, F.concat(F.lit("…/"), F.array_join(F.slice(parts, -keep, keep), "/"))).otherwise(F.array_join(parts, "/"))


def source_family(path: Column) -> Column:
    return F.coalesce(F.when(F.split_part(path, F.lit("/"), F.lit(1)) != "", F.split_part(path, F.lit("/"), F.lit(1))), F.lit("unknown"))


def safe_int(text: Column) -> Column:
    return F.coalesce(F.expr("try_cast(NULL AS bigint)"), text.try_cast("bigint"), F.lit(0).cast("bigint"))


def safe_score(text: Column) -> Column:
    """A finite number or null."""
    x = text.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def sorted_json(columns: dict[str, Column]) -> Column:
    """A JSON object of strings and numbers with sorted keys and ', ' and ': ' between; nulls are written."""
    one = lambda k, c: F.concat(F.lit(f'"{k}": '), F.coalesce(F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$|^\{\}$', ""), F.lit("null")))
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.regexp_replace(one(k, columns[k]), r": $", ": null") for k in sorted(columns)]), F.lit("}"))


def redacted(fields: Column) -> Column:
    """A map without keys that name secrets."""
    return F.map_filter(fields, lambda k, _: ~F.exists(F.array(*[F.lit(s) for s in SENSITIVE]), lambda s: F.contains(F.lower(k), s)))
