"""Texts of images by an OCR provider: memo by content and recipe, one call for each distinct image, admission, layout route."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.operators import providers
from quillmere.sources.readers import layout_route, ocr_rejected, recipe_hash

KEYS = ["file_hash", "image_id", "recipe"]


def with_recipe(images: DataFrame, settings: dict[str, Column], preprocessing: dict[str, Column]) -> DataFrame:
    """images with `recipe`: the hash of all that an answer depends on besides the image; null values count."""
    return images.withColumn("recipe", recipe_hash({**settings, **{f"preprocessing.{k}": c for k, c in preprocessing.items()}}))


def read_images(images: DataFrame, start: Callable[[], Callable[[object], str]] | None, method: str, memo: str, run: str, in_flight: int = 8, retries: int = 2, seconds: float = 60.0, pause: float = 0.1) -> DataFrame:
    """A row for each image: its text, layout_route and cached where the text is admitted, else `warning` says why there is none.

    images: file_hash, image_id, recipe, image, source_type, file_name, layout_route (configured, may be null). start gives the
    provider, called once for each distinct (file_hash, image_id, recipe) that the memo lacks; without one only the memo
    answers. method names the provider and its model, and decides with source_type whether short texts are admitted. Texts of
    white space are empty. Images that repeat a key share one answer; an image
    without a file_hash is known by the hash of its own bytes, and other null keys count as empty.
    """
    own = F.sha2(F.col("image").cast("binary"), 256)
    keyed = images.withColumns({k: F.coalesce(F.col(k).cast("string"), own if k == "file_hash" else F.lit(""), F.lit("")) for k in KEYS})
    ask = (lambda misses: providers.called(misses, ["image"], "result", "string", start, in_flight, retries, seconds, pause)) if start else (lambda misses: misses.select(*KEYS, F.lit(None).cast("string").alias("result"), F.lit("no client").alias("error"), F.lit(0).alias("attempts")))
    x = providers.memoized(keyed, KEYS, ["image"], ask, memo, run)
    text = F.col("result")
    refused = ocr_rejected(text, F.col("source_type"), F.lit(method))
    warning = F.when(F.col("error") == "no client", "OCR client not configured").when(F.col("error").isNotNull(), F.concat(F.lit("OCR failed: "), "error")).when(F.trim(F.coalesce(text, F.lit(""))) == "", "OCR returned empty text").when(refused.isNotNull(), F.concat(F.lit("OCR output rejected: "), refused))
    route = layout_route(text, F.col("layout_route"), F.col("file_name"))
    admitted = warning.isNull()
    return x.select(*[c for c in images.columns if c not in ("layout_route", "image")], F.when(admitted, text).alias("text"), F.when(admitted, route).alias("layout_route"), F.when(admitted, F.lit(method)).alias("ocr_method"), F.coalesce("cached", F.lit(False)).alias("cached"), F.coalesce("attempts", F.lit(0)).alias("attempts"), warning.alias("warning"))
