"""Payloads of any shape as VARIANT columns: bad JSON is an empty object, attributes are flattened at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.sources.tables import shared_path


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def payload(text: Column) -> Column:
    """The JSON object that a text holds, as a VARIANT; null, blank and bad JSON, and JSON of another kind, give an empty object."""
    v = F.try_parse_json(text)
    return F.when(is_object(v), v).otherwise(F.parse_json(F.lit("{}")))


def field(v: Column, path: str, kind: str = "string") -> Column:
    """A field of a VARIANT by a path such as $.a.b[0], null where it is missing or of a kind that does not cast."""
    return F.try_variant_get(v, path, kind)


def flattened(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, path, value): every field of a VARIANT object at every depth, its path joined by dots, its value as JSON text.

    An inner object has a row of its own and one for each of its fields; arrays stay whole. JSON nulls have no row. Each round
    opens the objects that the one before has found, so there are as many rounds as levels, each over fewer rows.
    """
    spark, at, level = rows.sparkSession, shared_path(rows.sparkSession, "payload"), 0
    left = rows.select(F.col(key).alias("k"), F.lit(None).cast("string").alias("p"), F.col(value).alias("v"))
    while True:
        opened = left.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "inner")).where("name IS NOT NULL")
        each = opened.select("k", F.concat_ws(".", "p", "name").alias("path"), F.to_json("inner").alias("value"), is_object(F.col("inner")).alias("more")).where("value IS NOT NULL AND value <> 'null'")
        each.write.parquet(f"{at}/level={level}")
        kept = spark.read.parquet(f"{at}/level={level}")
        if kept.where("more").isEmpty():
            break
        left = kept.where("more").select("k", F.col("path").alias("p"), F.parse_json("value").alias("v"))
        level += 1
    return spark.read.schema(each.schema).parquet(at).select(F.col("k").alias(key), "path", "value")


def span_attributes(spans: DataFrame, key: str) -> DataFrame:
    """(key, attributes): a map from path to JSON text of all that a span says of itself.

    The first non-blank of the text columns attributes, span_attributes and attributes_json is parsed; what columns named
    attributes.<name> say (JSON objects as text, or plain values) goes over it. Absent columns may be left out. Spans without any
    attribute have an empty map; key must tell spans apart.
    """
    named = [c for c in spans.columns if c.startswith("attributes.")]
    texts = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("attributes", "span_attributes", "attributes_json") if c in spans.columns]
    base = payload(F.coalesce(*texts) if texts else F.lit(None).cast("string"))

    def said(c: str) -> Column:
        """A column's value as JSON text, null where it says nothing."""
        x = F.col(f"`{c}`")
        plain = F.to_json(F.struct(x.alias("v")))
        inner = F.try_parse_json(x.cast("string"))
        text = F.when(is_object(inner), F.to_json(inner)).otherwise(F.regexp_extract(plain, r'(?s)^\{"v":(.*)\}$', 1)) if dict(spans.dtypes)[c] == "string" else F.regexp_extract(plain, r'(?s)^\{"v":(.*)\}$', 1)
        missing = x.isNull() | (F.isnan(x) if dict(spans.dtypes)[c] in ("double", "float") else F.lit(False))
        return F.when(~missing, text)

    over = [F.struct(F.lit(c.removeprefix("attributes.")).alias("name"), said(c).alias("value")) for c in named]
    both = spans.select(F.col(key).alias("k"), F.lit(0).alias("o"), F.lit(None).cast("string").alias("name"), base.alias("v"))
    if over:
        later = spans.select(F.col(key).alias("k"), F.explode(F.array(*over)).alias("c")).where("c.value IS NOT NULL")
        both = both.unionByName(later.select("k", F.lit(1).alias("o"), "c.name", F.parse_json("c.value").alias("v")))
    tagged = both.withColumn("tag", F.struct("k", "o", "name"))
    objects = flattened(tagged.where(is_object(F.col("v"))), "tag", "v")
    parts = objects.select("tag.k", "tag.o", F.concat_ws(".", "tag.name", "path").alias("path"), "value")
    whole = tagged.where("name IS NOT NULL").select("k", "o", F.col("name").alias("path"), F.to_json("v").alias("value"))
    last = parts.unionByName(whole).groupBy("k", "path").agg(F.max_by("value", "o").alias("value"))
    held = last.groupBy("k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "value")))).alias("attributes"))  # a span's own fields
    return spans.select(F.col(key)).join(held, F.col(key) == F.col("k"), "left").select(key, F.coalesce("attributes", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("attributes"))
