"""Mixing sources to target weights by hash thresholds: no sort of the documents, no Python on the main path.

Sizes are summed by source and hash bucket. Within a source the buckets are taken in order of the hash until the
budget is met; only the bucket at the boundary is looked at again, by its next bits, until it holds one hash value.
A document's copies then follow from its own hash and its source's threshold alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash60(doc_id: str) -> Column:
    """60 bits of the md5 of the id as text; a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds rank (0-based, by code point, null last) without bringing all sources to one task."""
    parts = stage(sources.repartitionByRange(F.col("source").isNull(), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.join(before, "part").select("source", "source_size", (F.col("before") + inner - 1).alias("rank"))


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): share of all sizes dealt by weight, none above cap times its source's size.

    What a source at its cap can't take is dealt again to the others by weight; each round is one sum over sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    src = stage(src.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(cap)).alias("cap")), "mix-weights")
    total = (src.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    rate = float("-inf")
    while True:
        held = F.col("w") * F.lit(rate) > F.col("cap") if rate >= 0 else F.lit(False)
        full, free, n = src.agg(F.sum(F.when(held, F.col("cap")).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("w"))), F.sum(F.when(held, 0).otherwise(1))).first()
        new = (total - full) / free if n else rate
        if not n or new <= rate:
            break
        rate = new
    return src.select("source", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(max(rate, 0.0))).alias("target"))


def thresholds(sized: DataFrame, src: DataFrame) -> DataFrame:
    """src with whole (copies that all documents get) and below: a document whose hash is less gets one more.

    A boundary value whose documents fit more than half goes in, so the error is at most half of one hash value's size.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = src.withColumn("whole", whole.cast("long")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("low", F.lit(0).cast("long")).withColumn("open", F.col("left") > 0)
    state = stage(state, "mix-state")
    for level in range(HASH_BITS // LEVEL_BITS):
        bits = HASH_BITS - LEVEL_BITS * (level + 1)
        width = 1 << bits
        at = state.where("open").select(F.col("source").alias("s"), "low")
        inside = (sized.h >= at.low) & (sized.h < at.low + F.lit(width << LEVEL_BITS))
        hist = sized.join(at, sized.source.eqNullSafe(at.s) & inside).groupBy("s", F.shiftright("h", bits).alias("bucket"))
        hist = hist.agg(F.sum("size").alias("size"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        run = F.sum("size").over(Window.partitionBy("s").orderBy("bucket"))
        hist = hist.join(state.select(F.col("source").alias("s2"), "left"), F.col("s").eqNullSafe(F.col("s2"))).withColumn("upto", run)
        edge = hist.where("upto > left").groupBy("s").agg(F.min_by(F.struct("bucket", "size", "upto", "h0", "h1"), "bucket").alias("e"))
        x = state.join(edge, state.source.eqNullSafe(edge.s), "left")
        rest = F.col("left") - (F.col("e.upto") - F.col("e.size"))
        single = F.col("e.h0") == F.col("e.h1")
        takes = F.col("e.size") - rest < rest
        low = F.when(~F.col("open"), F.col("low")).when(F.col("e").isNull(), F.col("low") + F.lit(width << LEVEL_BITS)).when(single, F.when(takes, F.col("e.h0") + 1).otherwise(F.col("e.h0"))).otherwise(F.col("e.bucket") * width)
        still = F.col("open") & F.col("e").isNotNull() & ~single
        state = stage(x.select("source", "source_size", "target", "whole", F.when(still, rest).otherwise(F.col("left")).alias("left"), low.alias("low"), F.coalesce(still, F.lit(False)).alias("open")), "mix-state")
        if not state.where("open").count():
            break
    return state.select("source", "source_size", "target", "whole", F.col("low").alias("below"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs.

    Null or empty texts have size 0; a null source is a source of its own, the last one; rows that repeat an id share its
    hash and are taken together; null ids share one hash. No rows give no rows. Other columns of docs are not looked at.
    """
    sized = stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"), hash60(doc_id).alias("h")), "mix-sizes")
    plan = thresholds(sized, targets(sized, weights, share, cap)).withColumnRenamed("source", "s")
    copies = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return sized.join(plan, sized.source.eqNullSafe(plan.s)).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with docs' own columns, whatever their names.

    Nulls, empty texts, repeats and ties as in mix; a row of size 0 is repeated like any other of its hash. No rows give no rows.
    """
    sized = stage(docs.select(F.col(source).alias("source"), words(text).alias("size"), hash60(doc_id).alias("h")), "mix-sizes")
    plan = thresholds(sized, targets(sized, weights, share, cap)).select("source", "whole", "below")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source].alias("s"), hash60(doc_id).alias("h"))
    copies = (F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).cast("int")
    taken = rows.join(plan, rows.s.eqNullSafe(plan.source)).select("row", copies.alias("copies")).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
