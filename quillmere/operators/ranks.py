"""Ranks within keys of which any may hold most of all rows, and ordered texts that never hold a key whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.sources.tables import shared_path

#: A key with a larger share of all rows than one in so many is ranked over several tasks; there are fewer of them than this.
HOT = 4096


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: later steps neither repeat what made it nor depend on one executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def over_parts(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`, the 0-based rank within keys (of all rows without any): parts by range, a rank in each, the counts of the parts before it."""
    parts = staged(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranks")
    counts = parts.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part"))  # as many rows a key as it has parts
    before = counts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_{k}") for k in keys], (upto - F.col("_n")).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inner = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)) - 1
    return parts.withColumn("_inner", inner).join(before, same).withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).select(*rows.columns, name)


def rank_within(rows: DataFrame, keys: list[str], order: list[str], name: str, hot: int = HOT) -> DataFrame:
    """Adds `name`, the 0-based rank within keys in the order given, which must tell rows apart. Null keys are keys.

    Counts by key are summed before they are shuffled. Keys with more than one in `hot` of all rows, fewer than `hot`, are
    broadcast and their rows ranked over range parts; the others take one window.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.count()
    few = counts.where(F.col("_n") * hot > total).select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_hot"))
    rank = (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")
    if few.isEmpty():
        return rows.withColumn(name, rank)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    marked = rows.join(F.broadcast(few), same, "left").select(*rows.columns, F.coalesce("_hot", F.lit(False)).alias("_hot"))
    plain = marked.where("not _hot").drop("_hot").withColumn(name, rank)
    return plain.unionByName(over_parts(marked.where("_hot").drop("_hot"), keys, order, name))


def first_rows(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each key: each part of a key is cut to so many before the rest meet."""
    parted = rows.withColumn("_part", F.spark_partition_id())
    some = parted.withColumn("_r", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))).where(F.col("_r") <= most)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r", "_part")


def ordered_text(rows: DataFrame, key: str, at: str, text: str, limit: int = 12_000, separator: str = "\n", block: int = 1024) -> DataFrame:
    """(key, text): each key's texts in the order of the integer `at`, joined and cut at `limit` characters; empty and null ones are left out.

    Lengths are summed by blocks of `at` first; only blocks that begin before the limit are read again, and each text is cut
    to what is left for it before a key's rows meet. So no key's text is held beyond the limit and one block's rows. at tells
    a key's rows apart. Keys without any text have no row.
    """
    gap = len(separator)
    some = rows.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(at).cast("long").alias("at"), F.col(text).alias("t"), F.floor(F.col(at) / block).cast("long").alias("b"))
    sums = some.groupBy("k", "b").agg(F.sum(F.length("t") + gap).alias("n"))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("b")) - F.col("n")
    blocks = sums.withColumn("before", before).where(F.col("before") < limit).select(F.col("k").alias("k2"), F.col("b").alias("b2"), "before")
    near = some.join(blocks, F.col("k").eqNullSafe(F.col("k2")) & (F.col("b") == F.col("b2")))
    start = F.col("before") + F.sum(F.length("t") + gap).over(Window.partitionBy("k", "b").orderBy("at")) - F.length("t") - gap
    cut = near.withColumn("start", start).where(F.col("start") < limit).select("k", "at", F.substring(F.col("t"), F.lit(1), (F.lit(limit) - F.col("start")).cast("int")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda s: s["t"]), separator)
    return cut.groupBy("k").agg(joined.alias("t")).select(F.col("k").alias(key), F.substring("t", 1, limit).alias(text))
