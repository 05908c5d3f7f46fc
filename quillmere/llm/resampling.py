"""Importance resampling towards a target: hashed n-gram features, one weight a distinct text, Gumbel noise a document.

Identical texts are collapsed by grouping whole texts, so features and weight are computed once; the corpus counts multiply
them by the group's size. Weights go back to documents by the text's digest before noise is drawn from the document's own id.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.llm.common import stage

#: Bytes of UTF-8: A-Z become a-z, what is no part of a word becomes a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A text is parted into words in blocks of so many bytes.
BLOCK = 1 << 20
#: A text with a larger share of the documents than one in so many is a hot one; there are fewer of them than this.
HOT = 1 << 16


def _blocks(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        to = data.find(b" ", at + BLOCK)
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def feature_buckets(text: bytes, buckets: int) -> np.ndarray:
    """The bucket of each run of one or two words of a UTF-8 text."""
    out, last = [np.zeros(0, np.uint32)], None
    for words in _blocks(text.translate(LETTERS)):
        if words:
            one = list(map(crc32, words))
            before = one[:-1] if last is None else [last, *one[:-1]]
            out += [np.array(one, np.uint32), np.array([crc32(b" " + w, c) for w, c in zip(words[len(words) - len(before) :], before, strict=True)], np.uint32)]
            last = one[-1]
    return np.concatenate(out) % np.uint32(buckets)


def features(texts: DataFrame, buckets: int) -> DataFrame:
    """(digest, copies, n_features, buckets) of each row of texts (text, copies); buckets holds a little-endian number a feature."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 64) for x in batches for i in range(0, x.num_rows, 64)):
            found = [feature_buckets(t, buckets) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, found), pa.int64()), pa.array([f.astype(kind).tobytes() for f in found], pa.binary())], ["digest", "copies", "n_features", "buckets"])

    given = texts.select(F.sha2("text", 256).alias("digest"), "copies", F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(run, "digest string, copies long, n_features long, buckets binary")


def bucket_counts(made: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all documents fall into each bucket; a task gives one row a bucket at most."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            for copies, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                total += np.bincount(np.frombuffer(data.as_buffer(), kind), minlength=buckets) * copies
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return made.select("copies", "buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket: the floor of 1000 times the log ratio of its smoothed shares in target and source."""
    s, t = F.sum("s").over(Window.partitionBy()), F.sum("t").over(Window.partitionBy())  # over as many rows as there are buckets
    all_ = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    all_ = all_.select("bucket", *[F.col(c).cast("double").alias(c) for c in ("s", "t")], s.cast("double").alias("total_s"), t.cast("double").alias("total_t"))
    ratio = (F.col("t") + 1.0) * (F.col("total_s") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("total_t") + float(buckets)))
    return all_.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(digest, copies, n_features, weight) of each distinct text: weight is the floored mean gain of its features, 0 without any.

    Null texts count as empty ones. The driver holds one number a bucket, and `buckets` is a parameter.
    """
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")
    distinct = lambda df: df.groupBy(F.coalesce(df[text], F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    made = stage(features(distinct(docs), buckets), "resample-features")
    known = gains(bucket_counts(made, buckets), bucket_counts(features(distinct(target), buckets), buckets), buckets)
    gain = np.zeros(buckets, np.int64)
    for r in known.collect():
        gain[r.bucket] = r.gain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 256) for x in batches for i in range(0, x.num_rows, 256)):
            sums = [int(gain[np.frombuffer(d.as_buffer(), kind)].sum()) for d in b.column(3)]
            weight = [s // n if n else 0 for s, n in zip(sums, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(weight, pa.int64())], ["digest", "copies", "n_features", "weight"])

    return made.select("digest", "copies", "n_features", "buckets").mapInArrow(run, "digest string, copies long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A thousand Gumbel units from the hash of seed and id; a null id counts as empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs; rank is null for those that are not drawn.

    Of the documents with at least least_words words, percent of a hundred (rounded down) with the highest scores are drawn.
    Ties go to the smaller doc_id, null last, then to the text's digest; equal rows get ranks one after another. Null and
    empty texts have no features, weight 0 and are never drawn. No rows give no rows. Other columns are not looked at.
    """
    known = stage(weights(docs, target, buckets, text), "resample-weights")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"))
    rows = stage(rows.groupBy("doc_id", "digest").agg(F.count("*").alias("rows")), "resample-rows")
    total = known.agg(F.sum("copies")).first()[0] or 0
    known = known.select("digest", F.col("copies") * HOT > total, "n_features", "weight").toDF("digest", "hot", "n_features", "weight")
    hot = known.where("hot").select(F.col("digest").alias("of"), F.col("n_features").alias("n"), F.col("weight").alias("w"))  # fewer than HOT rows
    tried = rows.join(F.broadcast(hot), F.col("digest") == F.col("of"), "left")
    met = tried.where("of IS NOT NULL").select("doc_id", "digest", "rows", F.col("n").alias("n_features"), F.col("w").alias("weight"))
    rest = tried.where("of IS NULL").select("doc_id", "digest", "rows").join(known.where("NOT hot").drop("hot"), "digest")
    scored = met.unionByName(rest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("digest")]
    fit = F.col("n_features") >= 2 * least_words - 1  # w words give 2 w - 1 features
    parts = stage(scored.repartitionByRange(F.when(fit, 0).otherwise(1), *order).withColumn("fit", fit).withColumn("part", F.spark_partition_id()), "resample-parts")
    sums = parts.groupBy("part").agg(F.sum(F.when(F.col("fit"), F.col("rows")).otherwise(0)).alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part
    drawn = F.lit((sums.agg(F.sum("n")).first()[0] or 0) * percent // 100)
    upto = F.sum("rows").over(Window.partitionBy("part", "fit").orderBy(*order))
    ranked = parts.join(before, "part").withColumn("first", F.col("before") + upto - F.col("rows"))
    each = ranked.select("doc_id", "n_features", "weight", "score", "fit", F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("rows"))).alias("place"))
    return each.select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
