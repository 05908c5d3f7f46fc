"""Vectors of texts: providers, vector tables with the identity of what made them, and the gate that refuses stale ones."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from quillmere.functions.text import tokens


@dataclass(frozen=True)
class VectorIdentity:
    """What must agree between a vector table and the configuration that reads it."""

    provider: str
    embedding_model: str
    embedding_dimensions: int | None
    distance: str = "cosine"


@dataclass(frozen=True)
class Provider:
    """An embedding model: embed(texts, key, text) gives (key, embedding), a row for each row with a text; batches of `batch` rows suit it."""

    identity: VectorIdentity
    embed: Callable[[DataFrame, str, str], DataFrame]
    batch: int = 10


def hashed(texts: DataFrame, key: str, text: str, dimensions: int = 64) -> DataFrame:
    """The default model: a text's tokens are dealt to dimensions by their md5; 1 + ln of each one's count. Texts without tokens have no vector. Texts may also be given as their tokens.

    Tokens are counted within their row, each distinct one of some rows hashed once; what is shuffled, to add up the texts of a
    key, is a row of counts for each text. So neither texts nor tokens move, and a task holds one row a key of its part.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.greater(pc.list_value_length(batch.column(1)), 0), False))  # in Spark, a test on their number would make the tokens twice
            ts = batch.column(1)
            row = np.repeat(np.arange(len(ts)), pc.list_value_length(ts))
            codes = ts.flatten().dictionary_encode()
            place = np.array([int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % dimensions for t in codes.dictionary.to_pylist()], np.int64)
            n = np.bincount(row * dimensions + place[codes.indices.to_numpy()], minlength=len(ts) * dimensions)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(n), dimensions).cast(pa.list_(pa.int64()))], ["k", "n"])

    ts = F.col(text) if isinstance(texts.schema[text].dataType, ArrayType) else tokens(F.col(text))
    tokenized = texts.select(F.col(key).alias("k"), ts.alias("ts"))
    each = tokenized.mapInArrow(counted, StructType([StructField("k", texts.schema[key].dataType), *StructType.fromDDL("n array<long>")]))
    held = each.groupBy("k").agg(*[F.sum(F.get("n", F.lit(d))).alias(f"n{d}") for d in range(dimensions)])
    weights = [F.when(F.col(f"n{d}") > 0, 1 + F.log(F.col(f"n{d}").cast("double"))).otherwise(0.0) for d in range(dimensions)]
    return held.select(F.col("k").alias(key), F.array(*weights).alias("embedding"))


def default_provider(dimensions: int = 64) -> Provider:
    return Provider(VectorIdentity("hashed", f"token-md5:{dimensions}", dimensions), lambda x, key, text: hashed(x, key, text, dimensions))


def index_vectors(chunks: DataFrame, provider: Provider, key: str = "chunk_id", text: str = "embedding_text") -> DataFrame:
    """chunks with `embedding`. Repeated ids, and texts that the model left without a vector or gave one of another size, are errors in the rows concerned."""
    many = chunks.groupBy(key).count().where("count > 1").select(F.col(key).alias("again"))
    made = provider.embed(chunks.select(key, text), key, text)
    rows = chunks.join(made, key, "left").join(many, F.col(key) == F.col("again"), "left")
    size = provider.identity.embedding_dimensions
    wrong = F.when(F.col("again").isNotNull(), F.concat(F.lit("repeated id "), F.col("again").cast("string"))).when(F.col("embedding").isNull(), F.lit("no vector")).when(F.size("embedding") != (size if size else F.size("embedding")), F.lit("vector of another size"))
    return rows.withColumn("error", wrong).drop("again")


def mismatch(found: dict[str, Column], wanted: VectorIdentity) -> Column:
    """Names of the fields in which a vector table's identity differs from the wanted one; null-safe."""
    return F.filter(F.array(*[F.when(~found[k].eqNullSafe(F.lit(v)), F.lit(k)) for k, v in asdict(wanted).items()]), lambda x: x.isNotNull())


def require_compatible(found: VectorIdentity | None, wanted: VectorIdentity) -> None:
    """A table without an identity passes; one that another model made is refused."""
    if found is not None and found != wanted:
        raise ValueError(f"the vectors were made by {found}, the configuration names {wanted}")


def write_collection(vectors: DataFrame, path: str, identity: VectorIdentity, reset: bool = False) -> None:
    """Create the collection or, with reset, make it anew; its identity is written beside the rows. An existing one of another identity is refused."""
    spark = vectors.sparkSession
    if not reset:
        require_compatible(read_identity(spark, path), identity)
    vectors.write.mode("overwrite" if reset else "append").parquet(f"{path}/vectors")
    spark.createDataFrame([tuple(asdict(identity).values())], "provider string, embedding_model string, embedding_dimensions int, distance string").coalesce(1).write.mode("overwrite").json(f"{path}/identity")


def read_identity(spark, path: str) -> VectorIdentity | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/identity")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    r = spark.read.schema("provider string, embedding_model string, embedding_dimensions int, distance string").json(f"{path}/identity").first()
    return VectorIdentity(*r)
