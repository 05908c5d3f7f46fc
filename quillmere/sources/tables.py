"""The driver's tables and the corpus tables derived from them."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import ids
from quillmere.functions.text import blank_to_null, collapse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir; only a local master may go without one. It is deleted when the driver ends."""
    conf = spark.sparkContext.getConf()
    where = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not where:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}"
    path = f"{where.rstrip('/')}/quillmere-{name}-{uuid.uuid4().hex[:12]}"

    def drop() -> None:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already; the folder is temporary anyway
            return

    atexit.register(drop)
    return path


def spread(rows: DataFrame, key: str) -> DataFrame:
    """A table of fewer files than there are cores is dealt to all of them: one row group would keep one core busy. Larger ones stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if len(rows.inputFiles()) < cores else rows


def files(docs: DataFrame) -> DataFrame:
    """A manifest row for each document, as if it were a text file below its source and language."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    x = docs.select("doc_id", path.alias("relative_path"), F.sha2("text", 256).alias("file_hash"), F.octet_length("text").cast("long").alias("size_bytes"), F.col("source").alias("inferred_category"), "text")
    return x.select("doc_id", ids.file_id(F.col("relative_path")).alias("file_id"), "relative_path", F.substring_index("relative_path", "/", -1).alias("filename"), F.lit(".txt").alias("extension"), "file_hash", "size_bytes", "inferred_category", "text")


def elements(docs: DataFrame) -> DataFrame:
    """A row for each non-blank line: doc_id, ordinal (0-based, blank lines count), line."""
    x = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return x.where(F.trim("line") != "")


def catalog(manifest: DataFrame) -> DataFrame:
    """The authority catalogue: status, rank and version group by relative_path."""
    status = F.when(F.col("doc_id") % 7 == 0, "draft").when(F.col("doc_id") % 7 == 1, "archived").otherwise("active")
    group = F.when(F.col("doc_id") % 11 == 0, F.col("inferred_category"))
    return manifest.select("relative_path", status.alias("status"), (F.col("doc_id") % 5).cast("int").alias("authoritative_rank"), group.alias("version_group"))


def questions(bench: DataFrame) -> DataFrame:
    """The query set: one question for each benchmark item, its first six content tokens."""
    from quillmere.functions.text import content_tokens

    return bench.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(content_tokens(F.col("text")), 1, 6), " ").alias("question"), F.substring(collapse(F.col("text")), 1, 80).alias("gold_start"))


__all__ = ["blank_to_null", "catalog", "elements", "files", "questions", "shared_path", "spread", "table"]
