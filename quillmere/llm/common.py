"""What several operators share: staging in the shared folder, Python row for row, streamed groups and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegralType, StructField, StructType
from pyspark.sql.window import Window

#: Rows that Python sees at once; the values of no more rows are Python objects at a time.
ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset (tests, one machine), one of our own."""
    conf = spark.sparkContext.getConf()
    if where := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="quillmere-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; one without a scheme is in the cluster's default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of ours; one that is gone already does not matter."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is deleted when the driver's Python ends."""
    path = qualified(spark, f"{shared_dir(spark)}/quillmere-{name}-{uuid.uuid4().hex[:12]}")

    def drop() -> None:
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already; the folder is temporary anyway
            return

    atexit.register(drop)
    return path


def stage(df: DataFrame, name: str, used: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: it cuts the lineage and outlives executors. The path is added to `used`."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if used is not None:
        used.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, keep: list[str], use: list[str], columns: str, start: Callable[[], Callable[..., list]], rows: int = ROWS) -> DataFrame:
    """The columns `keep` of df, then `columns`, which Python computes row for row from the columns `use`.

    What is kept passes through Arrow as it is, so an id is exact whatever its type and whatever nulls stand beside it. start()
    is called once a task; what it returns gets an Arrow array for each used column, of some rows, and gives a list for each new column.
    """
    new = StructType.fromDDL(columns)
    kinds = [to_arrow_type(f.dataType) for f in new]
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                made = [pa.array(v, type=t) for v, t in zip(fn(*part.columns[n:]), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], [f"c{k}" for k in range(n + len(made))])

    given = df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate([*keep, *use])])
    schema = StructType([StructField(f"c{k}", f.dataType) for k, f in enumerate([*[df.schema[c] for c in keep], *new])])
    return given.mapInArrow(run, schema).toDF(*keep, *new.names)


def chosen(df: DataFrame, use: str, start: Callable[[], Callable[[pa.Array], list[bool]]], rows: int = ROWS) -> DataFrame:
    """The rows of df for which Python says so from the column `use`; rows pass through Arrow as they are."""
    at = df.columns.index(use)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                yield part.filter(pa.array(fn(part.column(at)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def ordinals(df: DataFrame, column: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """df with the column as a long that sorts alike, and (ordinal, value) to go back; integers stay as they are.

    Other types are numbered in the order of their values: parts by range, a running number in each, and the parts' counts before it.
    """
    if isinstance(df.schema[column].dataType, IntegralType):
        return df.withColumn(column, F.col(column).cast("long")), None
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    parts = stage(values.select("value").repartitionByRange("value").withColumn("part", F.spark_partition_id()), f"{name}-values")
    before = parts.groupBy("part").count().select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row for each part
    known = parts.join(before, "part").select("value", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("value"))).cast("long").alias("ordinal"))
    known = stage(known, f"{name}-ordinals")
    out = df.join(known, df[column] == known["value"], "left").drop("value").withColumn(column, F.col("ordinal")).drop("ordinal")
    return out, known


class Remembered:
    """A function of words, its results remembered in bounded memory: those of words met once and those of words met again.

    `learn` gives the results (never None) of a list of words. Each half holds `most` words, none of more than `longest`
    characters; the first is emptied when it is full, the older half of the second goes.
    """

    def __init__(self, learn: Callable[[list[str]], Iterable], most: int = 1 << 16, longest: int = 48) -> None:
        self.learn, self.most, self.longest = learn, most, longest
        self.often: dict[str, object] = {}
        self.once: dict[str, object] = {}

    def __call__(self, words: list[str]) -> list:
        often, once = self.often, self.once
        out = list(map(often.get, words))
        if None not in out:
            return out
        new: dict[str, list[int]] = {}
        for i in [i for i, v in enumerate(out) if v is None]:
            w = words[i]
            v = once.get(w)
            if v is not None:
                out[i] = often[w] = v
            elif w in new:
                new[w].append(i)
            else:
                new[w] = [i]
        for (w, at), v in zip(new.items(), self.learn(list(new)), strict=True):
            for i in at:
                out[i] = v
            if len(w) <= self.longest:
                once[w] = v
        if len(once) > self.most:
            once.clear()
        if len(often) > self.most:
            self.often = dict(islice(often.items(), self.most // 2, None))
        return out


def grouped(fn: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over rows sorted by keys within each partition: fn gets frames of whole groups, many groups at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for x in frames:
            if not len(x):
                continue
            last = x[keys].iloc[-1]
            same = pd.Series(True, index=x.index)
            for k in keys:
                same &= x[k] == last[k]
            n = len(x) - int(same.to_numpy()[::-1].cumprod().sum())
            if n:
                yield fn(pd.concat([*rest, x.iloc[:n]], ignore_index=True))
                rest = [x.iloc[n:]]
            elif rest and any(rest[-1][k].iloc[-1] != last[k] for k in keys):
                yield fn(pd.concat(rest, ignore_index=True))
                rest = [x]
            else:
                rest.append(x)
        if rest:
            yield fn(pd.concat(rest, ignore_index=True))

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, comp) of every node of the undirected edges (a, b): comp is the least id that can be reached.

    Least labels move along edges and then along pointers (a label's own label) until nothing changes.
    Everything stays distributed; the driver sees one count a round. No edges give no rows.
    """
    spark, used = edges.sparkSession, []
    both = edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct()
    both = stage(both, f"{name}-edges")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), f"{name}-labels", used)
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("comp").alias("m"))
        step = stage(labels.join(near, labels.id == near.a).select("id", F.least("comp", "m").alias("comp"), F.col("comp").alias("was")), f"{name}-step", used)
        up = step.select(F.col("id").alias("comp"), F.col("comp").alias("top"))
        new = stage(step.join(up, "comp").select("id", F.least("comp", "top").alias("comp"), "was"), f"{name}-labels", used)
        moved = new.where("comp <> was").count()
        labels = new.select("id", "comp")
        while len(used) > 1:  # only the last round's labels are read again
            discard(spark, used.pop(0))
        if not moved:
            return labels
