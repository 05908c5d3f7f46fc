"""Ingestion runs: only new and changed files are read, and one pointer publishes all that a run has made.

    root/manifest/run=<id>   a row for each file: content, state, counts, and the run that wrote its chunks
    root/chunks|vectors|postings/run=<id>   what a run made of the files that it read
    root/pointers/<n>.json   the published runs; the highest number is the active one

A run writes below its own id and is unseen until its pointer is there; one that fails halfway leaves no trace for readers, and
may run again under the same id. Readers join chunks, vectors and postings with the active manifest by (file_id, run).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions.text import tokens
from quillmere.operators import chunking, corpus
from quillmere.operators.embedding import Provider, default_provider, index_vectors
from quillmere.operators.retrieval import term_counts
from quillmere.operators.runs import NAME

MANIFEST = "file_id string, relative_path string, file_hash string, size_bytes long, recipe string, status string, chunk_count long, locator_count long, required_metadata_count long, segment string"
REQUIRED = ["file_id", "relative_path", "source_type", "citation_id"]
Chunker = Callable[[DataFrame], DataFrame]


class _Folder:
    """Names below a Hadoop path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(self.conf)

    def child(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.path)) if self.files.exists(self.path) else []

    def read(self, name: str) -> str:
        f = self.files.open(self.child(name))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def create(self, name: str, text: str) -> None:
        """Write under another name and rename; a name that is taken is an error, so of two writers one fails."""
        own = self.child(f".{name}.tmp")
        f = self.files.create(own, True)
        f.write(text.encode())
        f.close()
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.conf).rename(self.files.makeQualified(own), self.files.makeQualified(self.child(name)), none)


def pointers(spark: SparkSession, root: str) -> list[dict]:
    """The published runs, oldest first."""
    folder = _Folder(spark, f"{root}/pointers")
    return [json.loads(folder.read(n)) for n in folder.names() if n.endswith(".json") and not n.startswith(".")]


def active_run(spark: SparkSession, root: str) -> str | None:
    published = pointers(spark, root)
    return published[-1]["run"] if published else None


def manifest(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    """The manifest of a run, by default of the active one; before the first run it is empty."""
    run = run or active_run(spark, root)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/run={run}") if run else spark.createDataFrame([], MANIFEST)


def active(spark: SparkSession, root: str, name: str, run: str | None = None) -> DataFrame:
    """chunks, vectors or postings of a run's files: only the folders that its manifest names are listed and read."""
    files = manifest(spark, root, run).where("chunk_count > 0").select("file_id", "segment")
    segments = [r.segment for r in files.select("segment").distinct().collect()]  # runs, which compact() keeps few
    if not segments:
        raise ValueError("nothing is published")
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(*[f"{root}/{name}/run={s}" for s in segments])
    return rows.withColumn("segment", F.col("run").cast("string")).drop("run").join(files, ["file_id", "segment"], "left_semi")


def changes(files: DataFrame, old: DataFrame, recipe: str) -> DataFrame:
    """files with `action`: new, changed (other bytes, or made by another recipe) or kept, and what the old manifest says of kept ones."""
    was = old.select("file_id", F.col("file_hash").alias("old_hash"), F.col("recipe").alias("old_recipe"), "status", "chunk_count", "locator_count", "required_metadata_count", "segment")
    same = F.col("old_hash").eqNullSafe(F.col("file_hash")) & F.col("old_recipe").eqNullSafe(F.lit(recipe))
    return files.join(was, "file_id", "left").withColumn("action", F.when(F.col("segment").isNull(), "new").when(same, "kept").otherwise("changed"))


def postings_of(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_id, length, term, tf): a chunk's terms are counted within its row, so nothing is shuffled."""
    ts = tokens(F.col("text"))
    rows = chunks.select(F.col("file_id").alias("field"), F.col("chunk_id").alias("doc_id"), ts.alias("ts"), F.size(ts).alias("length")).where("length > 0")
    return term_counts(rows).select(F.col("field").alias("file_id"), F.col("doc_id").alias("chunk_id"), "length", "term", "tf")


def run_ingestion(files: DataFrame, root: str, run: str, chunker: Chunker | None = None, provider: Provider | None = None, recipe: str = "400:50", on_step: Callable[[str], None] = lambda step: None) -> dict:
    """Bring the corpus at root to the state of `files` and publish it; returns what was done.

    files: file_id, relative_path, file_hash, size_bytes, source_type, text. A file without chunks has status no_text. Rows that
    repeat a file_id are an error. recipe names the settings of chunker and provider: where it changes, all files are read
    again. Without any change nothing is written and the active run stays. on_step is called before each step.
    """
    spark = files.sparkSession
    if not NAME.fullmatch(run):
        raise ValueError(f"not a run id: {run!r}")
    published = pointers(spark, root)
    before = published[-1]["run"] if published else None
    if run in {p["run"] for p in published}:
        raise ValueError(f"run {run} is published already")
    chunker, provider = chunker or chunking.build_chunks, provider or default_provider()
    on_step("scan")
    if twice := files.groupBy("file_id").count().where("count > 1").select("file_id").take(1):
        raise ValueError(f"several files with the id {twice[0].file_id}")
    old = manifest(spark, root)
    found = changes(files, old, recipe)
    counted = {r.action: r["count"] for r in found.groupBy("action").count().collect()}
    removed = old.join(files, "file_id", "left_anti").count()
    done = {"run": run, "previous": before, "new": counted.get("new", 0), "changed": counted.get("changed", 0), "kept": counted.get("kept", 0), "removed": removed}
    if before and not (done["new"] or done["changed"] or removed):
        return {**done, "run": before, "wrote": False}
    work = found.where("action <> 'kept'")
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}/run={run}")
    on_step("chunks")
    put(chunker(work.select("file_id", "relative_path", "source_type", "text")), "chunks")
    chunks = spark.read.parquet(f"{root}/chunks/run={run}")
    on_step("vectors")
    made = index_vectors(chunks.select("file_id", "chunk_id", "text"), provider, "chunk_id", "text")
    put(made.select("file_id", "chunk_id", "embedding", "error"), "vectors")
    on_step("postings")
    put(postings_of(chunks), "postings")
    on_step("manifest")
    stats = corpus.chunk_stats(chunks, REQUIRED)
    columns = [c.split()[0] for c in MANIFEST.split(", ")]
    fresh = work.drop("status", "chunk_count", "locator_count", "required_metadata_count", "segment").join(stats, "file_id", "left").fillna(0, ["chunk_count", "locator_count", "required_metadata_count"])
    fresh = fresh.withColumns({"status": F.when(F.col("chunk_count") > 0, "indexed").otherwise("no_text"), "segment": F.lit(run)})
    put(fresh.unionByName(found.where("action = 'kept'"), allowMissingColumns=True).withColumn("recipe", F.lit(recipe)).select(columns), "manifest")
    on_step("publish")
    _Folder(spark, f"{root}/pointers").create(f"{len(published):012d}.json", json.dumps(done))
    return {**done, "wrote": True}


def compact(spark: SparkSession, root: str, run: str) -> dict:
    """Publish the active corpus as one run of its own, so that readers list one folder; nothing is read from the sources."""
    published = pointers(spark, root)
    if not published:
        raise ValueError("nothing is published")
    before = published[-1]["run"]
    for name in ("chunks", "vectors", "postings"):
        active(spark, root, name, before).drop("segment").write.mode("overwrite").parquet(f"{root}/{name}/run={run}")
    manifest(spark, root, before).withColumn("segment", F.lit(run)).write.mode("overwrite").parquet(f"{root}/manifest/run={run}")
    done = {"run": run, "previous": before, "compacted": True}
    _Folder(spark, f"{root}/pointers").create(f"{len(published):012d}.json", json.dumps(done))
    return done


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """The corpus ledger of the active run, from its manifest alone."""
    rows = corpus.duplicate_groups(manifest(spark, root))
    stats = rows.select("file_id", "chunk_count", "locator_count", "required_metadata_count")
    return corpus.ledger(rows.drop("chunk_count", "locator_count", "required_metadata_count"), stats, vector_indexed=True)
