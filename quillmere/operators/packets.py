"""Evidence packets, annotations, trace selection and other row-shaping operators of evaluation and retrieval."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.functions.text import collapse


@dataclass(frozen=True)
class Settings:
    """Sizes and budgets of chunking and retrieval."""

    chunk_size: int = 400
    chunk_overlap: int = 50
    fetch_k: int = 70
    vector_k: int = 70
    keyword_limit: int = 30
    rerank_input: int = 100
    top_n: int = 10
    mmr_lambda: float = 0.4
    rrf_k: int = 60


def packets(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per row its gold ids resolved against chunks: as a chunk, else as a file, else not at all, and a status.

    rows: row_id, lane, gold (array); chunks: chunk_id, file_id, text. Ids keep their order; a row's gold list is small.
    """
    ids = rows.select("row_id", F.posexplode_outer("gold").alias("pos", "id"))
    c = chunks.select(F.col("chunk_id").alias("id"), F.col("text").alias("quote"))
    f = chunks.select(F.col("file_id").alias("id"), F.lit(True).alias("is_file")).distinct()
    x = ids.join(c, "id", "left").join(f, "id", "left")
    kind = F.when(F.col("quote").isNotNull(), "chunk").when(F.col("is_file"), "file").when(F.col("id").isNotNull(), "unresolved")
    got = x.groupBy("row_id").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id", kind.alias("kind"))))).alias("ids"))
    of = lambda k: F.transform(F.filter("ids", lambda s: s["kind"] == k), lambda s: s["id"])
    out = rows.join(got, "row_id").select("row_id", "lane", of("chunk").alias("resolved"), of("file").alias("file_only"), of("unresolved").alias("unresolved"))
    status = F.when(F.col("lane") == "refusal_out_of_corpus_behavior", "not_required").when(F.size("unresolved") > 0, "unresolved").when(F.size("file_only") > 0, "file_only").when(F.size("resolved") > 0, "resolved").otherwise("missing")
    return out.withColumn("gold_status", status)


def chunk_locator(c: dict[str, Column], text: Column) -> Column:
    """Where a chunk stands, and the first 300 characters of its text on one line."""
    names = ("chunk_id", "citation_id", "file_id", "relative_path", "file_name", "chunk_index", "page_number", "section_heading", "source_locator")
    return F.struct(*[c.get(k, F.lit(None).cast("string")).alias(k) for k in names], F.substring(collapse(text), 1, 300).alias("evidence_quote"))


def blockers(packet_rows: DataFrame) -> DataFrame:
    """Packets that a strict run refuses."""
    return packet_rows.where(F.col("gold_status").isin("unresolved", "file_only", "missing"))


def context_recall(retrieved: Column, gold: Column) -> Column:
    """Share of gold ids among the retrieved ones; null without gold."""
    return F.when(F.size(F.array_distinct(gold)) > 0, F.size(F.array_intersect(retrieved, gold)) / F.size(F.array_distinct(gold)))


def annotations(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """A row for each metric that has a value: key, metric, score, label."""
    x = rows.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(key, metrics, "metric", "score").where(F.col("score").isNotNull())
    return x.withColumn("label", F.when(F.col("score") >= 0.5, "pass").otherwise("fail"))


def positional_merge(left: DataFrame, right: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """Rows joined by position; the right one's values win where they are there."""
    r = right.select(at, *[F.col(c).alias(f"__{c}") for c in columns])
    return left.join(r, at, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in left.columns])


def run_traces(spans: DataFrame, run: str) -> DataFrame:
    """Spans of the traces that name the run; where none does, those of the trace with the latest root. spans: trace_id, parent, time, run_id."""
    named = spans.where(F.col("run_id") == run).select("trace_id").distinct().withColumn("o", F.lit(0))
    latest = spans.where("parent is null").agg(F.max_by("trace_id", F.struct("time", "trace_id")).alias("trace_id")).where("trace_id is not null").withColumn("o", F.lit(1))
    best = named.union(latest)
    first = best.agg(F.min("o").alias("least"))
    return spans.join(best.join(F.broadcast(first), F.col("o") == F.col("least")).select("trace_id"), "trace_id", "left_semi")  # first is one row


def annotated(legs: DataFrame, order: Column, rank: str) -> DataFrame:
    """Sets a 0-based rank where a row has none, in the given order within its query."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(order)) - 1
    return legs.withColumn(rank, F.coalesce(F.when(F.col(rank) >= 0, F.col(rank).cast("int")), place)) if rank in legs.columns else legs.withColumn(rank, place)


def inside(root: str, path: Column) -> Column:
    """The path below root, or null if it would lead outside."""
    parts = F.split(path, "/")
    bad = F.exists(parts, lambda p: p == "..") | path.startswith("/") | (F.trim(path) == "")
    return F.when(~bad, F.concat(F.lit(root.rstrip("/") + "/"), path))


def email_errors(email: Column, password: Column) -> Column:
    """What is wrong with a registration, or null."""
    return F.when(~F.lower(F.trim(email)).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "invalid email").when(F.length(password) < 8, "password too short")
