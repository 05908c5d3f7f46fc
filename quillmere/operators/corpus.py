"""Ingestion operators: duplicates, authority, elements, chunk statistics, ledger, old-to-new ids, promotion gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.functions.text import coverage
from quillmere.operators.ranks import first_rows, rank_within, staged

ID_MAP = ["chunk_id", "file_id", "locator", "hash", "ord"]
PRIORITY = {"active": 3, "draft": 2, "archived": 1}


def duplicate_groups(manifest: DataFrame) -> DataFrame:
    """Adds duplicate_group_id to rows whose hash occurs more than once. Counts are summed before the join, so a hot hash is no hot task."""
    n = manifest.where(F.col("file_hash").isNotNull()).groupBy("file_hash").agg(F.count("*").alias("copies")).where("copies > 1")
    return manifest.join(n, "file_hash", "left").withColumn("duplicate_group_id", F.when(F.col("copies").isNotNull(), F.concat(F.lit("sha256:"), "file_hash"))).drop("copies")


def with_authority(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Left join on relative_path; a path that the catalogue lacks is active with rank 0."""
    x = manifest.join(catalog, "relative_path", "left")
    return x.withColumns({"status": F.coalesce("status", F.lit("active")), "authoritative_rank": F.coalesce("authoritative_rank", F.lit(0))})


def authority_metadata(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """manifest (relative_path, inferred_category, extension, ...) with all that the catalogue says of a path, and its defaults where it says nothing."""
    blank = lambda c: F.nullif(F.trim(F.col(f"c.{c}")), F.lit(""))
    x = manifest.alias("m").join(catalog.alias("c"), F.col("m.relative_path") == F.col("c.relative_path"), "left")
    return x.select(
        "m.*", F.coalesce(blank("department"), "m.inferred_category", F.lit("")).alias("department"), F.coalesce(blank("document_type"), F.nullif("m.extension", F.lit("")), F.lit("unknown")).alias("document_type"),
        F.coalesce(blank("status"), F.lit("active")).alias("authority_status"), F.col("c.effective_from").alias("effective_from"), F.col("c.effective_to").alias("effective_to"), F.col("c.owner").alias("document_owner"),
        F.coalesce("c.authoritative_rank", F.lit(0)).alias("authoritative_rank"), F.coalesce("c.supersedes", F.array().cast("array<string>")).alias("supersedes"), F.col("c.version_group").alias("version_group"),
    )


def canonical_files(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row for each file_hash: the path to keep (best status, rank, first path), and how many paths share the bytes.

    Rows without a hash are kept as they are. Aggregates are partial before the shuffle, so a hash that many files share is safe.
    """
    x = with_authority(manifest.select("relative_path", "file_hash"), catalog)
    priority = F.coalesce(*[F.when(F.lower("status") == s, p) for s, p in PRIORITY.items()], F.lit(0))
    best = F.min_by("relative_path", F.struct((-priority).alias("p"), (-F.col("authoritative_rank")).alias("r"), "relative_path"))
    kept = x.where(F.coalesce(F.trim("file_hash"), F.lit("")) != "").groupBy("file_hash").agg(best.alias("canonical_source_path"), F.countDistinct("relative_path").alias("exact_duplicate_count"))
    alone = x.where(F.coalesce(F.trim("file_hash"), F.lit("")) == "").select("file_hash", F.col("relative_path").alias("canonical_source_path"), F.lit(1).cast("long").alias("exact_duplicate_count"))
    return kept.unionByName(alone)


def provenance(manifest: DataFrame) -> DataFrame:
    """file_hash, sorted distinct paths that hold it."""
    return manifest.groupBy("file_hash").agg(F.array_sort(F.collect_set("relative_path")).alias("provenance_paths"))


def provenance_bounded(manifest: DataFrame, most: int = 100) -> DataFrame:
    """file_hash, how many distinct paths hold it, and the first `most` of them in order: no row grows with the number of copies."""
    paths = manifest.select("file_hash", "relative_path").distinct()
    counts = paths.groupBy("file_hash").agg(F.count("*").alias("n_paths"))
    some = first_rows(paths, ["file_hash"], ["relative_path"], most).groupBy("file_hash").agg(F.array_sort(F.collect_list("relative_path")).alias("first_paths"))
    return counts.join(some, counts.file_hash.eqNullSafe(some.file_hash)).select(counts.file_hash, "n_paths", "first_paths")


def is_heading(line: Column) -> Column:
    """A numbered line of at most 140 characters that ends with none of . ; ,"""
    t = F.trim(line)
    return t.rlike(r"^\d+(\.\d+)*[.)]?\s+\S") & (F.length(t) <= 140) & ~t.rlike("[.;,]$")


def sections(lines: DataFrame, heading: Column) -> DataFrame:
    """Adds section_heading (the last heading at or before the line) and segment (how many headings came so far)."""
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("h", F.when(heading, F.trim("line"))).withColumns({"section_heading": F.last("h", ignorenulls=True).over(w), "segment": F.count("h").over(w)}).drop("h")


def ladder(*cases: tuple[Column, object], otherwise: object = None) -> Column:
    out = reduce(lambda c, x: c.when(x[0], x[1]), cases[1:], F.when(*cases[0]))
    return out.otherwise(otherwise)


def inclusion_reason(status: Column, chunks: Column, failure: Column) -> Column:
    return ladder(((status == "indexed") & (chunks > 0), "indexable"), (status == "indexed", "indexed_without_chunks"), (status.isin("manifest_only", "no_text", "unsupported"), status), (status == "failed", F.coalesce(failure, F.lit("extraction_failed"))), otherwise=F.coalesce(F.when(status != "", status), F.lit("unknown")))


def index_status(status: Column, chunks: Column, indexed: Column, missed: str) -> Column:
    return F.when((status == "indexed") & (chunks > 0), F.when(indexed, "indexed").otherwise(missed)).otherwise("skipped")


def chunk_stats(chunks: DataFrame, required: list[str]) -> DataFrame:
    """By file: chunks, chunks with a locator, chunks with all required columns filled."""
    filled = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    whole = reduce(lambda a, b: a & b, [filled(c) for c in required])
    return chunks.where("file_id is not null").groupBy("file_id").agg(F.count("*").alias("chunk_count"), F.count_if(filled("source_locator")).alias("locator_count"), F.count_if(whole).alias("required_metadata_count"))


def ledger(records: DataFrame, stats: DataFrame, keyword_indexed: bool = True, vector_indexed: bool = False) -> DataFrame:
    """A row for each file: status, duplicates, chunk counts, coverages and index states."""
    x = records.join(stats, "file_id", "left").fillna(0, ["chunk_count", "locator_count", "required_metadata_count"])
    n, s = F.col("chunk_count"), F.col("status")
    return x.select("file_id", "relative_path", "status", "duplicate_group_id", F.when(F.col("duplicate_group_id").isNull(), "unique").otherwise("duplicate_group_member").alias("duplicate_action"), "chunk_count", coverage(F.col("locator_count"), n).alias("locator_coverage"), coverage(F.col("required_metadata_count"), n).alias("required_metadata_coverage"), inclusion_reason(s, n, F.lit(None).cast("string")).alias("index_inclusion_reason"), index_status(s, n, F.lit(keyword_indexed), "failed").alias("keyword_index_status"), index_status(s, n, F.lit(vector_indexed), "skipped").alias("vector_index_status"))


def ledger_summary(rows: DataFrame) -> DataFrame:
    n = F.sum("chunk_count")
    counted = lambda c: coverage(F.sum(F.bround(F.col(c) * F.col("chunk_count"))), n)
    each = [F.count_if(F.col("status") == s).alias(f"{s}_files") for s in ("indexed", "manifest_only", "no_text", "unsupported", "failed")]
    return rows.agg(F.count("*").alias("total_files"), *each, n.cast("long").alias("chunk_count"), F.countDistinct("duplicate_group_id").alias("duplicate_group_count"), counted("locator_coverage").alias("locator_coverage"), counted("required_metadata_coverage").alias("required_metadata_coverage"))


def id_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old to new chunk ids, one to one, in three tiers: same file, locator and content; same file and content; same content.

    Within a tier the k-th old row of a key takes the k-th free new row. Rows are (chunk_id, file_id, locator, hash, ord). Each
    tier works on what the one before has left, written once; a content that most rows share is ranked over several tasks.
    """
    left, free = staged(old.select(*ID_MAP), "old-chunks"), staged(new.select(*ID_MAP), "new-chunks")
    done = None
    for name, keys in (("file_locator_hash", ["file_id", "locator", "hash"]), ("file_hash", ["file_id", "hash"]), ("content_hash", ["hash"])):
        a = rank_within(left, keys, ["ord", "chunk_id"], "k").select(F.col("chunk_id").alias("old_chunk_id"), *keys, "k")
        b = rank_within(free, keys, ["ord", "chunk_id"], "k").select(F.col("chunk_id").alias("new_chunk_id"), *keys, "k")
        got = staged(a.join(b, [*keys, "k"]).select("old_chunk_id", "new_chunk_id", F.lit(name).alias("match_strategy")), "id-map")
        done = got if done is None else done.unionByName(got)
        left = staged(left.join(got, left.chunk_id == got.old_chunk_id, "left_anti"), "old-chunks")
        free = staged(free.join(got, free.chunk_id == got.new_chunk_id, "left_anti"), "new-chunks")
    gone = left.select(F.col("chunk_id").alias("old_chunk_id"), F.lit(None).cast(new.schema["chunk_id"].dataType).alias("new_chunk_id"), F.lit("unmatched").alias("match_strategy"))
    fresh = free.select(F.lit(None).cast(old.schema["chunk_id"].dataType).alias("old_chunk_id"), F.col("chunk_id").alias("new_chunk_id"), F.lit("new_only").alias("match_strategy"))
    return done.unionByName(gone).unionByName(fresh)


def promotion_errors(baseline: DataFrame, shadow: DataFrame, old: DataFrame, mapping: DataFrame, gold: DataFrame, least_coverage: float = 0.95) -> DataFrame:
    """(code, subject) for every gate that the shadow corpus fails. baseline and shadow are ledgers, old the baseline's chunks, gold context ids."""
    missing = baseline.join(shadow, "file_id", "left_anti").select(F.lit("file_missing").alias("code"), F.col("file_id").alias("subject"))
    b, s = baseline.where("status = 'indexed'").select("file_id"), shadow.where("status in ('failed', 'no_text')").select("file_id")
    regressed = b.join(s, "file_id", "left_semi").select(F.lit("status_regressed"), "file_id")
    mapped = mapping.where("old_chunk_id is not null and new_chunk_id is not null").select(F.col("old_chunk_id").alias("chunk_id")).distinct()
    unmapped = old.select("chunk_id").distinct().join(mapped, "chunk_id", "left_anti").select(F.lit("chunk_unmapped"), "chunk_id")
    ids = gold.distinct().join(shadow.select(F.col("file_id").alias("context_id")), "context_id", "left_anti")
    known = ids.join(old.select(F.col("chunk_id").alias("context_id")).distinct().withColumn("old", F.lit(True)), "context_id", "left").join(mapped.select(F.col("chunk_id").alias("context_id")).withColumn("kept", F.lit(True)), "context_id", "left")
    lost = known.where("kept is null").select(F.when(F.col("old"), "gold_chunk_unmapped").otherwise("gold_missing"), "context_id")
    counts = baseline.agg(F.count_if(F.col("status") == "indexed").alias("was")).crossJoin(shadow.agg(F.count_if(F.col("status") == "indexed").alias("now"), F.sum("chunk_count").alias("chunks"), F.round(F.avg(F.when(F.col("chunk_count") > 0, F.col("locator_coverage"))), 4).alias("coverage")))  # two rows of one
    gates = F.array(F.when(F.col("now") < F.col("was"), F.lit("indexed_regressed")), F.when(F.coalesce("chunks", F.lit(0)) == 0, F.lit("no_chunks")), F.when(F.col("coverage") < least_coverage, F.lit("coverage_low")))
    whole = counts.select(F.explode(F.array_compact(gates)).alias("code"), F.lit("corpus").alias("subject"))
    return missing.union(regressed).union(unmapped).union(lost).union(whole)
