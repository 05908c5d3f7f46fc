"""From evidence to answers: prompts, providers, refusals, citations, groundedness, and what the interface shows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.text import REFUSALS, citation_check, preview

#: A provider turns (question, prompt, first evidence text) into an answer column; a model is called in a pandas UDF.
AnswerProvider = Callable[[Column, Column, Column], Column]


def extractive(question: Column, prompt: Column, first: Column) -> Column:
    """The default provider: the first evidence's first 200 characters, cited."""
    return F.concat(preview(first, 200), F.lit(" [S1]"))


def prompts(evidence: DataFrame) -> DataFrame:
    """Per query the cited evidence in rank order: prompt, citations, first text. evidence: query_id, final_rank, source_type, text; a query has top_n rows."""
    rows = F.array_sort(F.collect_list(F.struct("final_rank", "source_type", "text")))
    x = evidence.groupBy("query_id").agg(rows.alias("e"))
    mark = lambda s: F.concat(F.lit("[S"), (s["final_rank"] + 1).cast("string"), F.lit("]"))
    cited = F.transform("e", lambda s: F.concat_ws(" ", mark(s), s["source_type"]))
    body = F.array_join(F.transform("e", lambda s: F.concat_ws("\n", mark(s), s["text"])), "\n\n")
    return x.select("query_id", body.alias("prompt"), cited.alias("citations"), F.get("e", F.lit(0))["text"].alias("first"), F.size("e").alias("evidence_count"))


def answer(queries: DataFrame, evidence: DataFrame, provider: AnswerProvider = extractive) -> DataFrame:
    """One row for each question: answer, status, citations and whether they hold. No evidence, or a refusal, gives the refusal."""
    x = queries.join(prompts(evidence), "query_id", "left")
    said = F.when(F.coalesce("evidence_count", F.lit(0)) == 0, F.lit(REFUSALS[0])).otherwise(F.coalesce(provider(F.col("question"), F.col("prompt"), F.col("first")), F.lit(REFUSALS[0])))
    x = x.withColumn("answer", said).withColumn("citations", F.when(F.col("answer") == REFUSALS[0], F.array().cast("array<string>")).otherwise(F.col("citations")))
    check = citation_check(F.col("answer"), F.col("citations"))
    status = F.when(F.col("answer") == REFUSALS[0], "no_relevant_documents").otherwise("answered")
    return x.select("query_id", "question", "answer", status.alias("status"), "citations", check["valid"].alias("citations_valid"), check["invalid"].alias("invalid_citations"))


def grounding(rows: DataFrame) -> DataFrame:
    """Adds resolved, unresolved, cited_ids and grounded (null where it does not apply).

    rows: citations, documents (array of struct id, names), gold (ids), expected_behavior. A citation and a name match when one
    holds the other and both have three characters; both lists belong to one answer.
    """
    match = lambda c: F.transform(F.filter("documents", lambda d: F.exists(d["names"], lambda n: (F.length(c) >= 3) & (F.length(n) >= 3) & (F.contains(n, c) | F.contains(c, n)))), lambda d: d["id"])
    x = rows.withColumn("m", F.transform("citations", lambda c: F.struct(c.alias("c"), match(c).alias("ids"))))
    x = x.withColumn("unresolved", F.transform(F.filter("m", lambda m: F.size(m["ids"]) == 0), lambda m: m["c"])).withColumn("cited_ids", F.array_distinct(F.flatten(F.transform("m", lambda m: m["ids"]))))
    overlap = (F.size("gold") == 0) | F.arrays_overlap("cited_ids", "gold")
    none = F.when(F.col("expected_behavior").isin("cite_answer", "surface_conflict"), False)
    return x.withColumn("grounded", F.when(F.size("citations") == 0, none).otherwise((F.size("unresolved") == 0) & overlap)).drop("m")


def conflict_score(behaviour: Column, mentions: Column, decisive: Column, grounded: Column, cited: Column, gold: Column) -> Column:
    """Whether a conflict is shown as one: null where it does not apply."""
    need = F.when(F.size(gold) > 0, F.least(F.lit(2), F.size(gold))).otherwise(F.lit(2))
    return F.when(behaviour == "surface_conflict", mentions & ~decisive & F.coalesce(grounded, F.lit(False)) & (F.size(F.array_intersect(cited, gold)) >= need))


def file_groups(evidence: DataFrame) -> DataFrame:
    """Evidence by file in the order first seen: query_id, path, group_rank, chunks, best_score."""
    from pyspark.sql.window import Window

    x = evidence.groupBy("query_id", "path").agg(F.min("rank").alias("first"), F.count("*").alias("chunks"), F.max("score").alias("best_score"))
    return x.withColumn("group_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "path")) - 1).drop("first")


def first_attributes(chunks: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per key the first non-blank value of each column in the given order, and the number of rows."""
    filled = lambda c: F.trim(F.col(c)) != ""
    return chunks.groupBy(key).agg(F.count("*").alias("chunk_count"), *[F.min_by(F.when(filled(c), F.col(c)), F.when(filled(c), F.col(order))).alias(c) for c in columns])


def leg_status(provider_matches: Column, available: Column, failed: Column, rows: Column) -> Column:
    return F.when(~provider_matches, "provider_mismatch").when(~available, "unavailable").when(failed, "failed").when(rows > 0, "ok").otherwise("empty")


def degraded_tags(vector: Column, keyword: Column, fallback: Column) -> Column:
    """Distinct short tags for legs that did not work and for the reranker's fallback."""
    safe = F.substring(F.regexp_replace(F.lower(fallback), "[^a-z0-9_.-]+", "_"), 1, 80)
    return F.array_distinct(F.array_compact(F.array(F.when(~vector.isin("ok", "empty"), F.concat(F.lit("vector_"), vector)), F.when(~keyword.isin("ok", "empty"), F.concat(F.lit("keyword_"), keyword)), F.when(safe != "", F.concat(F.lit("fallback_"), safe)))))
