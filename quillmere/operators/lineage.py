"""Traces and lineage: which attributes of documents and runs are shown, and whether an index is the one that the configuration names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.operators.ranks import over_parts

# Metadata that traces may carry, and where ids and scores are looked for.
SHOWN = (
    "citation_id", "chunk_id", "chunk_index", "file_name", "relative_path", "source_type", "section_heading", "page_number", "sheet_name",
    "image_index", "relevance_score", "_keyword_score", "_keyword_match_mode", "_keyword_rank", "_vector_rank", "_fusion_rank", "_rrf_score", "_fallback_score",
)
ID_FIELDS = ("chunk_id", "citation_id", "_id", "file_id")
SCORE_FIELDS = ("relevance_score", "_keyword_score", "_fallback_score")
LINEAGE_FIELDS = ("keyword_index", "vector_collection", "embedding_model")


def shown_metadata(metadata: Column, full: bool = False) -> Column:
    """The part of a map that traces may carry; nulls are left out, unless all is wanted."""
    return metadata if full else F.map_filter(metadata, lambda k, v: k.isin(*SHOWN) & v.isNotNull())


def hidden(key: Column, inputs: bool = False, outputs: bool = False, input_messages: bool = False, output_messages: bool = False, tools: bool = False, input_text: bool = False) -> Column:
    """Whether a configuration hides an attribute."""
    out = F.lit(False)
    for on, rule in (
        (inputs, key.isin("input.value", "input.mime_type") | key.startswith("input.")),
        (outputs, key.isin("output.value", "output.mime_type") | key.startswith("output.")),
        (input_messages, key.startswith("llm.input_messages.")),
        (output_messages, key.startswith("llm.output_messages.")),
        (tools, key.startswith("llm.tools.")),
        (input_text, key.endswith(".document.content")),
    ):
        out = out | rule if on else out
    return out


def document_id(metadata: Column) -> Column:
    """The first of a document's names that is not blank; a chunk's comes first."""
    return F.coalesce(*[F.nullif(F.try_element_at(metadata, F.lit(k)), F.lit("")) for k in ID_FIELDS])


def document_score(metadata: Column) -> Column:
    """The first of a document's scores that is a number."""
    return F.coalesce(*[F.try_element_at(metadata, F.lit(k)).try_cast("double") for k in SCORE_FIELDS])


def compact(text: Column, limit: int) -> Column:
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > limit, F.concat(F.rtrim(F.substring(one, 1, limit)), F.lit("..."))).otherwise(one)


def document_attributes(documents: DataFrame, limit: int, chars: int, prefix: str = "retrieval.documents", **hide: bool) -> DataFrame:
    """(query_id, attributes): the first `limit` documents of each query as one flat map; what is hidden or missing is left out.

    documents: query_id, rank, content, metadata (map).
    """
    at = lambda name, value: F.struct(F.concat(F.lit(f"{prefix}."), F.col("rank").cast("string"), F.lit(f".document.{name}")).alias("key"), value.alias("value"))
    shown = shown_metadata(F.col("metadata"))
    each = F.array(at("content", compact(F.col("content"), chars)), at("id", document_id(F.col("metadata"))), at("score", document_score(F.col("metadata")).cast("string")), at("metadata", F.when(F.size(shown) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(shown)))))))
    kept = F.filter(each, lambda e: e["value"].isNotNull() & ~hidden(e["key"], **hide))
    return documents.where(F.col("rank") < limit).select("query_id", F.explode(kept).alias("e")).groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("attributes"))


def provenance(values: dict[str, Column]) -> Column:
    """A run's markers as a map; blank ones are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in sorted(values.items())])
    return F.map_from_entries(F.filter(pairs, lambda e: F.coalesce(e["value"], F.lit("")) != ""))


def index_state(lineage: dict[str, Column], current: dict[str, Column]) -> Column:
    """What the index is, against the configuration: fresh, stale with the current values that differ, or unknown without a lineage.

    A blank field of the lineage counts as the current one.
    """
    held = {k: F.coalesce(F.nullif(F.trim(lineage[k]), F.lit("")), current[k]) for k in LINEAGE_FIELDS}
    differs = {k: ~held[k].eqNullSafe(current[k]) for k in LINEAGE_FIELDS}
    any_ = F.lit(False)
    for d in differs.values():
        any_ |= d
    none = F.lit(True)
    for k in lineage:
        none &= lineage[k].isNull()
    values = {k: F.when(none, current[k]).otherwise(held[k]) for k in LINEAGE_FIELDS}
    values |= {f"current_{k}": F.when(~none & differs[k], current[k]) for k in LINEAGE_FIELDS}
    values |= {k: F.when(~none, F.nullif(F.trim(v), F.lit(""))) for k, v in lineage.items() if k not in LINEAGE_FIELDS}
    return provenance(values | {"index_fresh": F.when(none, "unknown").when(any_, "stale").otherwise("fresh")})


def lineage_row(counts: DataFrame, names: dict[str, Column], keyword: bool = True, vector: bool = True) -> DataFrame:
    """The lineage of one run: its names and the counts of what each index holds. counts: one row with chunks and vectors."""
    return counts.select(
        *[v.alias(k) for k, v in names.items()], F.lit(keyword).alias("keyword_indexed"), F.lit(vector).alias("vector_indexed"), F.col("chunks").alias("chunk_count"),
        F.when(F.lit(keyword), F.col("chunks")).otherwise(0).alias("keyword_document_count"), F.when(F.lit(vector), F.col("vectors")).otherwise(0).alias("vector_document_count"),
    )


def dimensions(identifier: Column) -> Column:
    """The whole number after the last colon of a model's name, or null."""
    return F.when(F.contains(identifier, F.lit(":")), F.substring_index(identifier, ":", -1).try_cast("int"))


def metadata_values(rows: DataFrame, key: str) -> DataFrame:
    """The distinct non-blank values of one metadata field."""
    value = F.try_element_at("metadata", F.lit(key))
    return rows.select(value.alias("value")).where(F.trim("value") != "").distinct()


def matching_groups(groups: DataFrame, query: Column, name: str = "file_name", path: str = "display_path") -> DataFrame:
    """File groups whose name or path holds the query, whatever its case and spacing; a blank query keeps all."""
    wanted = F.lower(F.trim(F.regexp_replace(F.coalesce(query, F.lit("")), r"\s+", " ")))
    return groups.where((wanted == "") | F.contains(F.lower(F.concat(F.col(name), F.lit("\n"), F.col(path))), wanted))


def evidence_payload(evidence: Column) -> Column:
    """Evidence rows (content, metadata) as JSON: blank contents stay, nulls become empty."""
    return F.to_json(F.transform(evidence, lambda e: F.struct(F.coalesce(e["content"], F.lit("")).alias("page_content"), F.coalesce(e["metadata"], F.create_map().cast("map<string,string>")).alias("metadata"))))


def pending_users(users: DataFrame) -> DataFrame:
    """Users that wait for approval, with their place: the longest first, then by address."""
    return over_parts(users.where(F.col("status") == "pending"), [], ["created", "email"], "place")


def session_token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def element_hash(text: Column) -> Column:
    return F.sha1(text)
