"""How queries are registered, and pieces of SQL that several twins share."""

from __future__ import annotations

from collections.abc import Callable

# The derived tables, as DuckDB sees them.
FILES = """files AS (
  SELECT *, substr(sha256(relative_path), 1, 16) AS file_id FROM (
    SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS relative_path, doc_id || '.txt' AS filename, '.txt' AS extension,
           sha256(text) AS file_hash, CAST(strlen(text) AS BIGINT) AS size_bytes, source AS inferred_category, text FROM documents))"""
CATALOG = """catalog AS (
  SELECT relative_path, CASE doc_id % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'archived' ELSE 'active' END AS status,
         CAST(doc_id % 5 AS INTEGER) AS authoritative_rank, CASE WHEN doc_id % 11 = 0 THEN inferred_category END AS version_group FROM files)"""
ELEMENTS = """elements AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS ordinal, parts[i] AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
  WHERE trim(parts[i], ' ') <> '')"""
TOKENS = r"regexp_extract_all(replace(lower({0}), '-', ' '), '[\p{{L}}\p{{N}}_]+')"
STOP = "('а','без','в','во','где','для','до','есть','если','имеет','из','или','и','как','каки','каку','каков','когда','кто','к','ко','ли','на','не','но','об','о','от','по','почему','при','про','найт','с','со','что')"
CONTENT = "list_filter(" + TOKENS + ", lambda t: t NOT IN " + STOP + r" AND (length(t) > 2 OR regexp_full_match(t, '\p{{Nd}}+')))"
QUESTIONS = r"""questions AS (
  SELECT item_id AS query_id, array_to_string(""" + CONTENT.format("text") + r"""[1:6], ' ') AS question, substr(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), 1, 80) AS gold_start FROM benchmark)"""


class Part:
    """A module's queries and twins, filled by the decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def add(fn: Callable) -> Callable:
            self.queries[fn.__name__] = fn
            if sql:
                self.oracles[fn.__name__] = sql
            return fn

        return add


def sql(*tables: str, select: str) -> str:
    return "WITH " + ", ".join(tables) + " " + select
