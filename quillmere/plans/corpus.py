"""Queries of the ingestion operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import ids, text
from quillmere.operators import chunking
from quillmere.operators import corpus as ops
from quillmere.plans.base import CATALOG, CONTENT, ELEMENTS, FILES, TOKENS, Part, sql
from quillmere.sources import readers
from quillmere.sources.tables import catalog, elements, files, spread, table

query = Part()
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(table(spark, sf_dir, "documents"))


@query(sql(FILES, select="SELECT file_id, relative_path, filename, extension, size_bytes, file_hash, inferred_category, 'text' AS extraction_method FROM files"))
def file_manifest(spark, sf_dir):
    x = _files(spark, sf_dir).where(~readers.skipped(F.col("relative_path")))
    return x.select("file_id", "relative_path", "filename", "extension", "size_bytes", "file_hash", "inferred_category", readers.method(F.col("extension")).alias("extraction_method"))


@query(sql(FILES, select="SELECT relative_path, CASE WHEN count(*) OVER (PARTITION BY file_hash) > 1 THEN 'sha256:' || file_hash END AS duplicate_group_id FROM files"))
def duplicate_groups(spark, sf_dir):
    return ops.duplicate_groups(_files(spark, sf_dir)).select("relative_path", "duplicate_group_id")


@query(sql(FILES, CATALOG, select="SELECT relative_path, status, authoritative_rank, version_group FROM files LEFT JOIN catalog USING (relative_path)"))
def authority_enrichment(spark, sf_dir):
    x = _files(spark, sf_dir)
    return ops.with_authority(x.select("relative_path"), catalog(x)).select("relative_path", "status", "authoritative_rank", "version_group")


@query(sql(FILES, CATALOG, select="""SELECT file_hash, first(relative_path ORDER BY CASE status WHEN 'active' THEN 3 WHEN 'draft' THEN 2 WHEN 'archived' THEN 1 ELSE 0 END DESC, authoritative_rank DESC, relative_path) AS canonical_source_path,
  count(DISTINCT relative_path) AS exact_duplicate_count FROM files JOIN catalog USING (relative_path) GROUP BY file_hash"""))
def canonical_files(spark, sf_dir):
    x = _files(spark, sf_dir)
    return ops.canonical_files(x, catalog(x))


@query(sql(FILES, select="SELECT file_hash, array_to_string(list_sort(list(DISTINCT relative_path)), ',') AS paths FROM files GROUP BY file_hash"))
def provenance_paths(spark, sf_dir):
    return ops.provenance(_files(spark, sf_dir)).select("file_hash", F.array_join("provenance_paths", ",").alias("paths"))


@query(sql(ELEMENTS, select="SELECT doc_id, ordinal, line, sha1(line) AS element_hash, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) || ':' || substr(sha1(line), 1, 12) AS element_id FROM elements"))
def document_elements(spark, sf_dir):
    x = elements(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "ordinal", "line", F.sha1("line").alias("element_hash"), F.concat_ws(":", ids.file_id(F.col("doc_id").cast("string")), F.substring(F.sha1("line"), 1, 12)).alias("element_id"))


@query(sql(ELEMENTS, select=r"""SELECT doc_id, ordinal, last_value(h IGNORE NULLS) OVER w AS section_heading, count(h) OVER w AS segment FROM (
  SELECT doc_id, ordinal, CASE WHEN length(trim(line, ' ')) <= 60 AND regexp_matches(trim(line, ' '), '[.]$') THEN trim(line, ' ') END AS h FROM elements) WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""))
def heading_sections(spark, sf_dir):
    short = (F.length(F.trim("line")) <= 60) & F.trim("line").rlike("[.]$")
    return ops.sections(elements(table(spark, sf_dir, "documents")), short).select("doc_id", "ordinal", "section_heading", "segment")


@query(r"SELECT doc_id, CAST(len(" + TOKENS.format("text") + r") AS INTEGER) AS n_tokens, CAST(len(" + CONTENT.format("text") + r") AS INTEGER) AS n_content, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS INTEGER) AS n_units, md5(array_to_string(" + TOKENS.format("text") + ", ' ')) AS normalized_md5 FROM documents")
def search_text(spark, sf_dir):
    t = F.col("text")
    return spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.size(text.tokens(t)).alias("n_tokens"), F.size(text.content_tokens(t)).alias("n_content"), text.token_count(t).alias("n_units"), F.md5(text.normalize(t)).alias("normalized_md5"))


@query(r"""SELECT doc_id, 'content_sha256:' || substr(sha256(trim(text, ' ')), 1, 12) AS fingerprint, md5(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '))) AS content_key_md5,
  CASE WHEN length(c) > 80 THEN rtrim(substr(c, 1, 80), ' ') || '...' ELSE c END AS preview, source || '/' || lang || '/' || doc_id || '.txt#text:body-1:start-0:chunk-0' AS citation_id
  FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS c FROM documents)""")
def content_identity(spark, sf_dir):
    t, path = F.col("text"), F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    cite = ids.citation_id(path, F.lit("text"), ids.locator({}), F.lit("0"), F.lit("0"))
    return table(spark, sf_dir, "documents").select("doc_id", ids.fingerprint(t).alias("fingerprint"), F.md5(text.content_key(t)).alias("content_key_md5"), text.preview(t, 80).alias("preview"), cite.alias("citation_id"))


@query(sql(FILES, "parts AS (SELECT substr(file_id, 1, 2) AS part, count(*) AS n, sha256(string_agg(file_id || ':' || file_hash, chr(10) ORDER BY file_id)) AS h FROM files GROUP BY 1)", select="SELECT CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(part || ':' || h, chr(10) ORDER BY part)) AS corpus_version FROM parts"))
def corpus_version(spark, sf_dir):
    """An order-sensitive hash of the whole corpus in two levels: hashes of id ranges, then the hash of those."""
    x = _files(spark, sf_dir).select("file_id", "file_hash", F.substring("file_id", 1, 2).alias("part"))
    one = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda s: F.concat_ws(":", *[s[k] for k in c])), "\n"), 256)
    parts = x.groupBy("part").agg(F.count("*").alias("n"), one(["file_id", "file_hash"]).alias("h"))
    return parts.agg(F.sum("n").alias("files"), one(["part", "h"]).alias("corpus_version"))  # 256 parts at most


@query(sql(FILES, select="SELECT substr(file_id, 1, 2) AS part, count(*) AS n, sha256(string_agg(file_id || ':' || file_hash, chr(10) ORDER BY file_id)) AS h FROM files GROUP BY 1"))
def corpus_version_parts(spark, sf_dir):
    x = _files(spark, sf_dir).select("file_id", "file_hash", F.substring("file_id", 1, 2).alias("part"))
    rows = F.array_sort(F.collect_list(F.struct("file_id", "file_hash")))
    return x.groupBy("part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["file_id"], s["file_hash"])), "\n"), 256).alias("h"))


@query(f"""WITH h AS (SELECT doc_id, sha1(from_hex('{NAMESPACE.replace("-", "")}') || encode(text)) AS h FROM documents), d AS (SELECT doc_id, h, (CAST('0x' || substr(h, 17, 2) AS INTEGER) & 63) | 128 AS v FROM h)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || printf('%02x', v) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS stable_id FROM d""")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.uuid5(NAMESPACE, F.col("text")).alias("stable_id"))


@query(sql(FILES, select="SELECT extension, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, count(DISTINCT file_hash) AS contents FROM files GROUP BY extension"))
def extension_histogram(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("extension").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"), F.countDistinct("file_hash").alias("contents"))


def _chunks(docs: DataFrame) -> DataFrame:
    """Lines as chunks, with a locator on all but every ninth."""
    x = elements(docs).join(files(docs).select("doc_id", "file_id", "relative_path"), "doc_id")
    where = F.when(F.col("ordinal") % 9 != 8, F.concat(F.lit("line:"), F.col("ordinal").cast("string")))
    return x.select("doc_id", "ordinal", "file_id", "relative_path", where.alias("source_locator"), F.col("line").alias("text"))


LINES = "lines AS (SELECT e.doc_id, ordinal, file_id, relative_path, CASE WHEN ordinal % 9 <> 8 THEN 'line:' || ordinal END AS source_locator, line AS text FROM elements e JOIN files f USING (doc_id))"
STATES = "CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 19 = 0 THEN 'no_text' ELSE 'indexed' END"
LEDGER = f"""stats AS (SELECT file_id, count(*) AS chunk_count, count(*) FILTER (WHERE source_locator IS NOT NULL) AS located FROM lines GROUP BY file_id),
records AS (SELECT *, {STATES} AS status, CASE WHEN count(*) OVER (PARTITION BY file_hash) > 1 THEN 'sha256:' || file_hash END AS duplicate_group_id FROM files),
ledger AS (SELECT file_id, relative_path, status, duplicate_group_id, CASE WHEN duplicate_group_id IS NULL THEN 'unique' ELSE 'duplicate_group_member' END AS duplicate_action, coalesce(chunk_count, 0) AS chunk_count,
  CASE WHEN coalesce(chunk_count, 0) > 0 THEN round(located / chunk_count, 4) ELSE 0.0 END AS locator_coverage, CASE WHEN coalesce(chunk_count, 0) > 0 THEN round(located / chunk_count, 4) ELSE 0.0 END AS required_metadata_coverage,
  CASE WHEN status = 'indexed' AND coalesce(chunk_count, 0) > 0 THEN 'indexable' WHEN status = 'indexed' THEN 'indexed_without_chunks' WHEN status = 'failed' THEN 'extraction_failed' ELSE status END AS index_inclusion_reason,
  CASE WHEN status = 'indexed' AND coalesce(chunk_count, 0) > 0 THEN 'indexed' ELSE 'skipped' END AS keyword_index_status, 'skipped' AS vector_index_status FROM records LEFT JOIN stats USING (file_id))"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    status = F.when(F.col("doc_id") % 17 == 0, "failed").when(F.col("doc_id") % 19 == 0, "no_text").otherwise("indexed")
    records = ops.duplicate_groups(files(docs).withColumn("status", status))
    return ops.ledger(records, ops.chunk_stats(_chunks(docs), ["file_id", "relative_path", "source_locator"]))


@query(sql(FILES, ELEMENTS, LINES, LEDGER, select="SELECT * FROM ledger"))
def corpus_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)


@query(sql(FILES, ELEMENTS, LINES, LEDGER, select="""SELECT count(*) AS total_files, count(*) FILTER (WHERE status = 'indexed') AS indexed_files, count(*) FILTER (WHERE status = 'manifest_only') AS manifest_only_files, count(*) FILTER (WHERE status = 'no_text') AS no_text_files,
  count(*) FILTER (WHERE status = 'unsupported') AS unsupported_files, count(*) FILTER (WHERE status = 'failed') AS failed_files, CAST(sum(chunk_count) AS BIGINT) AS chunk_count, count(DISTINCT duplicate_group_id) AS duplicate_group_count,
  round(sum(round_even(locator_coverage * chunk_count, 0)) / sum(chunk_count), 4) AS locator_coverage, round(sum(round_even(required_metadata_coverage * chunk_count, 0)) / sum(chunk_count), 4) AS required_metadata_coverage FROM ledger"""))
def ledger_summary(spark, sf_dir):
    return ops.ledger_summary(_ledger(spark, sf_dir))


SHADOW = """old AS (SELECT doc_id || ':' || ordinal AS chunk_id, CAST(doc_id AS VARCHAR) AS file_id, 'line:' || ordinal AS locator, sha256(line) AS hash, doc_id * 1000000 + ordinal AS ord FROM elements),
new AS (SELECT 'n' || doc_id || ':' || ordinal AS chunk_id, CAST(doc_id AS VARCHAR) AS file_id, 'line:' || (ordinal + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS locator, sha256(CASE WHEN doc_id % 13 = 0 AND ordinal = 0 THEN line || ' (revised)' ELSE line END) AS hash, doc_id * 1000000 + ordinal AS ord FROM elements WHERE doc_id % 10 <> 3)"""
TIERS = """t1 AS (SELECT a.chunk_id AS o, b.chunk_id AS n FROM (SELECT *, row_number() OVER (PARTITION BY file_id, locator, hash ORDER BY ord, chunk_id) AS k FROM old) a JOIN (SELECT *, row_number() OVER (PARTITION BY file_id, locator, hash ORDER BY ord, chunk_id) AS k FROM new) b USING (file_id, locator, hash, k)),
t2 AS (SELECT a.chunk_id AS o, b.chunk_id AS n FROM (SELECT *, row_number() OVER (PARTITION BY file_id, hash ORDER BY ord, chunk_id) AS k FROM old WHERE chunk_id NOT IN (SELECT o FROM t1)) a JOIN (SELECT *, row_number() OVER (PARTITION BY file_id, hash ORDER BY ord, chunk_id) AS k FROM new WHERE chunk_id NOT IN (SELECT n FROM t1)) b USING (file_id, hash, k)),
u2 AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2),
t3 AS (SELECT a.chunk_id AS o, b.chunk_id AS n FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ord, chunk_id) AS k FROM old WHERE chunk_id NOT IN (SELECT o FROM u2)) a JOIN (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ord, chunk_id) AS k FROM new WHERE chunk_id NOT IN (SELECT n FROM u2)) b USING (hash, k)),
u3 AS (SELECT o, n, 'file_locator_hash' AS match_strategy FROM t1 UNION ALL SELECT o, n, 'file_hash' FROM t2 UNION ALL SELECT o, n, 'content_hash' FROM t3),
idmap AS (SELECT o AS old_chunk_id, n AS new_chunk_id, match_strategy FROM u3 UNION ALL SELECT chunk_id, NULL, 'unmatched' FROM old WHERE chunk_id NOT IN (SELECT o FROM u3) UNION ALL SELECT NULL, chunk_id, 'new_only' FROM new WHERE chunk_id NOT IN (SELECT n FROM u3))"""


def _versions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    e, d = elements(docs), F.col("doc_id")
    ord_ = d * 1000000 + F.col("ordinal")
    at = lambda shift: F.concat(F.lit("line:"), (F.col("ordinal") + shift).cast("string"))
    name = F.concat_ws(":", d.cast("string"), F.col("ordinal").cast("string"))
    old = e.select(name.alias("chunk_id"), d.cast("string").alias("file_id"), at(F.lit(0)).alias("locator"), F.sha2("line", 256).alias("hash"), ord_.alias("ord"))
    line = F.when((d % 13 == 0) & (F.col("ordinal") == 0), F.concat("line", F.lit(" (revised)"))).otherwise(F.col("line"))
    new = e.where(d % 10 != 3).select(F.concat(F.lit("n"), name).alias("chunk_id"), d.cast("string").alias("file_id"), at(F.when(d % 5 == 0, 1).otherwise(0)).alias("locator"), F.sha2(line, 256).alias("hash"), ord_.alias("ord"))
    return old, new


@query(sql(ELEMENTS, SHADOW, TIERS, select="SELECT * FROM idmap"))
def old_to_new_ids(spark, sf_dir):
    return ops.id_map(*_versions(table(spark, sf_dir, "documents")))


@query(sql(ELEMENTS, SHADOW, TIERS, select="""SELECT 'file_missing' AS code, CAST(doc_id AS VARCHAR) AS subject FROM documents WHERE doc_id % 10 = 3
UNION ALL SELECT 'status_regressed', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 10 <> 3 AND doc_id % 23 = 0 AND doc_id % 17 <> 0
UNION ALL SELECT 'chunk_unmapped', old_chunk_id FROM idmap WHERE match_strategy = 'unmatched'
UNION ALL SELECT 'gold_chunk_unmapped', old_chunk_id FROM idmap WHERE match_strategy = 'unmatched' AND ends_with(old_chunk_id, ':0')
UNION ALL SELECT 'gold_missing', 'gone:' || item_id FROM benchmark
UNION ALL SELECT 'indexed_regressed', 'corpus' WHERE (SELECT count(*) FROM documents WHERE doc_id % 10 <> 3 AND doc_id % 23 <> 0) < (SELECT count(*) FROM documents WHERE doc_id % 17 <> 0)
UNION ALL SELECT 'coverage_low', 'corpus'"""))
def promotion_gates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old, new = _versions(docs)
    row = lambda n: docs.select(F.col("doc_id").cast("string").alias("file_id"), F.when(F.col("doc_id") % n == 0, "failed").otherwise("indexed").alias("status"), F.lit(1).alias("chunk_count"), F.lit(0.9).alias("locator_coverage"), "doc_id")
    gold = old.where(F.col("locator") == "line:0").select(F.col("chunk_id").alias("context_id")).union(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("gone:"), F.col("item_id").cast("string"))))
    return ops.promotion_errors(row(17), row(23).where("doc_id % 10 <> 3"), old, ops.id_map(old, new), gold)


@query()
def chunks(spark, sf_dir):
    x = _files(spark, sf_dir).withColumn("source_type", F.when(F.col("doc_id") % 4 == 0, "table").otherwise("text"))
    return chunking.build_chunks(x)


@query(r"""WITH d AS (SELECT *, CASE n_chars % 3 WHEN 0 THEN 'rotated_page' WHEN 1 THEN '' END AS configured, CASE n_chars % 5 WHEN 0 THEN 'Flowchart.png' ELSE 'page.png' END AS file_name,
  regexp_replace(text, '^[ ]*[^ ]+', CASE n_chars % 4 WHEN 0 THEN 'No  visible text' WHEN 1 THEN 'I cannot text' WHEN 2 THEN 'Текст отсутствует' ELSE 'x' END) AS t FROM documents)
SELECT doc_id, CASE WHEN len(list_filter(string_split(t, chr(10)), lambda l: length(l) - length(replace(l, '|', '')) >= 2)) >= 2 THEN 'table' WHEN regexp_matches(lower(file_name || ' ' || t), 'схема|diagram|flowchart') THEN CASE WHEN configured = 'rotated_page' THEN 'rotated_diagram' ELSE 'diagram' END ELSE coalesce(nullif(configured, ''), 'flat_text') END AS layout_route,
  CASE WHEN regexp_matches(lower(t), '(^|[^\p{L}\p{N}_])(no\s+(visible|readable|recognizable)\s+text|(there is|i can(not|''t))\s+(no\s+)?(visible\s+)?text|текст\s+(не\s+виден|не\s+обнаружен|отсутствует))($|[^\p{L}\p{N}_])') THEN 'canned_no_text_response'
    WHEN doc_id % 2 = 0 AND len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) < 25 THEN 'decorative_or_too_short:' || len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) || '_tokens' END AS rejected,
  'sha256:' || sha256('{"max_pixels":' || n_chars || ',"model":"' || lang || '","rotate":' || CASE WHEN n_chars % 2 = 0 THEN 'true' ELSE 'false' END || ',"task":null}') AS recipe FROM d""")
def ocr_admission(spark, sf_dir):
    n = F.col("n_chars")
    first = F.when(n % 4 == 0, "No  visible text").when(n % 4 == 1, "I cannot text").when(n % 4 == 2, "Текст отсутствует").otherwise("x")
    d = table(spark, sf_dir, "documents").withColumn("t", F.regexp_replace("text", F.lit("^[ ]*[^ ]+"), first))
    kind, configured = F.when(F.col("doc_id") % 2 == 0, "embedded_image").otherwise("pdf_page"), F.when(n % 3 == 0, "rotated_page").when(n % 3 == 1, "")
    route = readers.layout_route(F.col("t"), configured, F.when(n % 5 == 0, "Flowchart.png").otherwise("page.png"))
    recipe = readers.recipe_hash({"model": F.col("lang"), "max_pixels": n, "rotate": n % 2 == 0, "task": F.lit(None).cast("string")})
    return d.select("doc_id", route.alias("layout_route"), readers.ocr_rejected(F.col("t"), kind, F.lit("dashscope:ocr")).alias("rejected"), recipe.alias("recipe"))


@query(sql(FILES, select="""SELECT file_hash, 'img' || (doc_id % 3) AS image_id, max(doc_id) AS updated, count(*) AS stores FROM files GROUP BY 1, 2"""))
def ocr_cache(spark, sf_dir):
    from quillmere.operators.records import latest_by_key

    x = _files(spark, sf_dir).select("file_hash", F.concat(F.lit("img"), (F.col("doc_id") % 3).cast("string")).alias("image_id"), F.col("doc_id").alias("updated"))
    n = x.groupBy("file_hash", "image_id").agg(F.count("*").alias("stores"))
    return latest_by_key(x.withColumn("o", F.col("updated")), ["file_hash", "image_id"], "o").select("file_hash", "image_id", "updated").join(n, ["file_hash", "image_id"])


@query(sql(FILES, select="SELECT inferred_category AS relative_path, min(doc_id) AS first_doc, 'Which rules does ' || inferred_category || ' describe?' AS question FROM files GROUP BY 1"))
def question_drafts(spark, sf_dir):
    x = _files(spark, sf_dir).groupBy(F.col("inferred_category").alias("relative_path")).agg(F.min("doc_id").alias("first_doc"))
    return x.withColumn("question", F.concat(F.lit("Which rules does "), "relative_path", F.lit(" describe?")))


@query(sql(FILES, select=r"SELECT doc_id, '| ' || doc_id || ' | ' || replace(trim(regexp_replace(substr(text, 1, 300), '\s+', ' ', 'g'), ' '), '|', '\|') || ' |' AS row FROM files"))
def markdown_report(spark, sf_dir):
    return _files(spark, sf_dir).select("doc_id", readers.markdown_row(F.col("doc_id"), text.collapse(F.substring("text", 1, 300))).alias("row"))


QUERIES, ORACLES = query.queries, query.oracles
