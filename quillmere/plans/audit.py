"""Queries of the evaluation contract, of lineage and of traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.operators import audit, embedding, lineage
from quillmere.plans.base import Part
from quillmere.sources.tables import table

query = Part()

# Audit rows drawn from the benchmark: lengths and words of the items choose what each claims.
_ROWS = r"""r AS (SELECT item_id AS pos, length(text) AS n, CASE WHEN length(text) % 11 = 0 THEN '  ' WHEN length(text) % 7 = 0 THEN 'same' ELSE 'q' || item_id END AS id,
  CASE length(text) % 5 WHEN 0 THEN 'cite_answer' WHEN 1 THEN 'surface_conflict' WHEN 2 THEN 'refuse_if_not_found' WHEN 3 THEN 'cite_answer' ELSE 'guess' END AS b,
  CASE length(text) % 6 WHEN 0 THEN 'indexed_answerability' WHEN 1 THEN 'conflict_version_behavior' WHEN 2 THEN 'refusal_out_of_corpus_behavior' WHEN 3 THEN 'known_missing_document_coverage' WHEN 4 THEN 'indexed_answerability' END AS lane,
  CASE length(text) % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'quarantine' WHEN 2 THEN 'needs_ingestion' END AS action, CASE WHEN length(text) % 3 = 0 THEN 'seen' WHEN length(text) % 3 = 1 THEN ' ' END AS reason,
  length(text) % 3 AS resolved, length(text) % 13 = 0 AS file_only, length(text) % 17 = 0 AS unresolved, length(text) % 2 AS current FROM benchmark)"""
_MISMATCH = (
    "lane IS NOT NULL AND b = 'cite_answer' AND lane NOT IN ('indexed_answerability', 'known_missing_document_coverage')",
    "lane IS NOT NULL AND b = 'surface_conflict' AND lane <> 'conflict_version_behavior'",
    "lane IS NOT NULL AND b = 'refuse_if_not_found' AND lane NOT IN ('refusal_out_of_corpus_behavior', 'known_missing_document_coverage')",
)
_RULES = [
    ("trim(id) = ''", "error", "missing_id", "'Eval row is missing id'"),
    ("seen > 1 AND trim(id) <> ''", "error", "duplicate_id", "'Duplicate eval row id ' || id"),
    ("b = 'guess'", "error", "invalid_expected_behavior", "'Invalid expected_behavior ''' || b || ''''"),
    ("file_only", "error", "file_only_reference_context_ids", "'reference_context_ids must identify chunks, not files'"),
    ("unresolved", "error", "unresolved_reference_context_ids", "'reference_context_ids must resolve against the extracted corpus index'"),
    ("lane IS NULL", "error", "invalid_lane", "'Invalid eval lane None'"),
    (_MISMATCH[0], "error", "lane_expected_behavior_mismatch", "'cite_answer rows must use indexed_answerability or known_missing_document_coverage lanes'"),
    (_MISMATCH[1], "error", "lane_expected_behavior_mismatch", "'surface_conflict rows must use conflict_version_behavior lane'"),
    (_MISMATCH[2], "error", "lane_expected_behavior_mismatch", "'refuse_if_not_found rows must use refusal_out_of_corpus_behavior or known_missing_document_coverage lanes'"),
    ("lane = 'indexed_answerability' AND coalesce(action, '') NOT IN ('quarantine', 'needs_ingestion') AND resolved < 1", "error", "missing_required_reference_context_ids", "'indexed_answerability rows require at least one resolving reference_context_id unless quarantined'"),
    ("lane = 'conflict_version_behavior' AND coalesce(action, '') NOT IN ('quarantine', 'needs_ingestion') AND resolved < 2", "error", "missing_required_reference_context_ids", "'conflict_version_behavior rows require at least two resolving reference_context_ids unless quarantined'"),
    ("lane = 'refusal_out_of_corpus_behavior' AND current > 0", "warning", "unexpected_reference_context_ids", "'out-of-corpus refusal rows should not carry reference_context_ids'"),
    ("action = 'quarantine' AND trim(coalesce(reason, '')) = ''", "error", "missing_quarantine_reason", "'quarantine rows require a quarantine_reason'"),
]
_FOUND = " UNION ALL ".join(f"SELECT pos, {k} AS k, '{s}' AS severity, nullif(trim(id), '') AS row_id, '{c}' AS code, {m} AS message FROM s WHERE {w}" for k, (w, s, c, m) in enumerate(_RULES))


@query(f"WITH {_ROWS}, s AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS seen FROM r), f AS ({_FOUND}) SELECT pos, CAST(row_number() OVER (PARTITION BY pos ORDER BY k) - 1 AS INTEGER) AS n, severity, row_id, code, message FROM f")
def audit_findings(spark, sf_dir):
    n = F.length("text")
    pick = lambda m, *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), n % m)
    several = lambda k: F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < k), lambda i: F.concat(F.lit("c"), i.cast("string")))
    rows = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("pos"), F.when(n % 11 == 0, "  ").when(n % 7 == 0, "same").otherwise(F.concat(F.lit("q"), F.col("item_id").cast("string"))).alias("id"),
        pick(5, "cite_answer", "surface_conflict", "refuse_if_not_found", "cite_answer", "guess").alias("expected_behavior"),
        pick(6, "indexed_answerability", "conflict_version_behavior", "refusal_out_of_corpus_behavior", "known_missing_document_coverage", "indexed_answerability", None).alias("lane"),
        pick(4, "keep", "quarantine", "needs_ingestion", None).alias("action"), pick(3, "seen", " ", None).alias("quarantine_reason"),
        several(n % 3).alias("resolved"), several((n % 13 == 0).cast("int")).alias("file_only"), several((n % 17 == 0).cast("int")).alias("unresolved"), several(n % 2).alias("current"),
    )
    return audit.findings(rows)


@query(r"""WITH c AS (SELECT conv_id, turn, role, text, length(text) % 4 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN CAST(length(text) AS DOUBLE) / 100 WHEN 1 THEN 0.5 WHEN 2 THEN CASE WHEN role = 'user' THEN 0.25 END ELSE NULL END AS score FROM c""")
def metric_scores(spark, sf_dir):
    k = F.length("text") % 4
    size = (F.length("text").cast("double") / 100).cast("string")
    record = F.when(k == 0, F.create_map(F.lit("faithfulness"), size, F.lit("score"), F.lit("9"))).when(k == 1, F.create_map(F.lit("faithfulness"), F.lit("NaN"), F.lit("faithfulness(b)"), F.lit("0.5"), F.lit("faithfulness(a)"), F.lit("x")))
    record = record.when(k == 2, F.create_map(F.lit("other"), F.lit("1"), F.lit("score"), F.when(F.col("role") == "user", "0.25").otherwise("none"))).otherwise(F.create_map(F.lit("faithfulness"), F.lit("Infinity")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", audit.metric_score(record, "faithfulness").alias("score"))


@query(r"""WITH e AS (SELECT item_id, text AS question, CASE item_id % 3 WHEN 0 THEN 'e' || item_id WHEN 1 THEN '' END AS id, CASE WHEN length(text) % 2 = 0 THEN 'cite_answer' ELSE 'refuse_if_not_found' END AS b,
  CASE WHEN length(text) % 3 = 0 THEN 'indexed_answerability' END AS lane, CASE WHEN length(text) % 5 = 0 THEN ' ' || split_part(text, ' ', 1) || ' ' END AS reason, CASE WHEN length(text) % 7 < 3 THEN split_part(text, ' ', 2) END AS answer FROM benchmark),
x AS (SELECT *, '{"expected_behavior": "' || b || '"' || coalesce(', "lane": "' || lane || '"', '') || coalesce(', "quarantine_reason": ' || CAST(to_json(trim(reason)) AS VARCHAR), '') || CASE WHEN coalesce(answer, '') <> '' THEN ', "reference_answer": ' || CAST(to_json(answer) AS VARCHAR) ELSE '' END || '}' AS expected FROM e)
SELECT coalesce(nullif(id, ''), sha1('{"expected": ' || expected || ', "question": ' || CAST(to_json(question) AS VARCHAR) || '}')) AS id, md5(question) AS question, expected FROM x""")
def data_set_rows(spark, sf_dir):
    i, n, word = F.col("item_id"), F.length("text"), lambda k: F.split_part("text", F.lit(" "), F.lit(k))
    rows = table(spark, sf_dir, "benchmark").select(
        F.when(i % 3 == 0, F.concat(F.lit("e"), i.cast("string"))).when(i % 3 == 1, "").alias("id"), F.col("text").alias("question"), F.when(n % 2 == 0, "cite_answer").otherwise("refuse_if_not_found").alias("expected_behavior"),
        F.when(n % 3 == 0, "indexed_answerability").alias("lane"), F.when(n % 5 == 0, F.concat(F.lit(" "), word(1), F.lit(" "))).alias("quarantine_reason"), F.when(n % 7 < 3, word(2)).alias("reference_answer"),
    )
    return audit.data_set_rows(rows).withColumn("question", F.md5("question"))


_RUNS = r"""runs AS (SELECT item_id, CASE item_id % 4 WHEN 3 THEN 'refuse_if_not_found' ELSE 'cite_answer' END AS b, trim(text, ' ') AS q, CASE WHEN length(text) % 6 = 0 THEN '  ' ELSE ' ' || substr(text, 1, 20) || ' ' END AS a,
  list_filter([trim(split_part(text, ' ', 1), ' '), '', trim(split_part(text, ' ', 3), ' ')], lambda c: c <> '') AS contexts, CASE WHEN item_id % 2 = 0 THEN ['k' || item_id] ELSE ['f' || item_id] END AS ids, CASE WHEN item_id % 5 = 0 THEN substr(text, 1, 5) END AS reference FROM benchmark)"""


@query(f"WITH {_RUNS} SELECT 'r' || item_id AS id, md5(q) AS user_input, trim(a, ' ') AS response, array_to_string(contexts, '|') AS contexts, ids[1] AS first_id, nullif(reference, '') AS reference, CAST(NULL AS BIGINT) AS skipped FROM runs WHERE b = 'cite_answer' AND trim(a, ' ') <> '' UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, count(*) FILTER (WHERE NOT (b = 'cite_answer' AND trim(a, ' ') <> '')) FROM runs")
def judged_rows(spark, sf_dir):
    i, text = F.col("item_id"), F.col("text")
    word = lambda k: F.split_part(text, F.lit(" "), F.lit(k))
    runs = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("r"), i.cast("string")).alias("id"), text.alias("question"), F.when(F.length(text) % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), F.substring(text, 1, 20), F.lit(" "))).alias("answer"),
        F.when(i % 4 == 3, "refuse_if_not_found").otherwise("cite_answer").alias("expected_behavior"), F.array(word(1), F.lit(" "), word(3)).alias("contexts"),
        F.when(i % 2 == 0, F.array(F.concat(F.lit("k"), i.cast("string")))).otherwise(F.array().cast("array<string>")).alias("chunk_ids"), F.array(F.concat(F.lit("f"), i.cast("string"))).alias("file_ids"), F.when(i % 5 == 0, F.substring(text, 1, 5)).alias("reference"),
    )
    x = audit.judged_rows(runs)
    return x.select("id", F.md5("user_input").alias("user_input"), "response", F.array_join("retrieved_contexts", "|").alias("contexts"), F.get("retrieved_context_ids", F.lit(0)).alias("first_id"), "reference", "skipped")


_META = """m AS (SELECT doc_id, source, lang, n_chars, CASE n_chars % 3 WHEN 0 THEN 'c' || doc_id END AS chunk_id, CASE n_chars % 2 WHEN 0 THEN '' ELSE 't' || doc_id END AS citation_id, CASE n_chars % 4 WHEN 0 THEN 'high' WHEN 1 THEN '0.5' END AS relevance, CAST(n_chars AS VARCHAR) AS keyword,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS one FROM documents)"""


@query(f"WITH {_META} SELECT source AS query_id, CAST(sum(CASE WHEN rank < 5 THEN 1 + CASE WHEN one IS NOT NULL THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS attributes, max(CASE WHEN rank = 0 THEN coalesce(chunk_id, nullif(citation_id, ''), 'f' || doc_id) END) AS first_id, "
       "max(CASE WHEN rank = 0 THEN coalesce(TRY_CAST(relevance AS DOUBLE), CAST(keyword AS DOUBLE)) END) AS first_score, max(CASE WHEN rank = 0 THEN CASE WHEN length(one) > 40 THEN rtrim(substr(one, 1, 40), ' ') || '...' ELSE one END END) AS first_content FROM (SELECT * FROM m) GROUP BY source")
def document_traces(spark, sf_dir):
    from pyspark.sql.window import Window

    n, i = F.col("n_chars"), F.col("doc_id").cast("string")
    metadata = F.create_map(F.lit("chunk_id"), F.when(n % 3 == 0, F.concat(F.lit("c"), i)), F.lit("citation_id"), F.when(n % 2 == 0, "").otherwise(F.concat(F.lit("t"), i)), F.lit("file_id"), F.concat(F.lit("f"), i), F.lit("relevance_score"), F.when(n % 4 == 0, "high").when(n % 4 == 1, "0.5"), F.lit("_keyword_score"), n.cast("string"), F.lit("internal"), F.lit("x"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), rank.alias("rank"), F.col("text").alias("content"), metadata.alias("metadata"))
    x = lineage.document_attributes(docs, 5, 40)
    at = lambda k: F.try_element_at("attributes", F.lit(f"retrieval.documents.0.document.{k}"))
    held = F.size(F.map_filter("attributes", lambda k, _: k.endswith(".id") | k.endswith(".content")))
    return x.select("query_id", held.cast("long").alias("attributes"), at("id").alias("first_id"), at("score").cast("double").alias("first_score"), at("content").alias("first_content"))


_STATE = r"""l AS (SELECT doc_id, CASE n_chars % 4 WHEN 0 THEN NULL WHEN 1 THEN 'kw' WHEN 2 THEN ' ' ELSE 'old' END AS k, CASE n_chars % 4 WHEN 0 THEN NULL ELSE 'vec' END AS v, CASE n_chars % 4 WHEN 0 THEN NULL ELSE CASE n_chars % 3 WHEN 0 THEN 'm:64' ELSE 'm:32' END END AS e, CASE n_chars % 4 WHEN 0 THEN NULL ELSE 'run' || doc_id END AS r FROM documents)"""


@query(f"WITH {_STATE} SELECT doc_id, CASE WHEN r IS NULL THEN 'unknown' WHEN k = 'old' OR e <> 'm:64' THEN 'stale' ELSE 'fresh' END AS state, CASE WHEN k = 'old' THEN 'old' ELSE 'kw' END AS keyword_index, CASE WHEN k = 'old' THEN 'kw' END AS current_keyword_index, CASE WHEN e <> 'm:64' THEN 'm:64' END AS current_model, r AS run, CASE WHEN e IS NULL THEN 64 ELSE CAST(substr(e, 3) AS INTEGER) END AS dimensions FROM l")
def index_lineage(spark, sf_dir):
    n = F.col("n_chars")
    there = lambda c: F.when(n % 4 != 0, c)
    held = {"keyword_index": F.when(n % 4 == 1, "kw").when(n % 4 == 2, " ").when(n % 4 == 3, "old"), "vector_collection": there(F.lit("vec")), "embedding_model": there(F.when(n % 3 == 0, "m:64").otherwise("m:32")), "ingest_run_id": there(F.concat(F.lit("run"), F.col("doc_id").cast("string")))}
    state = lineage.index_state(held, {"keyword_index": F.lit("kw"), "vector_collection": F.lit("vec"), "embedding_model": F.lit("m:64")})
    x = table(spark, sf_dir, "documents").select("doc_id", state.alias("s"))
    at = lambda k: F.try_element_at("s", F.lit(k))
    return x.select("doc_id", at("index_fresh").alias("state"), at("keyword_index").alias("keyword_index"), at("current_keyword_index").alias("current_keyword_index"), at("current_embedding_model").alias("current_model"), at("ingest_run_id").alias("run"), lineage.dimensions(at("embedding_model")).alias("dimensions"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(text), '-', ' '), '[\p{L}\p{N}_]+')) AS t FROM documents),
d AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 16 AS d, 1 + ln(CAST(count(*) AS DOUBLE)) AS w FROM t GROUP BY 1, 2), s AS (SELECT doc_id, round(sum(w), 6) AS total, count(*) AS used FROM d GROUP BY 1)
SELECT doc_id, total, used, CASE WHEN total IS NULL THEN 'no vector' END AS error, CASE n_chars % 3 WHEN 0 THEN '' WHEN 1 THEN 'embedding_model' ELSE 'embedding_dimensions,distance' END AS differs FROM documents LEFT JOIN s USING (doc_id)""")
def vector_index(spark, sf_dir):
    model = embedding.default_provider(16)
    n = F.col("n_chars")
    x = embedding.index_vectors(table(spark, sf_dir, "documents"), model, "doc_id", "text")
    found = {"provider": F.lit("hashed"), "embedding_model": F.when(n % 3 == 1, "older").otherwise("token-md5:16"), "embedding_dimensions": F.when(n % 3 == 2, 8).otherwise(16), "distance": F.when(n % 3 != 2, "cosine")}
    used = F.size(F.filter("embedding", lambda v: v > 0)).cast("long")
    return x.select("doc_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.when(F.col("embedding").isNotNull(), used).alias("used"), "error", F.array_join(embedding.mismatch(found, model.identity), ",").alias("differs"))


@query(r"""WITH d AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS one, source = (SELECT min(source) FROM documents) AS bare FROM documents)
SELECT '## d' || doc_id || chr(10) || chr(10) || '- status: `' || CASE WHEN bare THEN 'missing' ELSE 'ready_for_review' END || '`' || chr(10) || '- behavior: `cite_answer`' || chr(10) || '- lane: `' || lang || '`' || chr(10) || '- question: What does ' || source || ' say?' || chr(10) || '- current answer: ' || lang || chr(10) || '- reference_context_ids: `' || CASE WHEN bare THEN '' ELSE 'c' || doc_id || ', f' || doc_id END || '`' || chr(10)
  || chr(10) || '### Review Notes' || chr(10) || CASE WHEN bare THEN '- no evidence' ELSE '- none' END || chr(10) || chr(10) || '### Evidence' || chr(10) || CASE WHEN bare THEN '- none' ELSE '- `c' || doc_id || '`' || chr(10) || '  - citation: `' || source || '#' || doc_id || '`' || chr(10) || '  - source: `' || source || '/' || doc_id || '.txt`' || chr(10) || '  - text: ' || CASE WHEN length(one) > 500 THEN rtrim(substr(one, 1, 499), ' ') || '...' ELSE one END END || chr(10) AS packet FROM d""")
def packet_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bare = F.col("source") == docs.agg(F.min("source")).first()[0]
    i = F.col("doc_id").cast("string")
    named = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    chunk = F.struct(named("c", i).alias("chunk_id"), named(F.col("source"), "#", i).alias("citation_id"), named(F.col("source"), "/", i, ".txt").alias("relative_path"), F.col("text").alias("text"))
    x = docs.select(named("d", i).alias("id"), F.when(bare, "missing").otherwise("ready_for_review").alias("gold_status"), F.lit("cite_answer").alias("expected_behavior"), F.col("lang").alias("lane"), named("What does ", F.col("source"), " say?").alias("question"), F.col("lang").alias("current_reference_answer"),
                    F.when(~bare, F.array(named("c", i), named("f", i))).alias("current_reference_context_ids"), F.when(bare, F.array(F.lit("no evidence"))).alias("review_notes"), F.when(~bare, F.array(chunk)).alias("evidence"))
    return x.select(audit.packet_report().alias("packet"))


@query(r"""WITH d AS (SELECT *, split_part(text, ' ', 2) AS w FROM documents), m AS (SELECT doc_id, lower(source || '.txt' || chr(10) || lang || '/' || source) AS hay, lower(trim(regexp_replace(CASE n_chars % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' || upper(lang) || ' ' ELSE w END, '\s+', ' ', 'g'), ' ')) AS q, row_number() OVER (ORDER BY n_chars, source || doc_id) - 1 AS place, n_chars FROM d)
SELECT doc_id, q = '' OR contains(hay, q) AS found, sha256(q) AS token FROM m""")
def group_search(spark, sf_dir):
    n = F.col("n_chars")
    asked = F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("  "), F.upper("lang"), F.lit(" "))).otherwise(F.split_part("text", F.lit(" "), F.lit(2)))
    groups = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit(".txt")).alias("file_name"), F.concat("lang", F.lit("/"), "source").alias("display_path"), asked.alias("asked"))
    hit = lineage.matching_groups(groups, F.col("asked")).select(F.col("doc_id").alias("hit"))
    wanted = F.lower(F.trim(F.regexp_replace("asked", r"\s+", " ")))
    return groups.join(hit, groups.doc_id == hit.hit, "left").select("doc_id", F.col("hit").isNotNull().alias("found"), lineage.session_token_hash(wanted).alias("token"))


@query(r"""SELECT c_custkey AS email, row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS place FROM customer WHERE c_acctbal < 0""")
def pending_users(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("email"), F.col("c_nationkey").alias("created"), F.when(F.col("c_acctbal") < 0, "pending").otherwise("approved").alias("status"))
    return lineage.pending_users(users).select("email", "place")


QUERIES, ORACLES = query.queries, query.oracles
