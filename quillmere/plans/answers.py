"""Queries of the answer operators and of the remaining functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.functions import more, text
from quillmere.operators import answers as ops
from quillmere.operators import metrics, runs
from quillmere.operators import retrieval as search
from quillmere.plans.base import FILES, QUESTIONS, Part, sql
from quillmere.plans.retrieval import EXACT, INDEX, SCORES, SETS, index
from quillmere.sources.tables import files, questions, table

query = Part()
HITS = ", ".join([QUESTIONS, INDEX, SETS, EXACT, SCORES])


def _hits(spark, sf_dir):
    docs, asked = table(spark, sf_dir, "documents"), questions(table(spark, sf_dir, "benchmark"))
    return asked, search.keyword_search(index(docs), asked).where("keyword_rank < 10").join(docs, "doc_id")


@query("WITH " + HITS + r""", e AS (SELECT query_id, keyword_rank AS r, text FROM hits h JOIN documents d ON d.doc_id = h.doc_id WHERE keyword_rank < 10), f AS (SELECT query_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS c FROM e WHERE r = 0), n AS (SELECT query_id, count(*) AS n FROM e GROUP BY query_id)
SELECT query_id, CASE WHEN n IS NULL THEN 'No indexed evidence was enough to answer.' ELSE CASE WHEN length(c) > 200 THEN rtrim(substr(c, 1, 200), ' ') || '...' ELSE c END || ' [S1]' END AS answer, CASE WHEN n IS NULL THEN 'no_relevant_documents' ELSE 'answered' END AS status, coalesce(n, 0) AS n_citations FROM questions LEFT JOIN n USING (query_id) LEFT JOIN f USING (query_id)""")
def answers(spark, sf_dir):
    asked, hits = _hits(spark, sf_dir)
    x = ops.answer(asked, hits.select("query_id", F.col("keyword_rank").alias("final_rank"), F.lit("text").alias("source_type"), "text"))
    return x.select("query_id", "answer", "status", F.size("citations").cast("long").alias("n_citations"))


@query("WITH " + HITS + """, e AS (SELECT query_id, source AS path, keyword_rank AS rank, round(keyword_score, 6) AS score FROM hits h JOIN documents d ON d.doc_id = h.doc_id WHERE keyword_rank < 10)
SELECT query_id, path, count(*) AS chunks, max(score) AS best_score, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), path) - 1 AS group_rank FROM e GROUP BY query_id, path""")
def evidence_file_groups(spark, sf_dir):
    _, hits = _hits(spark, sf_dir)
    return ops.file_groups(hits.select("query_id", F.col("source").alias("path"), F.col("keyword_rank").alias("rank"), F.round("keyword_score", 6).alias("score")))


GROUND = """g AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'cite_answer' WHEN 1 THEN 'refuse_if_not_found' ELSE 'surface_conflict' END AS b, CASE WHEN doc_id % 5 = 4 THEN [] WHEN doc_id % 5 = 3 THEN ['[S1] ' || source, 'zz'] ELSE ['[S1] ' || source] END AS cs, source, lang,
  CASE WHEN doc_id % 4 = 0 THEN [] WHEN doc_id % 4 = 1 THEN ['d' || doc_id] WHEN doc_id % 4 = 2 THEN ['d' || doc_id, 'e' || doc_id] ELSE ['other'] END AS gold FROM documents),
r AS (SELECT *, CASE WHEN len(cs) = 0 THEN CASE WHEN b IN ('cite_answer', 'surface_conflict') THEN false END ELSE len(cs) = 1 AND (len(gold) = 0 OR gold[1] <> 'other') END AS grounded, CASE WHEN len(cs) = 0 THEN [] ELSE ['d' || doc_id, 'e' || doc_id] END AS ids FROM g)"""


@query(sql(GROUND, select="""SELECT doc_id, grounded, array_to_string(ids, ',') AS cited, CASE WHEN b = 'surface_conflict' THEN doc_id % 7 <> 0 AND NOT doc_id % 11 = 0 AND coalesce(grounded, false) AND len(list_intersect(ids, gold)) >= CASE WHEN len(gold) > 0 THEN least(2, len(gold)) ELSE 2 END END AS conflict FROM r"""))
def citation_grounding(spark, sf_dir):
    d, none = F.col("doc_id"), F.array().cast("array<string>")
    name = lambda p: F.concat(F.lit(p), d.cast("string"))
    cite = F.concat(F.lit("[S1] "), "source")
    cites = F.when(d % 5 == 4, none).when(d % 5 == 3, F.array(cite, F.lit("zz"))).otherwise(F.array(cite))
    gold = F.when(d % 4 == 0, none).when(d % 4 == 1, F.array(name("d"))).when(d % 4 == 2, F.array(name("d"), name("e"))).otherwise(F.array(F.lit("other")))
    held = F.array(F.struct(name("d").alias("id"), F.array("source").alias("names")), F.struct(name("e").alias("id"), F.array(F.lit("en"), F.concat("source", F.lit("] x")), F.col("source")).alias("names")))
    b = F.when(d % 3 == 0, "cite_answer").when(d % 3 == 1, "refuse_if_not_found").otherwise("surface_conflict")
    x = ops.grounding(table(spark, sf_dir, "documents").select("doc_id", cites.alias("citations"), held.alias("documents"), gold.alias("gold"), b.alias("expected_behavior")))
    conflict = ops.conflict_score(F.col("expected_behavior"), d % 7 != 0, d % 11 == 0, F.col("grounded"), F.col("cited_ids"), F.col("gold"))
    return x.select("doc_id", "grounded", F.array_join("cited_ids", ",").alias("cited"), conflict.alias("conflict"))


@query("SELECT source, count(*) AS chunk_count, first(lang ORDER BY doc_id) FILTER (WHERE lang <> 'en') AS lang, first(text ORDER BY doc_id) FILTER (WHERE length(text) < 80 AND trim(text, ' ') <> '') AS text FROM documents GROUP BY source")
def corpus_index(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), F.when(F.length("text") < 80, F.col("text")).alias("text"))
    return ops.first_attributes(x, "source", "doc_id", ["lang", "text"])


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'provider_mismatch' WHEN event_id % 5 = 0 THEN 'unavailable' WHEN event_id % 3 = 0 THEN 'failed' WHEN event_id % 2 > 0 THEN 'ok' ELSE 'empty' END AS v, CASE WHEN event_id % 11 = 0 THEN 'unavailable' ELSE 'ok' END AS k, CASE WHEN event_id % 4 = 0 THEN 'Model Error: 503' ELSE '' END AS f FROM events)
SELECT event_id, v AS vector_status, array_to_string(list_filter([CASE WHEN v NOT IN ('ok', 'empty') THEN 'vector_' || v END, CASE WHEN k <> 'ok' THEN 'keyword_' || k END, CASE WHEN f <> '' THEN 'fallback_model_error_503' END], lambda x: x IS NOT NULL), ',') AS tags FROM s""")
def degraded_retrieval(spark, sf_dir):
    i = F.col("event_id")
    v = ops.leg_status(i % 7 != 0, i % 5 != 0, i % 3 == 0, i % 2)
    tags = ops.degraded_tags(v, F.when(i % 11 == 0, "unavailable").otherwise("ok"), F.when(i % 4 == 0, "Model Error: 503").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", v.alias("vector_status"), F.array_join(tags, ",").alias("tags"))


@query(sql(FILES, select="SELECT f.file_id, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN doc_id % 10 = 0 THEN 7 ELSE 0 END AS chunk_count FROM files f"))
def manifest_update(spark, sf_dir):
    x = files(table(spark, sf_dir, "documents"))
    changes = x.where("doc_id % 5 = 0").select("file_id", F.lit("failed").alias("status"), F.when(F.col("doc_id") % 10 == 0, 7).alias("chunk_count"))
    return runs.updated_status(x.select("file_id", F.lit("pending").alias("status"), F.lit(0).alias("chunk_count")), changes, ["status", "chunk_count"])


@query(sql(FILES, select="SELECT file_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM files"))
def index_upsert(spark, sf_dir):
    x = files(table(spark, sf_dir, "documents"))
    return runs.upserted(x.select("file_id", F.lit("old").alias("version")), x.where("doc_id % 3 = 0").select("file_id", F.lit("new").alias("version")), "file_id")


@query(sql(FILES, select="""SELECT doc_id, inferred_category AS family, '…/' || split_part(relative_path, '/', 2) || '/' || filename AS short, split_part(relative_path, '/', 2) || '/' || filename AS below,
  substr(sha256('user' || (doc_id % 50) || '@example.net'), 1, 16) AS pseudonym, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END AS number, '{"id": ' || doc_id || ', "lang": "' || split_part(relative_path, '/', 2) || '", "none": null}' AS json FROM files"""))
def path_functions(spark, sf_dir):
    d, path = F.col("doc_id"), F.col("relative_path")
    mail = F.concat(F.lit(" User"), (d % 50).cast("string"), F.lit("@Example.net "))
    js = more.sorted_json({"lang": F.split_part(path, F.lit("/"), F.lit(2)), "id": d, "none": F.lit(None).cast("string")})
    x = files(table(spark, sf_dir, "documents"))
    return x.select("doc_id", more.source_family(path).alias("family"), more.short_path(path).alias("short"), more.relative_source_path(F.concat_ws("/", F.lit("root"), F.lit("documents"), F.substring_index(path, "/", -2))).alias("below"), more.pseudonym(mail).alias("pseudonym"), more.safe_int(F.when(d % 3 == 0, "x").otherwise(d.cast("string"))).alias("number"), js.alias("json"))


@query(r"SELECT doc_id, md5(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')), 'ß', 'ss')) AS form FROM documents")
def match_forms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(more.match_text(F.col("text"))).alias("form"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'kind' ELSE 'kind,note' END AS keys FROM events")
def redacted_fields(spark, sf_dir):
    i = F.col("event_id")
    fields = F.map_from_arrays(F.array(F.lit("kind"), F.when(i % 3 == 0, "User_Password").otherwise("note")), F.array(F.lit("a"), F.lit("b")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(more.redacted(fields))), ",").alias("keys"))


@query("WITH " + HITS + """, x AS (SELECT h.query_id, h.doc_id, keyword_rank, len(list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda t: NOT contains(lower(text), t))) = 0 AS whole FROM hits h JOIN documents d ON d.doc_id = h.doc_id JOIN questions q ON q.query_id = h.query_id)
SELECT query_id, doc_id, whole, row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, keyword_rank) - 1 AS rank FROM x QUALIFY rank < 12""")
def ranked_by_terms(spark, sf_dir):
    from pyspark.sql.window import Window

    docs, asked = table(spark, sf_dir, "documents"), questions(table(spark, sf_dir, "benchmark"))
    x = search.keyword_search(index(docs), asked).join(docs, "doc_id").join(asked.select("query_id", "question"), "query_id")
    x = x.withColumn("whole", F.forall(text.plain_tokens(F.col("question")), lambda t: F.contains(F.lower("text"), t)))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("whole"), "keyword_rank")) - 1
    return x.withColumn("rank", rank).where("rank < 12").select("query_id", "doc_id", "whole", "rank")


@query("""SELECT doc_id, lane, quality FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'given' WHEN doc_id % 3 = 0 THEN 'indexed_answerability' WHEN doc_id % 3 = 1 THEN CASE WHEN lang = 'fr' THEN 'known_missing_document_coverage' ELSE 'refusal_out_of_corpus_behavior' END ELSE 'conflict_version_behavior' END AS lane, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'generic_meta_reference' ELSE 'evidence_shaped' END AS quality FROM documents)""")
def evaluation_lanes(spark, sf_dir):
    d = F.col("doc_id")
    behaviour = F.when(d % 3 == 0, "cite_answer").when(d % 3 == 1, "refuse_if_not_found").otherwise("surface_conflict")
    lane = metrics.lane_for(F.when(d % 6 == 0, " given ").otherwise(""), behaviour, F.array(F.when(F.col("lang") == "fr", "Known_Missing_Doc").otherwise("x")))
    answer = F.when(d % 5 == 0, " ").when(d % 5 == 1, "Ответ должен ссылаться на приказ").otherwise("Три дня")
    return table(spark, sf_dir, "documents").select("doc_id", lane.alias("lane"), metrics.answer_quality(answer).alias("quality"))


QUERIES, ORACLES = query.queries, query.oracles
