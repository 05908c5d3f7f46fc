"""Queries of the evaluation operators. Gold documents of a question hold its item's first 80 characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text
from quillmere.operators import metrics as ops
from quillmere.operators import retrieval as search
from quillmere.operators.ranks import staged
from quillmere.plans.base import QUESTIONS, Part, sql
from quillmere.plans.retrieval import EXACT, FALLBACK, INDEX, NEAREST, SCORES, SETS, index
from quillmere.sources.tables import questions, table

query = Part()
HINTS_AT_ONCE = 1000
SHORT_AT_ONCE = 1000
HITS = ", ".join([QUESTIONS, INDEX, SETS, EXACT, SCORES])
GOLD = r"gold AS (SELECT query_id, doc_id FROM questions JOIN documents ON contains(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), gold_start))"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search.keyword_search(index(table(spark, sf_dir, "documents")), questions(table(spark, sf_dir, "benchmark")))
    return hits.select("query_id", F.col("doc_id").alias("id"), F.col("keyword_rank").alias("rank"))


def gold(spark: SparkSession, sf_dir: str, words: int = 4) -> DataFrame:
    """(query_id, id): documents that hold the beginning of an item. Candidates share a run of four words, so not all pairs are tried.

    Texts are read once: a task looks the runs up in its texts and tests those that have one. Items of fewer than six words in
    their beginning have no such run of whole words; blocks of them are looked for in every document.
    """
    asked = questions(table(spark, sf_dir, "benchmark")).select("query_id", "gold_start")
    # the first and the last word of a cut text may be cut themselves
    long = F.size(F.split("gold_start", " ")) >= words + 2
    first = asked.where(long)
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = texts.select("doc_id", text.collapse(F.col("text")).alias("t"))
    out = ops.holding(texts, first, words) if _small(first) else _joined(docs, first, words)
    short = asked.where(~long)
    blocks = -(-short.count() // SHORT_AT_ONCE)
    for k in range(blocks):
        some = F.broadcast(short.where(F.pmod(F.xxhash64("query_id", "gold_start"), F.lit(blocks)) == k))
        out = out.union(docs.join(some, F.contains("t", F.col("gold_start"))).select("query_id", F.col("doc_id").alias("id")))
    return staged(out, "gold")


def _joined(docs: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(query_id, id) of more items than a task should know: the runs of all documents (doc_id, t) meet theirs in a shuffle."""
    grams = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - words, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice(c, i + 1, words), " ")))
    first = asked.withColumn("key", F.get(grams(F.split("gold_start", " ")), F.lit(1)))
    parted = docs.select("doc_id", F.explode(F.array(F.split("t", " "))).alias("ws"))  # exploded so that the words are split once, not for each run
    keys = parted.select("doc_id", F.explode(F.array_distinct(grams(F.col("ws")))).alias("key"))
    near = staged(keys.join(first, "key").select("query_id", "gold_start", "doc_id").distinct(), "near")
    return near.join(docs, "doc_id").where(F.contains("t", F.col("gold_start"))).select("query_id", F.col("doc_id").alias("id"))


def _small(x: DataFrame, most: int = 50_000) -> bool:
    """Whether x has few enough rows to be sent to every task; beyond that the join shuffles."""
    return x.limit(most + 1).count() <= most


@query(sql(QUESTIONS, GOLD, select="SELECT query_id, doc_id AS id FROM gold"))
def gold_documents(spark, sf_dir):
    return gold(spark, sf_dir)


def _id_sql(k: int) -> str:
    return "WITH " + HITS + ", " + GOLD + f""", n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id),
m AS (SELECT h.query_id, count(*) AS found, min(keyword_rank) AS r, sum(1 / log2(keyword_rank + 2)) AS dcg FROM hits h JOIN gold g ON g.query_id = h.query_id AND g.doc_id = h.doc_id WHERE keyword_rank < {k} GROUP BY h.query_id)
SELECT query_id, coalesce(found, 0) > 0 AS hit, round(coalesce(found / {k}, 0), 9) AS precision, round(coalesce(found / n, 0), 9) AS recall, round(coalesce(1 / (r + 1), 0), 9) AS mrr,
  round(coalesce(dcg / list_sum([1 / log2(i + 2) FOR i IN range(0, least(n, {k}))]), 0), 9) AS ndcg FROM n LEFT JOIN m USING (query_id)"""


def _rounded(x: DataFrame) -> DataFrame:
    return x.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in x.dtypes])


@query(_id_sql(5))
def retrieval_metrics_at_5(spark, sf_dir):
    return _rounded(ops.id_metrics(_ranked(spark, sf_dir), gold(spark, sf_dir), 5))


@query(_id_sql(10))
def chunk_recall_at_10(spark, sf_dir):
    return _rounded(ops.id_metrics(_ranked(spark, sf_dir), gold(spark, sf_dir), 10))


@query("WITH " + NEAREST + """, g AS (SELECT r.query_id, vector_rank, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS score FROM ranked r JOIN embeddings a ON a.vec_id = r.query_id JOIN embeddings b ON b.vec_id = r.vec_id WHERE vector_rank < 20),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_rank) - 1 AS best FROM g)
SELECT query_id, coalesce(sum(score) FILTER (WHERE vector_rank < 5), 0) > 0 AS hit, round(sum(score) FILTER (WHERE vector_rank < 5) / 5, 9) AS precision,
  round(coalesce(sum(score / log2(vector_rank + 2)) FILTER (WHERE vector_rank < 5) / nullif(sum(score / log2(best + 2)) FILTER (WHERE best < 5), 0), 0), 9) AS ndcg FROM b GROUP BY query_id""")
def relevance_metrics(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    label = v.select("vec_id", "label")
    x = search.cosine_topk(v, v.where("vec_id % 20 = 0"), 20).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")
    return _rounded(ops.own_ideal_ndcg(x.select("query_id", F.col("vector_rank").alias("rank"), (F.col("label") == F.col("wanted")).cast("int").alias("score")), 5))


BEHAVIOUR = "CASE doc_id % 3 WHEN 0 THEN 'cite_answer' WHEN 1 THEN 'refuse_if_not_found' ELSE 'surface_conflict' END"
JUDGED = f"""rows AS (SELECT l.doc_id, {BEHAVIOUR} AS behaviour, d.source AS lane, [d.lang, 'q' || quality] AS tags, quality, toxic, n_chars, length(text) % 7 AS a, length(text) % 11 AS b, length(text) % 100 / 100.0::DOUBLE AS s FROM labels l JOIN documents d USING (doc_id)),
verdicts AS (SELECT *, CASE behaviour WHEN 'refuse_if_not_found' THEN a = 0 AND NOT (b > 1) WHEN 'cite_answer' THEN b > 1 AND NOT (a = 0) ELSE b > 1 AND a > 1 END AS citation, CASE WHEN behaviour = 'surface_conflict' THEN b > 3 END AS conflict, CASE WHEN a <> 5 THEN quality = 1 END AS id_hit, toxic = 0 AS grounded FROM rows),
classed AS (SELECT *, CASE WHEN behaviour = 'refuse_if_not_found' AND citation IS NOT TRUE THEN 'bad_refusal' WHEN behaviour = 'surface_conflict' AND citation IS NOT TRUE THEN 'bad_conflict_handling' WHEN behaviour = 'cite_answer' AND citation IS NOT TRUE THEN 'missing_citation'
  WHEN behaviour = 'surface_conflict' AND conflict IS FALSE THEN 'bad_conflict_handling' WHEN id_hit IS FALSE THEN 'retrieval_miss' WHEN grounded IS FALSE THEN 'ungrounded_citation' WHEN s < 0.5 THEN 'ungrounded_answer' END AS failure_class FROM verdicts)"""


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    n = F.length("text")
    a, b, s = n % 7, n % 11, (n % 100) / F.lit(100.0)
    behaviour = F.when(F.col("doc_id") % 3 == 0, "cite_answer").when(F.col("doc_id") % 3 == 1, "refuse_if_not_found").otherwise("surface_conflict")
    none = F.lit(None)
    c = {"citation": ops.citation_verdict(behaviour, a == 0, b > 1, a > 1), "conflict": F.when(behaviour == "surface_conflict", b > 3), "id_hit": F.when(a != 5, F.col("quality") == 1), "hint_hit": none.cast("boolean"), "grounded": F.col("toxic") == 0, "hinted": none.cast("boolean"), "faithfulness": s, "relevancy": none.cast("double"), "correctness": none.cast("double")}
    return x.select("doc_id", F.col("source").alias("lane"), F.array("lang", F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("tags"), ops.failure_class(behaviour, c).alias("failure_class"))


@query(sql(JUDGED, select="SELECT doc_id, lane, failure_class FROM classed"))
def failure_classes(spark, sf_dir):
    return _classed(spark, sf_dir).select("doc_id", "lane", "failure_class")


@query(sql(JUDGED, "flat AS (SELECT 'overall' AS dimension, 'all' AS value, failure_class AS f FROM classed UNION ALL SELECT 'lane', lane, failure_class FROM classed UNION ALL SELECT 'tags', unnest(tags), failure_class FROM classed)", select="SELECT dimension, value, count(*) AS total, count(*) FILTER (WHERE f IS NULL) AS passed, count(*) FILTER (WHERE f IS NOT NULL) AS failed, round(count(*) FILTER (WHERE f IS NULL) / count(*), 4) AS pass_rate FROM flat GROUP BY dimension, value"))
def pass_rates(spark, sf_dir):
    return ops.pass_rates(_classed(spark, sf_dir))


@query("""WITH j AS (SELECT quality = 1 AS h, CASE WHEN doc_id % 29 <> 0 THEN least(n_chars / 1000.0::DOUBLE, 1) END AS s FROM labels JOIN documents USING (doc_id)), c AS (SELECT h, s, coalesce(s >= 0.5, false) AS p FROM j),
t AS (SELECT count(*) FILTER (WHERE h AND p) AS tp, count(*) FILTER (WHERE NOT h AND NOT p) AS tn, count(*) FILTER (WHERE NOT h AND p) AS fp, count(*) FILTER (WHERE h AND NOT p) AS fn, avg(s) FILTER (WHERE h) - avg(s) FILTER (WHERE NOT h) AS separation FROM c)
SELECT tp, tn, fp, fn, round((tp + tn) / n, 9) AS accuracy, round(tp / (tp + fn), 9) AS tpr, round(tn / (tn + fp), 9) AS tnr, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy,
  round(((tp + tn) / n - e) / (1 - e), 9) AS kappa, round(separation, 9) AS separation FROM (SELECT *, tp + tn + fp + fn AS n, ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn)) AS e FROM t)""")
def judge_calibration(spark, sf_dir):
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    score = F.when(F.col("doc_id") % 29 != 0, F.least(F.col("n_chars") / F.lit(1000.0), F.lit(1.0)))
    return _rounded(ops.calibration(x.select((F.col("quality") == 1).alias("human"), score.alias("score"))))


@query("""WITH r AS (SELECT doc_id AS line, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE 'q' || (doc_id // 2) END AS id, CASE WHEN doc_id % 17 <> 0 THEN source END AS suite, CASE doc_id % 5 WHEN 0 THEN 'cite_answer' WHEN 1 THEN 'refuse_if_not_found' WHEN 2 THEN 'surface_conflict' WHEN 3 THEN 'other' END AS b,
  CASE doc_id % 4 WHEN 0 THEN 'indexed_answerability' WHEN 1 THEN 'conflict_version_behavior' WHEN 2 THEN 'nowhere' ELSE '' END AS lane, text FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY trim(id) ORDER BY line) > 1 AS again FROM r)
SELECT line, 'missing id' AS message FROM d WHERE trim(id) = '' UNION ALL SELECT line, 'duplicate id' FROM d WHERE trim(id) <> '' AND again UNION ALL SELECT line, 'missing suite' FROM d WHERE suite IS NULL UNION ALL SELECT line, 'missing question' FROM d WHERE trim(coalesce(text, '')) = ''
UNION ALL SELECT line, 'invalid expected_behavior' FROM d WHERE b IS NULL OR b = 'other' UNION ALL SELECT line, 'missing lane' FROM d WHERE lane = '' UNION ALL SELECT line, 'invalid lane' FROM d WHERE lane = 'nowhere'
UNION ALL SELECT line, 'lane is not valid for expected_behavior' FROM d WHERE (b = 'cite_answer' AND lane = 'conflict_version_behavior') OR (b = 'refuse_if_not_found' AND lane IN ('indexed_answerability', 'conflict_version_behavior')) OR (b = 'surface_conflict' AND lane = 'indexed_answerability')
UNION ALL SELECT line, 'missing reference_answer' FROM d WHERE line % 3 = 0 UNION ALL SELECT line, 'tags must be a list of non-empty strings' FROM d WHERE line % 19 = 0""")
def question_contract(spark, sf_dir):
    d = F.col("doc_id")
    x = table(spark, sf_dir, "documents").select(d.alias("line"), F.when(d % 13 == 0, " ").otherwise(F.concat(F.lit("q"), F.floor(d / 2).cast("string"))).alias("id"), F.when(d % 17 != 0, F.col("source")).alias("suite"), F.col("text").alias("question"), F.when(d % 5 == 0, "cite_answer").when(d % 5 == 1, "refuse_if_not_found").when(d % 5 == 2, "surface_conflict").when(d % 5 == 3, "other").alias("expected_behavior"), F.when(d % 4 == 0, "indexed_answerability").when(d % 4 == 1, "conflict_version_behavior").when(d % 4 == 2, "nowhere").otherwise("").alias("lane"), F.when(d % 3 != 0, "an answer").alias("reference_answer"), F.array(F.lit("tag"), F.when(d % 19 == 0, " ").otherwise("x")).alias("tags"))
    return ops.question_errors(x)


AUDIT = """a AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'indexed_answerability' WHEN 1 THEN 'conflict_version_behavior' ELSE 'refusal_out_of_corpus_behavior' END AS lane, n_chars % 3 AS cur, n_chars % 4 AS res, CASE WHEN n_chars % 5 = 0 THEN 1 ELSE 0 END AS fo, CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END AS un, n_chars % 2 AS cand, n_chars % 11 < 6 AS has,
  CASE WHEN n_chars % 11 < 6 THEN n_chars % 3 END AS src, CASE WHEN doc_id % 31 = 0 THEN 'frozen' ELSE '' END AS qu FROM documents),
h AS (SELECT *, CASE WHEN doc_id % 6 = 5 THEN 'not_required' WHEN coalesce(src, 0) > res THEN 'source_path_only' WHEN res > 0 THEN 'hit' WHEN cand > 0 THEN 'candidate_only' WHEN src IS NOT NULL THEN 'source_path_only' ELSE 'missing' END AS q, CASE WHEN doc_id % 23 = 0 THEN 'generic_meta_reference' ELSE 'evidence_shaped' END AS ans FROM a)"""


@query(sql(AUDIT, select="""SELECT doc_id, q AS hints, CASE WHEN lane = 'refusal_out_of_corpus_behavior' THEN 'out_of_corpus' WHEN fo > 0 THEN 'file_only_gold_ids' WHEN un > 0 THEN 'unresolved_gold_ids' WHEN cur > 0 AND q = 'hit' THEN 'indexed' WHEN has AND q = 'source_path_only' THEN 'source_exists_not_indexed' WHEN cand > 0 THEN 'candidate_indexed' WHEN cur = 0 THEN 'missing_gold_ids' ELSE 'indexed' END AS indexed_status,
  x.action AS action, x.reason AS reason, x.backlog AS backlog FROM (SELECT *, CASE WHEN qu <> '' THEN {'action': 'quarantine', 'reason': qu, 'backlog': 'row_contract'} WHEN lane = 'refusal_out_of_corpus_behavior' AND cur = 0 THEN {'action': 'keep', 'reason': '', 'backlog': 'none'}
  WHEN fo > 0 THEN {'action': 'rewrite', 'reason': 'file_only_reference_context_ids', 'backlog': 'chunk_id_migration'} WHEN un > 0 THEN {'action': 'needs_ingestion', 'reason': 'unresolved_reference_context_ids', 'backlog': 'missing_indexed_source'}
  WHEN cur > 0 AND q IN ('source_path_only', 'missing') THEN CASE WHEN has THEN {'action': 'needs_ingestion', 'reason': 'gold_ids_do_not_match_hints', 'backlog': 'missing_indexed_source'} ELSE {'action': 'quarantine', 'reason': 'gold_ids_do_not_match_hints', 'backlog': 'row_contract'} END
  WHEN lane = 'conflict_version_behavior' AND res < 2 THEN CASE WHEN cand > 0 THEN {'action': 'rewrite', 'reason': '', 'backlog': 'gold_id_backfill'} WHEN has THEN {'action': 'needs_ingestion', 'reason': 'missing_conflict_gold_ids', 'backlog': 'missing_indexed_source'} ELSE {'action': 'quarantine', 'reason': 'missing_conflict_gold_ids', 'backlog': 'row_contract'} END
  WHEN lane = 'indexed_answerability' AND res = 0 THEN CASE WHEN cand > 0 THEN {'action': 'rewrite', 'reason': '', 'backlog': 'gold_id_backfill'} WHEN has THEN {'action': 'needs_ingestion', 'reason': 'missing_gold_id_for_existing_source', 'backlog': 'missing_indexed_source'} ELSE {'action': 'quarantine', 'reason': 'missing_gold_id', 'backlog': 'row_contract'} END
  WHEN ans = 'generic_meta_reference' THEN {'action': 'rewrite', 'reason': '', 'backlog': 'answer_key_rewrite'} ELSE {'action': 'keep', 'reason': '', 'backlog': 'none'} END AS x FROM h)"""))
def audit_rows(spark, sf_dir):
    d, n = F.col("doc_id"), F.col("n_chars")
    lane = F.when(d % 3 == 0, "indexed_answerability").when(d % 3 == 1, "conflict_version_behavior").otherwise("refusal_out_of_corpus_behavior")
    cur, res, cand, has = n % 3, n % 4, n % 2, n % 11 < 6
    fo, un = (n % 5 == 0).cast("int"), (n % 7 == 0).cast("int")
    hints = F.when(d % 6 == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    q = ops.hints_quality(hints, res, F.when(has, n % 3), cand)
    ans = ops.answer_quality(F.when(d % 23 == 0, "Ответ должен назвать срок").otherwise("three days"))
    x = table(spark, sf_dir, "documents").select("doc_id", q.alias("hints"), ops.indexed_status(lane, cur, fo, un, cand, q, has).alias("indexed_status"), ops.row_action(lane, cur, res, fo, un, cand, has, ans, q, F.when(d % 31 == 0, "frozen").otherwise("")).alias("x"))
    return x.select("doc_id", "hints", "indexed_status", "x.action", "x.reason", "x.backlog")


@query(r"""WITH h AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')[1:3] AS hints FROM benchmark),
s AS (SELECT item_id, doc_id, len(list_filter(hints, lambda x: contains(lower(text), x))) AS score FROM h, documents), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0)
SELECT item_id, doc_id, CAST(score AS INTEGER) AS score, k - 1 AS rank FROM r WHERE k <= 8""")
def hint_candidates(spark, sf_dir):
    """Top eight documents by hints held. The hints are a stated query set, sent to the tasks in blocks; a task keeps eight documents an item."""
    from pyspark.sql.window import Window

    h = table(spark, sf_dir, "benchmark").select("item_id", F.slice(F.regexp_extract_all(F.lower("text"), F.lit(text.WORD), F.lit(0)), 1, 3).alias("hints"))
    hay = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    passes = max(1, -(-h.count() // HINTS_AT_ONCE))
    x = spark.createDataFrame([], "item_id long, doc_id long, score int")
    for p in range(passes):
        rows = h.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()  # one block of the query set
        x = x.union(search.most_hints(hay, [(r[0], r[1] or []) for r in rows], 8))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")) - 1
    return x.withColumn("rank", rank).where("rank < 8").select("item_id", "doc_id", "score", "rank")


@query(r"""WITH a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'No indexed evidence was enough to answer.' WHEN 1 THEN 'First claim [S1].' || chr(10) || 'Second claim [S2].' WHEN 2 THEN '## Head' || chr(10) || 'A claim without' WHEN 3 THEN 'A claim [S9].' ELSE '**Terms:**' || chr(10) || 'Said [S1] [see note]' END AS answer FROM documents)
SELECT doc_id, doc_id % 5 IN (0, 1, 4) AS valid, CASE WHEN doc_id % 5 = 3 THEN 'S9' ELSE '' END AS invalid FROM a""")
def citation_validation(spark, sf_dir):
    d = F.col("doc_id")
    answer = F.when(d % 5 == 0, "No indexed evidence was enough to answer.").when(d % 5 == 1, "First claim [S1].\nSecond claim [S2].").when(d % 5 == 2, "## Head\nA claim without").when(d % 5 == 3, "A claim [S9].").otherwise("**Terms:**\nSaid [S1] [see note]")
    x = table(spark, sf_dir, "documents").select("doc_id", text.citation_check(answer, F.array(F.lit("[S1] text"), F.lit("[S2] table"))).alias("c"))
    return x.select("doc_id", "c.valid", F.array_join("c.invalid", ",").alias("invalid"))


QUERIES, ORACLES = query.queries, query.oracles
