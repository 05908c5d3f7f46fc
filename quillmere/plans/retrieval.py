"""Queries of the retrieval operators: every benchmark item is a question, every document a candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text
from quillmere.operators import embedding
from quillmere.operators import index as keyword_index
from quillmere.operators import retrieval as ops
from quillmere.operators.ranks import staged
from quillmere.plans.base import CONTENT, QUESTIONS, TOKENS, Part, sql
from quillmere.sources.tables import questions, shared_path, spread, table

query = Part()


def index(docs: DataFrame) -> DataFrame:
    return ops.tokenized(spread(docs, "doc_id"), {"content_text": F.col("text"), "relative_path": F.concat_ws(" ", "source", "lang")})


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(table(spark, sf_dir, "benchmark"))


INDEX = ("ts AS (SELECT doc_id, 'content_text' AS field, " + TOKENS.format("text") + " AS ts FROM documents UNION ALL SELECT doc_id, 'relative_path', " + TOKENS.format("source || ' ' || lang") + " FROM documents), "
         "postings AS (SELECT field, term, doc_id, count(*) AS tf, any_value(len) AS length FROM (SELECT doc_id, field, len(ts) AS len, unnest(ts) AS term FROM ts) GROUP BY field, term, doc_id), "
         "fields AS (SELECT field, count(*) AS n, avg(len(ts)) AS avgdl FROM ts WHERE len(ts) > 0 GROUP BY field), dfs AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term)")
SETS = "qt AS (SELECT query_id, " + CONTENT.format("question") + """ AS raw FROM questions), qs AS (SELECT query_id, list_transform(list_sort(list_transform(list_distinct(raw), lambda t: {'p': list_position(raw, t), 't': t})), lambda s: s.t) AS ts FROM qt),
drops AS (SELECT query_id, d AS o, [ts[i] FOR i IN range(1, len(ts) + 1) IF i <> d] AS s FROM (SELECT query_id, ts, unnest(range(1, len(ts) + 1)) AS d FROM qs WHERE len(ts) BETWEEN 3 AND 8)),
pairs AS (SELECT query_id, 100 + i AS o, ts[i:i+1] AS s FROM (SELECT query_id, ts, unnest(range(1, len(ts))) AS i FROM qs WHERE len(ts) >= 3)),
twos AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY -length(ts[i]), -i) AS o, [ts[i]] AS s FROM (SELECT query_id, ts, unnest([1, 2]) AS i FROM qs WHERE len(ts) = 2)),
alls AS (SELECT query_id, 0 AS o, ts AS s FROM qs WHERE len(ts) > 0 UNION ALL SELECT query_id, o, s FROM drops UNION ALL SELECT query_id, o, s FROM pairs UNION ALL SELECT query_id, o, s FROM twos),
relaxed AS (SELECT query_id, s, min(o) AS o FROM alls WHERE o > 0 GROUP BY query_id, s),
sets AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY o) AS o, s FROM relaxed UNION ALL SELECT query_id, 0, s FROM alls WHERE o = 0)"""
SCORES = """scored AS (SELECT w.query_id, w.token, p.doc_id, max(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avgdl)) * boost) AS score
  FROM wanted w JOIN postings p ON p.term = w.term JOIN dfs d ON d.field = p.field AND d.term = p.term JOIN fields f ON f.field = p.field GROUP BY 1, 2, 3),
tried AS (SELECT query_id, o, len(s) AS n, unnest(s) AS token FROM sets),
found AS (SELECT t.query_id, o, doc_id, round(sum(score), 9) AS score FROM tried t JOIN scored s ON s.query_id = t.query_id AND s.token = t.token GROUP BY t.query_id, o, doc_id HAVING count(*) = any_value(n)),
strict AS (SELECT query_id, bool_or(o = 0) AS st FROM found GROUP BY query_id),
best AS (SELECT query_id, doc_id, st, first({'o': o, 's': score} ORDER BY o, score DESC) AS b FROM found JOIN strict USING (query_id) WHERE o = 0 OR NOT st GROUP BY query_id, doc_id, st),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b.o, b.s DESC, doc_id) - 1 AS keyword_rank FROM best),
hits AS (SELECT query_id, doc_id, b.s AS keyword_score, keyword_rank, CASE WHEN st THEN 'strict' ELSE 'relaxed' END AS match_mode FROM ranked WHERE keyword_rank < 30)"""
EXACT = "wanted AS (SELECT query_id, unnest(ts) AS token, unnest(ts) AS term, 1.0 AS boost FROM qs)"
# The twin's edit distances count bytes, so letters of two bytes are replaced by capitals first.
FUZZY = """toks AS (SELECT DISTINCT unnest(ts) AS token FROM qs), vocab AS (SELECT DISTINCT term FROM postings),
near AS (SELECT token, term, CASE WHEN levenshtein(a, b) = 2 AND damerau_levenshtein(a, b) = 1 THEN 1 ELSE levenshtein(a, b) END AS d, CASE WHEN length(token) <= 2 THEN 0 WHEN length(token) <= 5 THEN 1 ELSE 2 END AS allowed
  FROM (SELECT token, translate(token, 'éèêçóíñäöüßáúàâîôûù', 'ABCDEFGHIJKLMNOPQRS') AS a FROM toks) JOIN (SELECT term, translate(term, 'éèêçóíñäöüßáúàâîôûù', 'ABCDEFGHIJKLMNOPQRS') AS b FROM vocab) ON substr(token, 1, 1) = substr(term, 1, 1) AND abs(length(token) - length(term)) <= 2),
kept AS (SELECT token, term, d FROM near WHERE d <= allowed QUALIFY row_number() OVER (PARTITION BY token ORDER BY d, term) <= 26),
wanted AS (SELECT query_id, token, term, 1.0 / (1 + d) AS boost FROM (SELECT query_id, unnest(ts) AS token FROM qs) JOIN kept USING (token))"""


@query(sql(QUESTIONS, select="SELECT * FROM questions"))
def question_set(spark, sf_dir):
    return _asked(spark, sf_dir)


@query("WITH " + INDEX + " SELECT field, term, df, CAST(sum(tf) AS BIGINT) AS total FROM dfs JOIN postings USING (field, term) GROUP BY field, term, df")
def inverted_index(spark, sf_dir):
    x = ops.postings(index(table(spark, sf_dir, "documents")))
    return x.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


@query("WITH " + INDEX + " SELECT field, n, round(avgdl, 6) AS avgdl FROM fields")
def field_statistics(spark, sf_dir):
    return ops.statistics(index(table(spark, sf_dir, "documents"))).select("field", "n", F.round("avgdl", 6).alias("avgdl"))


@query("WITH " + QUESTIONS + ", " + SETS + " SELECT query_id, CAST(o AS INTEGER) AS attempt, array_to_string(s, ' ') AS tokens FROM sets WHERE o > 0")
def relaxed_token_sets(spark, sf_dir):
    ts = F.array_distinct(text.content_tokens(F.col("question")))
    return _asked(spark, sf_dir).select("query_id", F.posexplode(text.relaxed_sets(ts)).alias("p", "s")).select("query_id", (F.col("p") + 1).alias("attempt"), F.array_join("s", " ").alias("tokens"))


@query("WITH " + QUESTIONS + ", " + INDEX + ", " + SETS + ", " + EXACT + ", " + SCORES + " SELECT query_id, doc_id, round(keyword_score, 6) AS keyword_score, keyword_rank, match_mode FROM hits")
def keyword_search(spark, sf_dir):
    x = ops.keyword_search(index(table(spark, sf_dir, "documents")), _asked(spark, sf_dir))
    return x.withColumn("keyword_score", F.round("keyword_score", 6))


@query("WITH " + QUESTIONS + ", " + INDEX + ", " + SETS + ", " + EXACT + ", " + SCORES + " SELECT query_id, doc_id, round(keyword_score, 6) AS keyword_score, keyword_rank, match_mode, TRUE AS fewer FROM hits")
def indexed_search(spark, sf_dir):
    """The same rows from an index that is built once and read in blocks; `fewer` says that no question read more blocks than it had."""
    root = shared_path(spark, "index")
    keyword_index.build(index(table(spark, sf_dir, "documents")), root)
    hits, effort = keyword_index.search(spark, root, _asked(spark, sf_dir))
    fewer = effort.select("query_id", (F.col("read") <= F.col("blocks")).alias("fewer"))
    return hits.join(fewer, "query_id").withColumn("keyword_score", F.round("keyword_score", 6))


@query("WITH " + QUESTIONS + ", " + INDEX + ", " + SETS + ", " + FUZZY + ", " + SCORES + " SELECT query_id, doc_id, round(keyword_score, 6) AS keyword_score, keyword_rank, match_mode FROM hits")
def keyword_search_fuzzy(spark, sf_dir):
    x = ops.keyword_search(index(table(spark, sf_dir, "documents")), _asked(spark, sf_dir), fuzzy=True)
    return x.withColumn("keyword_score", F.round("keyword_score", 6))


NEAREST = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT query_id, vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS cosine FROM q, v WHERE query_id <> vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) - 1 AS vector_rank FROM near)"""


@query("WITH " + NEAREST + " SELECT query_id, vec_id, round(cosine, 6) AS cosine, vector_rank FROM ranked WHERE vector_rank < 70")
def vector_search(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return ops.cosine_topk(v, v.where("vec_id % 20 = 0"), 70).withColumn("cosine", F.round("cosine", 6))


@query()
def vector_mmr(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return ops.mmr(ops.cosine_topk(v, v.where("vec_id % 20 = 0"), 70), v, 70)


def vectors(docs: DataFrame) -> DataFrame:
    """(vec_id, embedding) of documents under the default embedding model, from the tokens that `index` gives."""
    return embedding.default_provider().embed(docs.where("field = 'content_text'"), "doc_id", "ts").withColumnRenamed("doc_id", "vec_id")


def _embedded(spark: SparkSession, sf_dir: str, tokens: DataFrame | None = None) -> DataFrame:
    """The vector leg: the nearest documents of each question under the default embedding model."""
    model = embedding.default_provider()
    docs = vectors(tokens) if tokens else model.embed(spread(table(spark, sf_dir, "documents"), "doc_id"), "doc_id", "text").withColumnRenamed("doc_id", "vec_id")
    asked = model.embed(_asked(spark, sf_dir), "query_id", "question").withColumnRenamed("query_id", "vec_id")
    return staged(ops.cosine_topk(docs, asked, 70, same=False), "nearest")


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both legs of every question over documents: vectors, and keywords with all tokens. Tokens are made once and written for both."""
    docs = table(spark, sf_dir, "documents")
    tokens = staged(index(docs), "tokens")
    keyword = ops.keyword_search(tokens, _asked(spark, sf_dir))
    vector = _embedded(spark, sf_dir, tokens)
    legs = vector.select("query_id", F.col("vec_id").alias("doc_id"), F.lit("vector").alias("source"), F.col("vector_rank").alias("rank")).unionByName(keyword.select("query_id", "doc_id", F.lit("keyword").alias("source"), F.col("keyword_rank").alias("rank")))
    found = legs.join(docs.select("doc_id", "text"), "doc_id").withColumn("content_key", F.md5(text.content_key(F.col("text")))).drop("text")
    return found.withColumn("document_key", F.col("doc_id").cast("string"))


# A text's tokens are dealt to 64 dimensions by their md5.
EMBEDDED = ("toks AS (SELECT 'd' AS kind, doc_id AS id, unnest(" + TOKENS.format("text") + ") AS t FROM documents UNION ALL SELECT 'q', query_id, unnest(" + TOKENS.format("question") + ") FROM questions), "
            "dims AS (SELECT kind, id, CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % 64 AS d, 1 + ln(CAST(count(*) AS DOUBLE)) AS w FROM toks GROUP BY 1, 2, 3), norms AS (SELECT kind, id, sqrt(sum(w * w)) AS n FROM dims GROUP BY 1, 2), "
            "cosines AS (SELECT q.id AS query_id, v.id AS doc_id, sum(q.w * v.w) AS p FROM dims q JOIN dims v ON v.kind = 'd' AND q.kind = 'q' AND q.d = v.d GROUP BY 1, 2), "
            "every AS (SELECT q.id AS query_id, v.id AS doc_id, round(coalesce(p, 0) / (q.n * v.n), 9) AS cosine FROM norms q JOIN norms v ON q.kind = 'q' AND v.kind = 'd' LEFT JOIN cosines c ON c.query_id = q.id AND c.doc_id = v.id), "
            "embedded AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) - 1 AS vector_rank FROM every QUALIFY vector_rank < 70)")
# Rows of one content, or of one document where it has none, join the first of them.
MERGED = (r"legs AS (SELECT query_id, doc_id, 0 AS leg, vector_rank AS rank FROM embedded UNION ALL SELECT query_id, doc_id, 1, keyword_rank FROM hits), "
          r"keyed AS (SELECT l.*, CAST(l.doc_id AS VARCHAR) AS document_key, lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'), ' ')) AS c FROM legs l JOIN documents d USING (doc_id)), "
          "placed AS (SELECT *, coalesce(md5(c), 'id' || document_key) AS grp, row_number() OVER (PARTITION BY query_id ORDER BY leg, rank, document_key) AS place FROM keyed), "
          "grouped AS (SELECT query_id, grp, min(place) AS place, arg_min(document_key, place) AS document_key, arg_min(rank, place) FILTER (WHERE leg = 0) AS vector_rank, arg_min(rank, place) FILTER (WHERE leg = 1) AS keyword_rank, "
          "CASE WHEN bool_or(leg = 0) AND bool_or(leg = 1) THEN 'keyword,vector' WHEN bool_or(leg = 0) THEN 'vector' ELSE 'keyword' END AS sources, list(document_key ORDER BY place)[2:11] AS dropped FROM placed GROUP BY query_id, grp), "
          "merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS merge_rank FROM grouped)")
BOTH = "WITH " + QUESTIONS + ", " + INDEX + ", " + SETS + ", " + EXACT + ", " + SCORES + ", " + EMBEDDED + ", " + MERGED


@query("WITH " + QUESTIONS + ", " + EMBEDDED + " SELECT query_id, doc_id, round(cosine, 6) AS cosine, vector_rank FROM embedded")
def embedded_search(spark, sf_dir):
    return _embedded(spark, sf_dir).select("query_id", F.col("vec_id").alias("doc_id"), F.round("cosine", 6).alias("cosine"), "vector_rank")


@query(BOTH + " SELECT query_id, CAST(merge_rank AS INTEGER) AS merge_rank, document_key, vector_rank, keyword_rank, sources, array_to_string(dropped, ',') AS dropped FROM merged")
def merged_candidates(spark, sf_dir):
    return ops.merge_candidates(_legs(spark, sf_dir)).withColumn("dropped", F.array_join("dropped", ","))


CANDIDATES = """c AS (SELECT query_id, vec_id, vector_rank AS merge_rank, CASE WHEN vec_id % 3 <> 0 THEN vector_rank END AS vector_rank, CASE WHEN vec_id % 4 <> 0 THEN (vector_rank * 7) % 31 END AS keyword_rank,
  CASE WHEN vec_id % 5 = 0 THEN 'draft' ELSE 'active' END AS authority_status, CASE WHEN vec_id % 2 = 0 THEN 'g' || (vec_id % 6) END AS version_group FROM ranked WHERE vector_rank < 70),
a AS (SELECT *, bool_or(authority_status = 'active') OVER (PARTITION BY query_id, version_group) AS has FROM c), s AS (SELECT * FROM a WHERE version_group IS NULL OR authority_status = 'active' OR NOT has),
p AS (SELECT *, CASE WHEN vector_rank IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, vector_rank IS NOT NULL ORDER BY vector_rank, merge_rank) END AS vp, CASE WHEN keyword_rank IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, keyword_rank IS NOT NULL ORDER BY keyword_rank, merge_rank) END AS kp FROM s),
f AS (SELECT *, coalesce(1 / (60.0::DOUBLE + vp), 0) + coalesce(1 / (60.0::DOUBLE + kp), 0) AS rrf_score FROM p),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, CASE WHEN vp IS NOT NULL THEN 0 WHEN kp IS NOT NULL THEN 1 ELSE 2 END, coalesce(vp, kp, merge_rank), merge_rank) - 1 AS fusion_rank FROM f)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    x, i, r = ops.cosine_topk(v, v.where("vec_id % 20 = 0"), 70), F.col("vec_id"), F.col("vector_rank")
    return x.select("query_id", "vec_id", r.alias("merge_rank"), F.when(i % 3 != 0, r).alias("vector_rank"), F.when(i % 4 != 0, (r * 7) % 31).alias("keyword_rank"), F.when(i % 5 == 0, "draft").otherwise("active").alias("authority_status"), F.when(i % 2 == 0, F.concat(F.lit("g"), (i % 6).cast("string"))).alias("version_group"))


@query("WITH " + NEAREST + ", " + CANDIDATES + " SELECT query_id, vec_id, round(rrf_score, 9) AS rrf_score, fusion_rank FROM fused")
def rrf_fusion(spark, sf_dir):
    return ops.fuse(ops.suppress_versions(_candidates(spark, sf_dir))).select("query_id", "vec_id", F.round("rrf_score", 9).alias("rrf_score"), "fusion_rank")


@query("WITH " + NEAREST + ", " + CANDIDATES + """ SELECT query_id, count(*) AS candidates, count(*) FILTER (WHERE vp IS NOT NULL AND kp IS NOT NULL) AS hybrid, count(*) FILTER (WHERE vp IS NOT NULL AND kp IS NULL) AS vector_only, count(*) FILTER (WHERE vp IS NULL AND kp IS NOT NULL) AS keyword_only,
  round(min(rrf_score), 9) AS least, round(max(rrf_score), 9) AS most, max(fusion_rank - least(coalesce(vector_rank, 999), coalesce(keyword_rank, 999))) FILTER (WHERE vp IS NOT NULL OR kp IS NOT NULL) AS furthest_move FROM fused GROUP BY query_id""")
def fusion_diagnostics(spark, sf_dir):
    x = ops.fuse(ops.suppress_versions(_candidates(spark, sf_dir)))
    v, k = F.col("vector_rank").isNotNull(), F.col("keyword_rank").isNotNull()
    return x.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count_if(v & k).alias("hybrid"), F.count_if(v & ~k).alias("vector_only"), F.count_if(~v & k).alias("keyword_only"), F.round(F.min("rrf_score"), 9).alias("least"), F.round(F.max("rrf_score"), 9).alias("most"), F.max(F.when(v | k, F.col("fusion_rank") - F.least("vector_rank", "keyword_rank"))).cast("long").alias("furthest_move"))


HAY = "lower(text || ' ' || source || ' ' || lang)"
TERMS = "len(list_filter(toks, lambda t: contains({0}, t)))"
FALLBACK = ("joined AS (SELECT h.*, d.text, source || '/' || lang || '/' || h.doc_id || '.txt' AS path, list_filter(regexp_split_to_array(replace(lower(question), '-', ' '), '\\s+'), lambda t: t <> '') AS toks, CASE h.doc_id % 7 WHEN 0 THEN 'draft' WHEN 1 THEN 'archived' ELSE 'active' END AS status, h.doc_id % 5 AS authority FROM hits h JOIN documents d ON d.doc_id = h.doc_id JOIN questions q ON q.query_id = h.query_id), "
            "counted AS (SELECT *, " + TERMS.format("lower(text)") + " AS n, " + TERMS.format("lower(path)") + " AS m, len(toks) AS k FROM joined), "
            "final AS (SELECT query_id, doc_id, keyword_rank, 1.6::DOUBLE / (keyword_rank + 1) + least(greatest(keyword_score * 0.02::DOUBLE, -0.25), 0.25) + CASE WHEN n > 0 THEN n * 0.4::DOUBLE + CASE WHEN n = k THEN 1.2 ELSE 0 END ELSE 0 END + CASE WHEN m > 0 THEN m * 0.6::DOUBLE + CASE WHEN m = k THEN 0.9 ELSE 0 END ELSE 0 END + CASE status WHEN 'active' THEN 0.3 WHEN 'draft' THEN -0.2 ELSE -0.5 END + least(greatest(authority * 0.02::DOUBLE, -0.2), 0.4) AS score FROM counted)")


@query("WITH " + QUESTIONS + ", " + INDEX + ", " + SETS + ", " + EXACT + ", " + SCORES + ", " + FALLBACK + " SELECT query_id, doc_id, round(score, 6) AS fallback_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, keyword_rank) - 1 AS final_rank FROM final QUALIFY final_rank < 10")
def fallback_rerank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = ops.keyword_search(index(docs), _asked(spark, sf_dir))
    x = hits.join(docs, "doc_id").join(_asked(spark, sf_dir).select("query_id", "question"), "query_id")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    status = F.when(F.col("doc_id") % 7 == 0, "draft").when(F.col("doc_id") % 7 == 1, "archived").otherwise("active")
    score = ops.fallback_score(F.col("question"), F.col("text"), path, {"keyword_rank": F.col("keyword_rank"), "keyword_score": F.col("keyword_score"), "authority_status": status, "authoritative_rank": F.col("doc_id") % 5})
    return ops.top_n(x.withColumn("fallback_score", F.round(score, 6)), "fallback_score", "keyword_rank", 10, "final_rank").select("query_id", "doc_id", "fallback_score", "final_rank")


HYBRID = (BOTH + ", pv AS (SELECT *, CASE WHEN vector_rank IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, vector_rank IS NOT NULL ORDER BY vector_rank, merge_rank) END AS vp, CASE WHEN keyword_rank IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, keyword_rank IS NOT NULL ORDER BY keyword_rank, merge_rank) END AS kp FROM merged), "
          "fv AS (SELECT *, coalesce(1 / (60.0::DOUBLE + vp), 0) + coalesce(1 / (60.0::DOUBLE + kp), 0) AS rrf_score FROM pv), "
          "fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, CASE WHEN vp IS NOT NULL THEN 0 WHEN kp IS NOT NULL THEN 1 ELSE 2 END, coalesce(vp, kp, merge_rank), merge_rank) - 1 AS fusion_rank FROM fv QUALIFY fusion_rank < 100), "
          "joined AS (SELECT f.*, d.doc_id, lower(d.text) AS hay, lower(d.source || '/' || d.lang) AS path, list_filter(regexp_split_to_array(replace(lower(question), '-', ' '), '\\s+'), lambda t: t <> '') AS toks FROM fused f JOIN documents d ON d.doc_id = CAST(f.document_key AS BIGINT) JOIN questions q ON q.query_id = f.query_id), "
          "counted AS (SELECT *, " + TERMS.format("hay") + " AS n, " + TERMS.format("path") + " AS m, len(toks) AS k FROM joined), "
          "final AS (SELECT *, round(CASE WHEN vector_rank >= 0 THEN 1.0::DOUBLE / (vector_rank + 1) ELSE 0 END + CASE WHEN keyword_rank >= 0 THEN 1.6::DOUBLE / (keyword_rank + 1) ELSE 0 END + CASE WHEN n > 0 THEN n * 0.4::DOUBLE + CASE WHEN n = k THEN 1.2 ELSE 0 END ELSE 0 END + CASE WHEN m > 0 THEN m * 0.6::DOUBLE + CASE WHEN m = k THEN 0.9 ELSE 0 END ELSE 0 END + 0.3, 9) AS score FROM counted), "
          "best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fusion_rank) - 1 AS final_rank FROM final QUALIFY final_rank < 10) "
          "SELECT query_id, final_rank, doc_id, round(score, 6) AS score, round(rrf_score, 9) AS rrf_score, fusion_rank, sources, '[S' || (final_rank + 1) || ']' AS marker FROM best").replace("best AS (SELECT query_id, doc_id, st,", "firsts AS (SELECT query_id, doc_id, st,").replace("AS keyword_rank FROM best)", "AS keyword_rank FROM firsts)")


@query(HYBRID)
def hybrid_retrieval(spark, sf_dir):
    """Both legs, merged, fused, capped at 100, reranked, ten a question."""
    docs, asked = table(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    fused = staged(ops.fuse(ops.merge_candidates(_legs(spark, sf_dir))).where("fusion_rank < 100"), "fused")
    x = fused.withColumn("doc_id", F.col("document_key").cast("long")).join(docs, "doc_id").join(asked.select("query_id", "question"), "query_id")
    score = ops.fallback_score(F.col("question"), F.col("text"), F.concat_ws("/", "source", "lang"), {"vector_rank": F.col("vector_rank"), "keyword_rank": F.col("keyword_rank")})
    out = ops.top_n(x.withColumn("score", F.round(score, 9)), "score", "fusion_rank", 10, "final_rank")
    return out.select("query_id", "final_rank", "doc_id", F.round("score", 6).alias("score"), F.round("rrf_score", 9).alias("rrf_score"), "fusion_rank", "sources", F.concat(F.lit("[S"), (F.col("final_rank") + 1).cast("string"), F.lit("]")).alias("marker"))


@query("WITH " + NEAREST + """, c AS (SELECT query_id, vec_id, vector_rank, CASE WHEN vec_id % 3 = 0 THEN CAST(vec_id % 17 AS DOUBLE) END AS score, vec_id % 5 AS fallback FROM ranked WHERE vector_rank < 30),
m AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score IS NULL, score DESC, fallback DESC, vector_rank) - 1 AS r FROM c), f AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY fallback DESC, vector_rank) - 1 AS r FROM c)
SELECT query_id, CAST(vec_id AS VARCHAR) AS document_key, r AS final_rank, 'model' AS reranker, NULL AS fallback_reason FROM m WHERE r < 10 UNION ALL SELECT query_id, CAST(vec_id AS VARCHAR), r, 'fallback:deterministic', 'reranker_unsupported:other' FROM f WHERE r < 10""")
def reranked(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    x = ops.cosine_topk(v, v.where("vec_id % 20 = 0"), 30)
    c = x.select("query_id", F.col("vec_id").cast("string").alias("document_key"), F.col("vector_rank").alias("rank"), (F.col("vec_id") % 5).cast("double").alias("fallback_score"))
    scored = lambda rows: rows.where("cast(document_key as long) % 3 = 0").select("query_id", "document_key", (F.col("document_key").cast("long") % 17).cast("double").alias("score"))
    both = ops.rerank(c, 10, "model", scored).unionByName(ops.rerank(c, 10, "other"))
    return both.select("query_id", "document_key", "final_rank", "reranker", "fallback_reason")


QUERIES, ORACLES = query.queries, query.oracles
