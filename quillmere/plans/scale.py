"""Queries of hash trees, ranks and texts under hot keys, and of legs that fail for some questions."""

from __future__ import annotations

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from quillmere.functions import text
from quillmere.operators import corpus, legs, versions
from quillmere.operators import retrieval as ops
from quillmere.operators.ranks import ordered_text, rank_within, staged
from quillmere.plans.base import ELEMENTS, FILES, QUESTIONS, TOKENS, Part, sql
from quillmere.plans.retrieval import EMBEDDED, EXACT, INDEX, SCORES, SETS, _asked, index, vectors
from quillmere.sources.tables import elements, files, table

query = Part()

_LINE = "file_id || ':' || file_hash"


def _tree(name: str, files_: str) -> str:
    """SQL of a hash tree of at most three levels below its root: enough for tables of 250,000 files."""
    kids = lambda size: f"SELECT substr(prefix, 1, {size}) AS prefix, sha256(string_agg(prefix || ':' || n || ':' || hash, chr(10) ORDER BY prefix)) AS joined FROM {name}{size + 1} GROUP BY 1"
    flat = lambda size: f"SELECT substr(file_id, 1, {size}) AS prefix, count(*) AS n, sha256(string_agg({_LINE}, chr(10) ORDER BY file_id)) AS own FROM {files_} GROUP BY 1"
    levels = [f"{name}3 AS (SELECT prefix, n, own AS hash FROM ({flat(3)}))"]
    levels += [f"{name}{s} AS (SELECT prefix, n, CASE WHEN n > 64 THEN joined ELSE own END AS hash FROM ({flat(s)}) JOIN ({kids(s)}) USING (prefix))" for s in (2, 1)]
    levels += [f"{name}0 AS (SELECT '' AS prefix, n, CASE WHEN n > 64 THEN joined ELSE own END AS hash FROM (SELECT count(*) AS n, sha256(string_agg({_LINE}, chr(10) ORDER BY file_id)) AS own FROM {files_}), (SELECT sha256(string_agg(prefix || ':' || n || ':' || hash, chr(10) ORDER BY prefix)) AS joined FROM {name}1))"]
    every = f"SELECT * FROM {name}0" + "".join(f" UNION ALL SELECT c.* FROM {name}{s} c JOIN {name}{s - 1} p ON p.prefix = substr(c.prefix, 1, {s - 1}) AND p.n > 64" + "".join(f" JOIN {name}{k} g{k} ON g{k}.prefix = substr(c.prefix, 1, {k}) AND g{k}.n > 64" for k in range(s - 1)) for s in (1, 2, 3))
    return ", ".join(levels) + f", {name} AS (SELECT prefix, n, hash, n <= 64 AS leaf FROM ({every}))"


@query(sql(FILES, _tree("t", "files"), select="SELECT prefix, n, hash, leaf FROM t"))
def corpus_tree(spark, sf_dir):
    return versions.hash_tree(files(table(spark, sf_dir, "documents")))


_EARLIER = "earlier AS (SELECT f.file_id, CASE WHEN n_chars = max(n_chars) OVER (PARTITION BY source, lang) THEN sha256(f.text || ' Draft.') ELSE file_hash END AS file_hash FROM files f JOIN documents d USING (doc_id))"


@query(sql(FILES, _EARLIER, _tree("a", "earlier"), _tree("b", "files"), select="""SELECT coalesce(a.prefix, b.prefix) AS prefix, a.n AS n_old, b.n AS n_new FROM a FULL JOIN b ON a.prefix = b.prefix
  LEFT JOIN a pa ON pa.prefix = substr(coalesce(a.prefix, b.prefix), 1, length(coalesce(a.prefix, b.prefix)) - 1) LEFT JOIN b pb ON pb.prefix = pa.prefix
  WHERE a.hash IS DISTINCT FROM b.hash AND (coalesce(a.leaf, TRUE) OR coalesce(b.leaf, TRUE)) AND (coalesce(a.prefix, b.prefix) = '' OR NOT (pa.leaf OR pb.leaf))"""))
def changed_ranges(spark, sf_dir):
    """Ranges of ids in which an earlier draft of the longest texts of each source and language differs from the corpus."""
    from pyspark.sql.window import Window

    docs = table(spark, sf_dir, "documents")
    longest = F.col("n_chars") == F.max("n_chars").over(Window.partitionBy("source", "lang"))
    earlier = docs.withColumn("text", F.when(longest, F.concat("text", F.lit(" Draft."))).otherwise(F.col("text")))
    return versions.changed_ranges(versions.hash_tree(files(earlier)), versions.hash_tree(files(docs)))


@query(sql(ELEMENTS, select="SELECT doc_id, ordinal, row_number() OVER (PARTITION BY CASE WHEN ordinal % 2 = 0 THEN sha256(line) ELSE 'same' END ORDER BY doc_id, ordinal) - 1 AS place FROM elements"))
def hot_line_places(spark, sf_dir):
    """The place of each line among equal ones, in a table in which every other line is the same."""
    x = elements(table(spark, sf_dir, "documents"))
    hash_ = F.when(F.col("ordinal") % 2 == 0, F.sha2("line", 256)).otherwise("same")
    return rank_within(x.select("doc_id", "ordinal", hash_.alias("hash")), ["hash"], ["doc_id", "ordinal"], "place").select("doc_id", "ordinal", "place")


@query(sql(FILES, select="SELECT inferred_category AS file_hash, count(*) AS n_paths, array_to_string(list_sort(list(relative_path))[1:100], ',') AS first_paths FROM files GROUP BY 1"))
def provenance_bounded(spark, sf_dir):
    """Paths of each source as if all its files had the same content: counts and the first hundred."""
    x = files(table(spark, sf_dir, "documents")).select(F.col("inferred_category").alias("file_hash"), "relative_path")
    return corpus.provenance_bounded(x).withColumn("first_paths", F.array_join("first_paths", ","))


@query("SELECT source, md5(substr(t, 1, 12000)) AS text_md5, least(length(t), 12000) AS n FROM (SELECT source, string_agg(text, chr(10) ORDER BY doc_id) AS t FROM documents WHERE text <> '' GROUP BY source)")
def file_previews(spark, sf_dir):
    """All texts of a source in order, cut at 12,000 characters."""
    x = ordered_text(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return x.select("source", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"))


def _embedder():
    """The default embedding model as a provider that takes a question's tokens; it has no answer to about a third of first tokens."""

    def embed(tokens: list[str]) -> list[float]:
        if tokens and hashlib.md5(tokens[0].encode()).hexdigest()[0] < "5":
            raise TimeoutError("no answer")
        n = Counter(int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % 64 for t in tokens)
        return [1 + math.log(n[d]) if n[d] else 0.0 for d in range(64)]

    return embed


def _reranker():
    """Scores texts by their length and gives up on questions whose last letter comes early in the alphabet."""

    def score(question: str, texts: list[str]) -> list[float]:
        if question[-1:] < "g":
            raise ConnectionError("busy")
        return [float(len(t)) for t in texts]

    return score


_FAILING = "question <> '' AND substr(md5(" + TOKENS.format("question") + "[1]), 1, 1) < '5'"


@query("WITH " + QUESTIONS + ", " + INDEX + ", " + SETS + ", " + EXACT + ", " + SCORES + ", " + EMBEDDED + f""", v AS (SELECT query_id, count(*) AS n FROM embedded GROUP BY 1), k AS (SELECT query_id, count(*) AS n FROM hits GROUP BY 1),
placed AS (SELECT q.query_id, h.doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY CASE WHEN right(question, 1) >= 'g' THEN length(d.text) END DESC NULLS LAST, keyword_score DESC, keyword_rank) AS p FROM questions q JOIN hits h USING (query_id) JOIN documents d USING (doc_id)),
x AS (SELECT q.query_id, question, {_FAILING} AS failing, coalesce(v.n, 0) AS vn, coalesce(k.n, 0) AS kn FROM questions q LEFT JOIN v USING (query_id) LEFT JOIN k USING (query_id))
SELECT x.query_id, CASE WHEN failing THEN 'failed' WHEN vn > 0 THEN 'ok' ELSE 'empty' END AS vector_status, CASE WHEN failing THEN 'TimeoutError: no answer' END AS vector_error, CASE WHEN failing THEN 0 ELSE vn END AS vector_rows, CASE WHEN kn > 0 THEN 'ok' ELSE 'empty' END AS keyword_status, kn AS keyword_rows,
  CASE WHEN kn > 0 AND right(question, 1) < 'g' THEN 'reranker_failed:lengths' END AS fallback_reason, array_to_string(list_filter([CASE WHEN failing THEN 'vector_failed' END, CASE WHEN kn > 0 AND right(question, 1) < 'g' THEN 'fallback_reranker_failed_lengths' END], lambda t: t IS NOT NULL), ',') AS tags, placed.doc_id AS first_document
FROM x LEFT JOIN placed ON placed.query_id = x.query_id AND p = 1""")
def degraded_legs(spark, sf_dir):
    """Both legs and reranking of every question, with an embedding provider and a reranker that each fail for a third of them."""
    docs, asked = table(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    indexed = staged(index(docs), "tokens")
    tokens = asked.select("query_id", text.tokens(F.col("question")).alias("tokens"))
    vector, states = legs.vector_leg(tokens, vectors(indexed), _embedder, ["tokens"], retries=1, pause=0.001)
    keyword = ops.keyword_search(indexed, asked)
    candidates = keyword.join(docs.select("doc_id", "text"), "doc_id").join(asked.select("query_id", "question"), "query_id").select("query_id", "question", F.col("doc_id").cast("string").alias("document_key"), "text", F.col("keyword_score").alias("fallback_score"), F.col("keyword_rank").alias("rank"))
    ranked = legs.rerank_calls(candidates, _reranker, 10, "lengths", retries=1, pause=0.001)
    first = ranked.where("final_rank = 0").select("query_id", F.col("document_key").cast("long").alias("first_document"))
    x = legs.leg_states(states, vector, keyword, ranked).join(first, "query_id", "left")
    return x.select("query_id", "vector_status", "vector_error", "vector_rows", "keyword_status", "keyword_rows", "fallback_reason", F.array_join("tags", ",").alias("tags"), "first_document")


QUERIES, ORACLES = query.queries, query.oracles
