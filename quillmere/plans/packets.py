"""Queries of the packet operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.operators import packets as ops
from quillmere.plans.base import ELEMENTS, Part, sql
from quillmere.sources.tables import elements, table

query = Part()
GOLD = """rows AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 4 = 3 THEN 'refusal_out_of_corpus_behavior' ELSE 'indexed_answerability' END AS lane, CASE WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 5 = 1 THEN ['c' || doc_id || ':0'] WHEN doc_id % 5 = 2 THEN ['c' || doc_id || ':0', 'f' || doc_id] WHEN doc_id % 5 = 3 THEN ['x' || doc_id, 'c' || doc_id || ':0'] ELSE ['f' || doc_id] END AS gold FROM documents),
chunks AS (SELECT 'c' || doc_id || ':' || ordinal AS chunk_id, 'f' || doc_id AS file_id FROM elements),
ids AS (SELECT row_id, i, gold[i] AS id FROM (SELECT row_id, gold, unnest(range(1, len(gold) + 1)) AS i FROM rows)),
kinds AS (SELECT row_id, i, id, CASE WHEN id IN (SELECT chunk_id FROM chunks) THEN 'chunk' WHEN id IN (SELECT file_id FROM chunks) THEN 'file' ELSE 'unresolved' END AS kind FROM ids),
packed AS (SELECT r.row_id, lane, coalesce(string_agg(id, ',' ORDER BY i) FILTER (WHERE kind = 'chunk'), '') AS resolved, coalesce(string_agg(id, ',' ORDER BY i) FILTER (WHERE kind = 'file'), '') AS file_only, coalesce(string_agg(id, ',' ORDER BY i) FILTER (WHERE kind = 'unresolved'), '') AS unresolved FROM rows r LEFT JOIN kinds k ON k.row_id = r.row_id GROUP BY r.row_id, lane),
packets AS (SELECT *, CASE WHEN lane = 'refusal_out_of_corpus_behavior' THEN 'not_required' WHEN unresolved <> '' THEN 'unresolved' WHEN file_only <> '' THEN 'file_only' WHEN resolved <> '' THEN 'resolved' ELSE 'missing' END AS gold_status FROM packed)"""


def _packets(spark, sf_dir):
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    name = lambda p, s="": F.concat(F.lit(p), d.cast("string"), F.lit(s))
    gold = F.when(d % 5 == 0, F.array().cast("array<string>")).when(d % 5 == 1, F.array(name("c", ":0"))).when(d % 5 == 2, F.array(name("c", ":0"), name("f"))).when(d % 5 == 3, F.array(name("x"), name("c", ":0"))).otherwise(F.array(name("f")))
    rows = docs.select(d.alias("row_id"), F.when(d % 4 == 3, "refusal_out_of_corpus_behavior").otherwise("indexed_answerability").alias("lane"), gold.alias("gold"))
    chunks = elements(docs).select(F.concat(name("c", ":"), F.col("ordinal").cast("string")).alias("chunk_id"), name("f").alias("file_id"), F.col("line").alias("text"))
    return ops.packets(rows, chunks)


def _flat(x):
    return x.select("row_id", "lane", *[F.array_join(c, ",").alias(c) for c in ("resolved", "file_only", "unresolved")], "gold_status")


@query(sql(ELEMENTS, GOLD, select="SELECT * FROM packets"))
def evidence_packets(spark, sf_dir):
    return _flat(_packets(spark, sf_dir))


@query(sql(ELEMENTS, GOLD, select="SELECT * FROM packets WHERE gold_status IN ('unresolved', 'file_only', 'missing')"))
def strict_blockers(spark, sf_dir):
    return _flat(ops.blockers(_packets(spark, sf_dir)))


@query("""SELECT doc_id, 'quality' AS metric, CAST(quality AS DOUBLE) AS score, CASE WHEN quality >= 0.5 THEN 'pass' ELSE 'fail' END AS label FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE), CASE WHEN toxic >= 0.5 THEN 'pass' ELSE 'fail' END FROM labels WHERE doc_id % 3 <> 0""")
def metric_annotations(spark, sf_dir):
    x = table(spark, sf_dir, "labels").withColumn("toxic", F.when(F.col("doc_id") % 3 != 0, F.col("toxic")))
    return ops.annotations(x, "doc_id", ["quality", "toxic"])


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'right' ELSE role END AS role FROM conversations")
def positional_merge(spark, sf_dir):
    at = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.md5("text"))
    x = table(spark, sf_dir, "conversations").withColumn("at", at)
    right = x.select("at", F.when(F.col("turn") % 2 == 0, "right").alias("role")).distinct()
    return ops.positional_merge(x, right, "at", ["role"]).select("conv_id", "turn", "role")


@query("WITH s AS (SELECT user_id AS trace_id, event_id, ts, event_type FROM events), l AS (SELECT trace_id FROM s WHERE event_type = 'signup' ORDER BY ts DESC, trace_id DESC LIMIT 1) SELECT trace_id, event_id FROM s WHERE trace_id IN (SELECT trace_id FROM l)")
def latest_trace(spark, sf_dir):
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), "event_id", F.when(F.col("event_type") != "signup", F.lit("p")).alias("parent"), F.col("ts").alias("time"), F.lit(None).cast("string").alias("run_id"))
    return ops.run_traces(x, "none").select("trace_id", "event_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'root/' || source || '/' || doc_id END AS path, CASE WHEN doc_id % 3 = 0 THEN 'invalid email' WHEN doc_id % 3 = 1 THEN 'password too short' END AS error, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 1.0 END AS recall FROM documents""")
def registration_checks(spark, sf_dir):
    d = F.col("doc_id")
    path = F.concat_ws("/", F.when(d % 4 == 0, F.concat(F.lit("../"), "source")).otherwise(F.col("source")), d.cast("string"))
    error = ops.email_errors(F.when(d % 3 == 0, "nobody").otherwise("A@b.example "), F.when(d % 3 == 1, "short").otherwise("long enough"))
    recall = ops.context_recall(F.array(F.lit("a"), F.lit("b")), F.when(d % 2 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("b"))))
    return table(spark, sf_dir, "documents").select("doc_id", ops.inside("root", path).alias("path"), error.alias("error"), recall.alias("recall"))


QUERIES, ORACLES = query.queries, query.oracles
