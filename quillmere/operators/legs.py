"""Retrieval legs that fail for some questions: the failure is caught where it happens, and the other leg's results stay."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.operators import providers
from quillmere.operators.answers import degraded_tags, leg_status
from quillmere.operators.ranks import staged
from quillmere.operators.retrieval import cosine_topk


def vector_leg(asked: DataFrame, vectors: DataFrame, start: Callable[[], Callable[..., Sequence[float]]], use: list[str], k: int = 70, in_flight: int = 8, retries: int = 2, seconds: float = 60.0, pause: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(hits, states): the k nearest vectors (vec_id, embedding) of each question that the embedding provider answered.

    asked: query_id and the columns `use`, which the provider is given. hits: query_id, doc_id, cosine, vector_rank. states:
    query_id, vector_error, null where there is a vector; answers without a vector are the error 'no vector'. Each question is
    asked for once: answers are written before they are used twice.
    """
    got = providers.called(asked.select("query_id", *use), use, "embedding", "array<double>", start, in_flight, retries, seconds, pause)
    got = staged(got.select("query_id", "embedding", F.coalesce("error", F.when(F.coalesce(F.size("embedding"), F.lit(0)) <= 0, "no vector")).alias("vector_error")), "asked")
    held = got.where("vector_error IS NULL").select(F.col("query_id").alias("vec_id"), "embedding")
    hits = cosine_topk(vectors, held, k, same=False).select("query_id", F.col("vec_id").alias("doc_id"), "cosine", "vector_rank")
    return hits, got.select("query_id", "vector_error")


def leg_states(states: DataFrame, vector: DataFrame, keyword: DataFrame, reranked: DataFrame | None = None) -> DataFrame:
    """A row for each question of states: both legs' status and rows, and the tags that say what was degraded.

    vector and keyword are the legs' hits; reranked, if any, has fallback_reason by query_id.
    """
    counted = lambda hits, name: hits.groupBy("query_id").agg(F.count("*").alias(name))
    x = states.join(counted(vector, "vector_rows"), "query_id", "left").join(counted(keyword, "keyword_rows"), "query_id", "left").fillna(0, ["vector_rows", "keyword_rows"])
    if reranked is not None:
        x = x.join(reranked.groupBy("query_id").agg(F.max("fallback_reason").alias("fallback_reason")), "query_id", "left")
    else:
        x = x.withColumn("fallback_reason", F.lit(None).cast("string"))
    yes = F.lit(True)
    x = x.withColumn("vector_status", leg_status(yes, yes, F.col("vector_error").isNotNull(), F.col("vector_rows"))).withColumn("keyword_status", leg_status(yes, yes, F.lit(False), F.col("keyword_rows")))
    return x.withColumn("tags", degraded_tags(F.col("vector_status"), F.col("keyword_status"), F.coalesce("fallback_reason", F.lit(""))))


def rerank_calls(candidates: DataFrame, start: Callable[[], Callable[[str, list[str]], Sequence[float]]], n: int, name: str, in_flight: int = 8, retries: int = 2, seconds: float = 60.0, pause: float = 0.1) -> DataFrame:
    """The first n candidates of each question by a reranking provider, which is called once a question.

    candidates: query_id, question, document_key, text, fallback_score, rank (at most 100 a question). Where the provider fails,
    is late or gives another number of scores, that question alone falls back to fallback_score, and its rows say why.
    """
    each = candidates.groupBy("query_id", "question").agg(F.array_sort(F.collect_list(F.struct("rank", "document_key", "fallback_score", "text"))).alias("docs")).withColumn("texts", F.transform("docs", lambda d: d["text"]))
    got = staged(providers.called(each, ["question", "texts"], "scores", "array<double>", start, in_flight, retries, seconds, pause).drop("texts"), "reranked")
    wrong = F.when(F.col("error").isNotNull(), F.col("error")).when(~F.size("scores").eqNullSafe(F.size("docs")), "wrong number of scores")
    x = got.withColumn("why", wrong).select("query_id", "why", F.explode(F.arrays_zip("docs", F.when(wrong.isNull(), F.col("scores")).otherwise(F.transform("docs", lambda _: F.lit(None).cast("double"))).alias("scores"))).alias("d"))
    x = x.select("query_id", "d.docs.document_key", "d.docs.rank", "d.docs.fallback_score", F.col("d.scores").alias("score"), "why")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), F.desc("fallback_score"), "rank")) - 1
    out = x.withColumn("final_rank", place).where(F.col("final_rank") < n)
    failed = F.col("why").isNotNull()
    return out.select("query_id", "document_key", "final_rank", "score", F.when(failed, "fallback:deterministic").otherwise(name).alias("reranker"), F.when(failed, F.lit(f"reranker_failed:{name}")).alias("fallback_reason"), F.col("why").alias("reranker_error"))
