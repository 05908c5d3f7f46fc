"""Operational records: event documents, trace spans, conversations, sessions and users."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

# Fields that every event may carry, and those of each kind.
BASE_FIELDS = "app_version component duration_ms environment git_sha image_digest image_tag operation phoenix_session_id phoenix_trace_id request_id service session_id status user_hash".split()
QUERY_FIELDS = "citations_valid error_code error_type fallback_count final_evidence keyword_candidates keyword_search_status merged_candidates model_error_type rerank_input_candidates reranked_candidates reranker vector_candidates vector_search_status".split()
INGEST_FIELDS = "chunk_count enable_ocr error_code error_type failed_files index_vectors indexed_files keyword_indexed manifest_only_files no_text_files total_files unsupported_files vector_indexed".split()
EVAL_FIELDS = "error_code error_type example_count passed_count phoenix_mode ragas_metrics skipped_count wrote_output".split()
EVENT_FIELDS = {"query.completed": QUERY_FIELDS, "query.failed": QUERY_FIELDS, "web_query.completed": QUERY_FIELDS, "web_query.failed": QUERY_FIELDS, "ingest.completed": INGEST_FIELDS, "ingest.failed": INGEST_FIELDS, "eval.completed": EVAL_FIELDS, "dependency.unavailable": "dependency dependency_status error_code error_type".split(), "app.started": "eventlog_elasticsearch_enabled trace_enabled".split()}
SECRET_PARTS = ("password", "secret", "token", "api_key", "authorization", "prompt", "answer", "question", "content")


def event_name(event: Column, status: Column) -> Column:
    """A completed event whose status is neither ok nor success becomes its failed twin, if there is one."""
    failed = F.regexp_replace(event, r"\.completed$", ".failed")
    bad = (F.trim(status) != "") & ~F.lower(F.trim(status)).isin("ok", "success")
    return F.when(event.rlike(r"\.completed$") & bad & failed.isin(*EVENT_FIELDS), failed).otherwise(event)


def checked_events(events: DataFrame) -> DataFrame:
    """Adds name, rejected (why the schema refuses the event, else null) and document (allowed fields). events: event, fields (map of strings)."""
    name = event_name(F.col("event"), F.coalesce(F.col("fields")["status"], F.lit("")))
    x = events.withColumn("name", name)
    allowed = F.create_map(*[z for k, v in EVENT_FIELDS.items() for z in (F.lit(k), F.array(*[F.lit(f) for f in sorted({*BASE_FIELDS, *v})]))])
    keys = F.map_keys("fields")
    secret = F.exists(keys, lambda k: reduce(lambda a, b: a | b, [F.contains(F.lower(k), F.lit(p)) for p in SECRET_PARTS]))
    unknown = F.size(F.array_except(keys, F.coalesce(allowed[F.col("name")], F.array().cast("array<string>")))) > 0
    why = F.when(~F.col("name").isin(*EVENT_FIELDS), "unsupported event").when(secret, "forbidden fields").when(unknown, "unknown fields")
    return x.withColumn("rejected", why).withColumn("document", F.when(why.isNull(), F.col("fields")))


def routed(events: DataFrame) -> DataFrame:
    """Adds stream: evaluation events have one of their own."""
    return events.withColumn("stream", F.when(F.col("name").startswith("eval."), "evals").otherwise("events"))


def retained(events: DataFrame, now: Column, days: dict[str, int]) -> DataFrame:
    keep = reduce(lambda a, b: a | b, [(F.col("stream") == s) & (F.col("ts") >= now - F.expr(f"INTERVAL {d} DAYS")) for s, d in days.items()])
    return events.where(keep)


def span_errors(spans: DataFrame, required: dict[str, str], forbidden: tuple[str, ...] = ()) -> DataFrame:
    """(trace_id, error): required spans that a trace lacks or has with another kind, and forbidden ones. spans: trace_id, name, span_kind."""
    want = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind")) for n, k in required.items()])
    got = spans.groupBy("trace_id").agg(F.collect_set(F.struct("name", F.col("span_kind").alias("kind"))).alias("have"))  # names times kinds at most
    names = F.transform("have", lambda s: s["name"])
    missing = F.transform(F.filter(want, lambda s: ~F.array_contains(names, s["name"])), lambda s: F.concat(F.lit("missing span: "), s["name"]))
    kind = F.transform(F.filter(want, lambda s: F.array_contains(names, s["name"]) & ~F.array_contains("have", s)), lambda s: F.concat(F.lit("wrong kind: "), s["name"]))
    bad = F.transform(F.array_intersect(names, F.array(*[F.lit(n) for n in forbidden]) if forbidden else F.array().cast("array<string>")), lambda n: F.concat(F.lit("forbidden span: "), n))
    return got.select("trace_id", F.explode(F.concat(missing, kind, bad)).alias("error"))


def with_sequence(messages: DataFrame) -> DataFrame:
    """Adds sequence, 1-based within a conversation."""
    return messages.withColumn("sequence", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))


def answered(messages: DataFrame) -> DataFrame:
    """User turns with whether an assistant turn follows before the conversation ends, and the turn of the next one."""
    after = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    return messages.withColumn("next_assistant", F.min(F.when(F.col("role") == "assistant", F.col("turn"))).over(after)).where("role = 'user'").select("conv_id", "turn", F.col("next_assistant").isNotNull().alias("answered"), "next_assistant")


def conversation_list(messages: DataFrame, limit: int = 80) -> DataFrame:
    """A row for each conversation: title (its first user text, one line, cut), turns, last turn."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    x = messages.groupBy("conv_id").agg(first.alias("t"), F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    return x.select("conv_id", F.substring(F.trim(F.regexp_replace("t", r"\s+", " ")), 1, limit).alias("title"), "messages", "last_turn")


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not expired, of approved users. sessions: session, user_id, expires_at; users: user_id, status."""
    return sessions.where(F.col("expires_at") > now).join(users.where("status = 'approved'"), "user_id")


def first_claims(claims: DataFrame, stale_minutes: int = 30) -> DataFrame:
    """Claims that win: the first of a key, and each later one that comes more than stale_minutes after the last winner. claims: key, claimed_at, event_id.

    Each task reads its keys' claims in order and remembers the last winner alone, however many claims a key has.
    """
    stale = stale_minutes * 60_000_000
    kinds = [to_arrow_type(claims.schema[c].dataType) for c in ("key", "event_id")]

    def won(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for b in batches:
            keep = []
            for k, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if last is None or k != key or at - last > stale:
                    key, last = k, at
                    keep.append(True)
                else:
                    keep.append(False)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())).cast(t) for c, t in zip(b.columns, kinds, strict=False)], ["key", "event_id"])

    rows = claims.select("key", "event_id", F.unix_micros(F.col("claimed_at").cast("timestamp")).alias("at"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "event_id").mapInArrow(won, StructType([claims.schema["key"], claims.schema["event_id"]]))


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], replace: Column) -> DataFrame:
    """old with new rows added; a row that both have takes new values where `replace` (over old's columns, as o.*) holds."""
    a, b = old.alias("o"), new.alias("n")
    x = a.join(b, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    take = F.col(f"o.{key}").isNull() | (F.col(f"n.{key}").isNotNull() & F.coalesce(replace, F.lit(False)))
    return x.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.when(take, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns])


def latest_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key (REPLACE INTO)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
