"""Queries of the record operators over events and conversations, and of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.operators import records as ops
from quillmere.plans.base import Part
from quillmere.sources.tables import shared_path, table
from quillmere.streaming import claims as streamed
from quillmere.streaming import events as streams
from quillmere.streaming.claims import keyed_state

query = Part()
NAMES = {"signup": "app.started", "purchase": "query.completed", "error": "dependency.unavailable", "view": "eval.completed", "click": "web_query.completed"}
CASES = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"


def _events(x):
    name = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in NAMES.items()])
    i = F.col("event_id")
    status = F.when(i % 3 == 0, "error").otherwise("ok")
    extra = F.when(i % 11 == 0, "user_password").when(i % 13 == 0, "colour").otherwise("request_id")
    return x.select("event_id", "ts", name.alias("event"), F.map_from_arrays(F.array(F.lit("status"), extra), F.array(status, F.lit("x"))).alias("fields"))


CHECKED = f"""named AS (SELECT event_id, ts, {CASES} AS e, event_id % 3 = 0 AS bad FROM events),
checked AS (SELECT event_id, ts, CASE WHEN bad AND e IN ('query.completed', 'web_query.completed') THEN replace(e, '.completed', '.failed') ELSE e END AS name, CASE WHEN event_id % 11 = 0 THEN 'forbidden fields' WHEN event_id % 13 = 0 THEN 'unknown fields' END AS rejected FROM named)"""


@query(f"WITH {CHECKED} SELECT event_id, name, rejected, CASE WHEN name LIKE 'eval.%' THEN 'evals' ELSE 'events' END AS stream FROM checked")
def event_documents(spark, sf_dir):
    return ops.routed(ops.checked_events(_events(table(spark, sf_dir, "events")))).select("event_id", "name", "rejected", "stream")


@query(f"WITH {CHECKED}, s AS (SELECT *, CASE WHEN name LIKE 'eval.%' THEN 'evals' ELSE 'events' END AS stream FROM checked), n AS (SELECT max(ts) AS now FROM events) SELECT stream, count(*) AS kept FROM s, n WHERE ts >= now - CASE stream WHEN 'evals' THEN INTERVAL 90 DAYS ELSE INTERVAL 30 DAYS END GROUP BY stream")
def event_retention(spark, sf_dir):
    x = table(spark, sf_dir, "events")
    now = F.lit(x.agg(F.max("ts")).first()[0])
    return ops.retained(ops.routed(ops.checked_events(_events(x))), now, {"events": 30, "evals": 90}).groupBy("stream").agg(F.count("*").alias("kept"))


@query("""WITH t AS (SELECT user_id AS trace_id, list(DISTINCT event_type) AS have FROM events GROUP BY user_id)
SELECT trace_id, 'missing span: purchase' AS error FROM t WHERE NOT list_contains(have, 'purchase') UNION ALL SELECT trace_id, 'missing span: signup' FROM t WHERE NOT list_contains(have, 'signup') UNION ALL SELECT trace_id, 'wrong kind: view' FROM t WHERE list_contains(have, 'view')
UNION ALL SELECT trace_id, 'missing span: view' FROM t WHERE NOT list_contains(have, 'view') UNION ALL SELECT trace_id, 'forbidden span: error' FROM t WHERE list_contains(have, 'error')""")
def span_validation(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace_id"), F.col("event_type").alias("name"), F.upper("event_type").alias("span_kind"))
    return ops.span_errors(spans, {"purchase": "PURCHASE", "signup": "SIGNUP", "view": "CHAIN"}, ("error",))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS sequence FROM conversations")
def message_sequence(spark, sf_dir):
    return ops.with_sequence(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "sequence")


@query("SELECT conv_id, turn, nxt IS NOT NULL AS answered, nxt AS next_assistant FROM (SELECT *, min(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM conversations) WHERE role = 'user'")
def answered_turns(spark, sf_dir):
    return ops.answered(table(spark, sf_dir, "conversations"))


@query(r"SELECT conv_id, substr(trim(regexp_replace(arg_min(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END), '\s+', ' ', 'g'), ' '), 1, 80) AS title, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_list(spark, sf_dir):
    return ops.conversation_list(table(spark, sf_dir, "conversations"))


SESSIONS = "s AS (SELECT event_id AS session, user_id, ts + INTERVAL 7 DAYS AS expires_at FROM events WHERE event_type = 'signup'), u AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'pending' ELSE 'approved' END AS status FROM (SELECT DISTINCT user_id FROM events)), n AS (SELECT max(ts) - INTERVAL 3 DAYS AS now FROM events)"


@query(f"WITH {SESSIONS} SELECT session, user_id FROM s JOIN u USING (user_id), n WHERE expires_at > now AND status = 'approved'")
def live_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = F.lit(e.agg(F.max("ts") - F.expr("INTERVAL 3 DAYS")).first()[0])
    s = e.where("event_type = 'signup'").select(F.col("event_id").alias("session"), "user_id", (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    u = e.select("user_id").distinct().withColumn("status", F.when(F.col("user_id") % 4 == 0, "pending").otherwise("approved"))
    return ops.live_sessions(s, u, now).select("session", "user_id")


CLAIMS = """WITH RECURSIVE c AS (SELECT user_id AS key, event_id, ts FROM events), f AS (SELECT key, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS k FROM c) WHERE k = 1
  UNION ALL SELECT key, event_id, ts FROM (SELECT c.*, row_number() OVER (PARTITION BY c.key ORDER BY c.ts, c.event_id) AS k FROM f JOIN c ON c.key = f.key AND c.ts > f.ts + INTERVAL 30 MINUTES) WHERE k = 1) SELECT key, event_id FROM f"""


@query(CLAIMS)
def response_claims(spark, sf_dir):
    return ops.first_claims(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("claimed_at"), "event_id"))


@query(CLAIMS)
def streamed_claims(spark, sf_dir):
    """The same winners from a stream that is started anew for each of four slices of arrival: claims arrive up to two hours late, and some twice."""
    claims = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("claimed_at"), "event_id", "event_type")
    late = F.pmod(F.xxhash64("event_id"), F.lit(7200))
    arrival = lambda more: F.unix_seconds("claimed_at") + late + more
    sent = claims.withColumn("arrival", arrival(0)).unionByName(claims.where("event_type = 'purchase'").withColumn("arrival", arrival(1800)))
    first, last = sent.agg(F.min("arrival"), F.max("arrival")).first()
    slices = 4
    number = F.least(F.lit(slices - 1), F.floor((F.col("arrival") - first) * slices / F.lit(max(1, last - first))))
    at = shared_path(spark, "claims")
    sent.withColumn("slice", number.cast("int")).select("key", "claimed_at", "event_id", "slice").write.partitionBy("slice").parquet(f"{at}/slices")
    tick = spark.sql(f"SELECT 0L AS key, timestamp_seconds({last + 86_400}) AS claimed_at, CAST(NULL AS BIGINT) AS event_id")
    with keyed_state(spark):
        for k in range(slices):
            rows = spark.read.parquet(f"{at}/slices/slice={k}").select("key", "claimed_at", "event_id")
            (rows.unionByName(tick) if k == slices - 1 else rows).write.mode("append").parquet(f"{at}/arrived")
            stream = spark.readStream.schema("key long, claimed_at timestamp, event_id long").parquet(f"{at}/arrived")
            save = lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/won/batch={n}")
            streamed.claims(stream).writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/won").select("key", "event_id")


@query("""WITH o AS (SELECT c_custkey AS user_id, c_mktsegment AS status, c_name AS name FROM customer WHERE c_custkey % 3 <> 0), w AS (SELECT c_custkey AS user_id, 'NEW' AS status, 'n' || c_custkey AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.user_id, w.user_id) AS user_id, CASE WHEN o.user_id IS NULL OR (w.user_id IS NOT NULL AND o.status = 'BUILDING') THEN w.status ELSE o.status END AS status, CASE WHEN o.user_id IS NULL OR (w.user_id IS NOT NULL AND o.status = 'BUILDING') THEN w.name ELSE o.name END AS name FROM o FULL JOIN w ON o.user_id = w.user_id""")
def user_upsert(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = c.where(k % 3 != 0).select(k.alias("user_id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("name"))
    new = c.where(k % 2 == 0).select(k.alias("user_id"), F.lit("NEW").alias("status"), F.concat(F.lit("n"), k.cast("string")).alias("name"))
    return ops.upsert(old, new, "user_id", ["status", "name"], F.col("o.status") == "BUILDING")


@query("SELECT c_custkey, CASE WHEN c_nationkey % 10 = 1 AND c_nationkey % 100 <> 11 THEN 'источник' WHEN c_nationkey % 10 BETWEEN 2 AND 4 AND NOT c_nationkey % 100 BETWEEN 12 AND 14 THEN 'источника' ELSE 'источников' END AS label FROM customer")
def source_labels(spark, sf_dir):
    from quillmere.functions.text import plural

    return table(spark, sf_dir, "customer").select("c_custkey", plural(F.col("c_nationkey"), "источник", "источника", "источников").alias("label"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_counts(spark, sf_dir):
    """Hourly counts from a stream that reads the table as it would read arriving files, until nothing is left."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = shared_path(spark, "counts")
    counts = streams.windowed_counts(stream, late="3650 days")
    save = lambda batch, _: batch.write.mode("overwrite").parquet(f"{at}/out")
    counts.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


QUERIES, ORACLES = query.queries, query.oracles
