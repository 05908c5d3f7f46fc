"""Queries of ingestion runs, OCR with a memo, judged metrics and payloads of any shape."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmere.functions import payload as pay
from quillmere.functions.text import collapse
from quillmere.operators import ingest, judging, ocr
from quillmere.plans.base import FILES, TOKENS, Part, sql
from quillmere.sources.tables import files, shared_path, table

query = Part()


@query(sql(FILES, "m AS (SELECT max(lang) AS newest, min(source) AS redrafted FROM documents)", select=f"""SELECT relative_path, file_hash, CASE WHEN lang = newest THEN 'new' WHEN source = redrafted THEN 'changed' ELSE 'kept' END AS action,
  regexp_matches(f.text, '\\S') AS indexed, len(list_distinct({TOKENS.format('f.text')})) AS terms, CAST(0 AS BIGINT) AS without_vector, FALSE AS wrote_again FROM files f JOIN documents d USING (doc_id), m"""))
def ingestion_run(spark, sf_dir):
    """Two versions of the corpus, and the second one again: some files are new, some have other bytes, some went, and the last run writes nothing.

    The first version lacks the last language, has another draft of one source, and files that are later withdrawn.
    """
    docs = table(spark, sf_dir, "documents")
    newest, redrafted = docs.agg(F.max("lang"), F.min("source")).first()
    now = files(docs).withColumn("source_type", F.lit("text"))
    draft = F.when(F.col("source") == redrafted, F.concat("text", F.lit("\nDraft."))).otherwise(F.col("text"))
    earlier = docs.where(F.col("lang") != newest).withColumn("text", draft)
    gone = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("withdrawn").alias("lang"), F.lit("benchmark").alias("source"))
    before = files(earlier.select("doc_id", "text", "lang", "source").unionByName(gone)).withColumn("source_type", F.lit("text"))
    root = shared_path(spark, "corpus")
    ingest.run_ingestion(before, root, "first")
    ingest.run_ingestion(now, root, "second")
    again = ingest.run_ingestion(now, root, "third")
    rows = ingest.manifest(spark, root)
    old = ingest.manifest(spark, root, "first").select("file_id", F.lit(True).alias("there"))
    held = ingest.active(spark, root, "postings").select("file_id", "term").repartition("file_id")  # a file's terms meet once, so no task holds those of all its files first
    terms = held.groupBy("file_id").agg(F.countDistinct("term").alias("terms"))
    vectors = ingest.active(spark, root, "vectors").groupBy("file_id").agg(F.count_if(F.col("error").isNotNull()).alias("without_vector"))
    x = rows.join(old, "file_id", "left").join(terms, "file_id", "left").join(vectors, "file_id", "left").fillna(0, ["terms", "without_vector"])
    action = F.when(F.col("segment") == "first", "kept").when(F.col("there"), "changed").otherwise("new")
    return x.select("relative_path", "file_hash", action.alias("action"), (F.col("status") == "indexed").alias("indexed"), "terms", "without_vector", F.lit(again["wrote"]).alias("wrote_again"))


def _reader():
    """Reads images that hold UTF-8 text; one without letters is an error."""

    def read(image: str) -> str:
        if image.strip() and not any(c.isalpha() for c in image):
            raise ValueError("no letters")
        return " ".join(image.split())

    return read


@query(r"""WITH d AS (SELECT doc_id, sha256(text) AS h, lang, source, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM documents),
w AS (SELECT *, len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS words, t <> '' AND NOT regexp_matches(t, '\p{L}') AS broken FROM d),
r AS (SELECT *, CASE WHEN broken THEN 'OCR failed: ValueError: no letters' WHEN t = '' THEN 'OCR returned empty text'
  WHEN regexp_matches(lower(t), '(^|[^\p{L}\p{N}_])(no\s+(visible|readable|recognizable)\s+text|(there is|i can(not|''t))\s+(no\s+)?(visible\s+)?text|текст\s+(не\s+виден|не\s+обнаружен|отсутствует))($|[^\p{L}\p{N}_])') THEN 'OCR output rejected: canned_no_text_response'
  WHEN lang = 'en' AND words < 25 THEN 'OCR output rejected: decorative_or_too_short:' || words || '_tokens' END AS warning FROM w)
SELECT doc_id, t <> '' AND NOT broken AS cached, warning, CASE WHEN warning IS NULL THEN md5(t) END AS text_md5, CASE WHEN warning IS NULL THEN CASE WHEN regexp_matches(lower(source || '.png ' || t), 'схема|diagram|flowchart') THEN 'diagram' ELSE 'page' END END AS layout_route,
  CASE WHEN broken THEN 4 WHEN t = '' THEN 2 ELSE 1 END AS calls FROM r""")
def ocr_admitted(spark, sf_dir):
    """Each text as the image of a page, read in two runs: the memo answers the second one but for empty and failed answers. calls counts both runs."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "en", "embedded_image").otherwise("pdf_page")
    images = docs.select("doc_id", F.sha2("text", 256).alias("file_hash"), F.lit("root").alias("image_id"), F.col("text").alias("image"), kind.alias("source_type"), F.concat("source", F.lit(".png")).alias("file_name"), F.lit("page").alias("layout_route"), "lang", "source")
    images = ocr.with_recipe(images, {"model": F.lit("plain"), "task": F.lit(None).cast("string")}, {"layout_route": F.col("layout_route"), "lang": F.col("lang"), "source": F.col("source")})
    memo = shared_path(spark, "ocr-memo")
    read = lambda run: ocr.read_images(images, _reader, "dashscope:plain", memo, run, retries=1, pause=0.001)
    read("r1")
    second = read("r2")
    asked = spark.read.parquet(memo).groupBy("file_hash", "recipe").agg(F.sum("attempts").cast("int").alias("calls"))
    return second.join(asked, ["file_hash", "recipe"]).select("doc_id", "cached", "warning", F.md5("text").alias("text_md5"), "layout_route", "calls")


_W = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


def _share(said: str, known: str) -> str:
    return f"CAST(len(list_intersect({_W.format(said)}, {_W.format(known)})) AS DOUBLE) / len({_W.format(said)})"


_JUDGED = [("faithfulness", "a", "q", "q <> '' AND a <> ''", "missing_response_or_contexts"), ("answer_relevancy", "q", "a", "q <> '' AND a <> ''", "missing_user_input_or_response"), ("context_recall", "r", "q", "q <> '' AND r <> ''", "missing_reference_or_contexts"), ("factual_correctness", "a", "r", "a <> '' AND r <> ''", "missing_response_or_reference")]
_NONE = lambda said: f"len(regexp_extract_all({said}, '[\\p{{L}}\\p{{N}}_]+')) = 0"


@query(r"""WITH c AS (SELECT conv_id, turn, role, text AS q, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
x AS (SELECT conv_id || ':' || turn AS id, regexp_replace(q, '^ +| +$', '', 'g') AS q, regexp_replace(coalesce(CASE WHEN next_role = 'assistant' THEN next_text END, ''), '^ +| +$', '', 'g') AS a, regexp_replace(coalesce(r, ''), '^ +| +$', '', 'g') AS r FROM c WHERE role = 'user') """
       + " UNION ALL ".join(f"SELECT id, '{m}' AS metric, CASE WHEN {ok} AND NOT {_NONE(s)} THEN round({_share(s, k)}, 9) END AS score, CASE WHEN NOT ({ok}) THEN 'skipped' WHEN {_NONE(s)} THEN 'failed' ELSE 'scored' END AS label, CASE WHEN NOT ({ok}) THEN '{why}' WHEN {_NONE(s)} THEN 'ValueError: nothing to judge' END AS reason, CASE WHEN NOT ({ok}) THEN 0 WHEN {_NONE(s)} THEN 2 ELSE 1 END AS attempts FROM x" for m, s, k, ok, why in _JUDGED))
def judged_metrics(spark, sf_dir):
    """Each user's turn as a question, the assistant's next turn as its answer, the question's lines as contexts and the conversation's last answer as reference."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(whole)
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"), last.alias("reference")).where("role = 'user'")
    rows = x.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("user_input"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("response"), F.split("text", "\n").alias("retrieved_contexts"), "reference")
    got = judging.judged(rows, list(judging.NEEDS), retries=1, pause=0.001)
    return got.withColumn("score", F.round("score", 9))


@query("""WITH a AS (SELECT event_id, 'k' AS path, regexp_extract(props, '[0-9]+') AS value FROM events WHERE event_type NOT IN ('error', 'view') UNION ALL SELECT event_id, 'event.name', event_type FROM events UNION ALL SELECT event_id, 'event.by.user', CAST(user_id AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'event', '{"by":{"user":' || user_id || '},"name":"' || event_type || '"}' FROM events UNION ALL SELECT event_id, 'event.by', '{"user":' || user_id || '}' FROM events UNION ALL SELECT event_id, 'amount', CAST(value AS VARCHAR) FROM events
UNION ALL SELECT event_id, 'list', '["view",' || regexp_extract(props, '[0-9]+') || ']' FROM events WHERE event_type = 'view') SELECT * FROM a""")
def span_attributes(spark, sf_dir):
    """Events as spans: attributes from the first text column that is there, cut off and so bad JSON for errors, with columns that go over them."""
    kind = F.col("event_type")
    by = F.to_json(F.struct(F.struct(F.col("user_id").alias("user")).alias("by"), kind.alias("name")))
    listed = F.concat(F.lit('{"list":["view",'), F.regexp_extract("props", "[0-9]+", 0), F.lit("]}"))
    spans = table(spark, sf_dir, "events").select("event_id", F.when(kind == "error", F.substring("props", 1, 3)).when(kind == "view", F.lit("  ")).otherwise(F.col("props")).alias("attributes"), F.when(kind == "view", listed).alias("span_attributes"), by.alias("attributes.event"), F.col("value").alias("attributes.amount"))
    got = pay.span_attributes(spans, "event_id").select("event_id", F.explode("attributes").alias("path", "value"))
    number = F.col("value").try_cast("double").cast("string")
    return got.select("event_id", "path", F.when(F.col("path") == "amount", number).when(F.col("path") == "event.name", F.regexp_replace("value", '^"|"$', "")).otherwise(F.col("value")).alias("value"))


@query(r"""SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN role END AS role, CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) END AS words, CASE WHEN role = 'assistant' THEN md5(text) END AS text_md5, role <> 'assistant' AS empty FROM conversations""")
def message_payloads(spark, sf_dir):
    """Payloads of messages: the assistant's are objects, the user's are plain text, which is bad JSON and gives an empty object."""
    said = F.to_json(F.struct("role", F.struct(F.size(F.split("text", " ")).alias("words"), F.col("text").alias("text")).alias("body")))
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", pay.payload(F.when(F.col("role") == "assistant", said).otherwise(F.col("text"))).alias("v"))
    return x.select("conv_id", "turn", pay.field(F.col("v"), "$.role").alias("role"), pay.field(F.col("v"), "$.body.words", "int").alias("words"), F.md5(pay.field(F.col("v"), "$.body.text")).alias("text_md5"), (F.to_json("v") == "{}").alias("empty"))


QUERIES, ORACLES = query.queries, query.oracles
