"""Queries of text forms, answer signs, artefacts of evaluation and payloads of lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.functions import ids, text
from quillmere.operators import audit, corpus, lineage, metrics, packets, retrieval
from quillmere.plans.base import CONTENT, ELEMENTS, TOKENS, Part, sql
from quillmere.sources import readers
from quillmere.sources.tables import elements, shared_path, table

query = Part()

_NUMBERED = r"numbered AS (SELECT doc_id, ordinal, CASE WHEN line LIKE '% the %' OR line LIKE '% la %' THEN (ordinal + 1) || '.' || length(line) || ' ' || line ELSE line END AS line FROM elements), said AS (SELECT doc_id, ordinal, CASE WHEN regexp_matches(trim(line, ' '), '^\d+(\.\d+)*[.)]?\s+\S') AND length(trim(line, ' ')) <= 140 AND NOT regexp_matches(trim(line, ' '), '[.;,]$') THEN trim(line, ' ') END AS h FROM numbered)"


@query(sql(ELEMENTS, _NUMBERED, select="SELECT doc_id, ordinal, h IS NOT NULL AS heading, last_value(h IGNORE NULLS) OVER w AS section_heading, count(h) OVER w AS segment FROM said WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def numbered_headings(spark, sf_dir):
    """Lines with a common word get a number before them; those that are short and end in no stop are headings."""
    lines = elements(table(spark, sf_dir, "documents"))
    common = F.contains("line", F.lit(" the ")) | F.contains("line", F.lit(" la "))
    number = F.concat((F.col("ordinal") + 1).cast("string"), F.lit("."), F.length("line").cast("string"), F.lit(" "), "line")
    x = lines.withColumn("line", F.when(common, number).otherwise(F.col("line")))
    return corpus.sections(x, corpus.is_heading(F.col("line"))).select("doc_id", "ordinal", corpus.is_heading(F.col("line")).alias("heading"), "section_heading", "segment")


@query(r"""WITH d AS (SELECT doc_id, source, lang, text, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS one, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '-', 'g'), '-') AS s, """ + CONTENT.format("text") + " AS content, " + TOKENS.format("text") + r""" AS toks FROM documents)
SELECT doc_id, md5(CASE WHEN s = '' THEN 'section' ELSE s END) AS slug_md5, CASE WHEN length(one) <= 120 THEN one ELSE rtrim(substr(one, 1, 119), ' ') || '...' END AS line, len(CASE WHEN len(content) > 0 THEN content ELSE toks END) AS asked,
  len(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ')), lambda l: l <> ''))) AS lines, substr(one, 1, 300) AS quote, coalesce(nullif(trim(string_split(text, chr(10))[2], ' '), ''), nullif(trim(lang, ' '), ''), source) AS named, CASE WHEN contains(lower(text), lower(lang)) OR contains(lower(text), 'anon') THEN 1.0 ELSE 0.0 END AS relevance FROM d""")
def text_forms(spark, sf_dir):
    """Slugs, single lines, query tokens, cleaned lists, quotes, the first name that is there, and relevance to hints."""
    t = F.col("text")
    where = packets.chunk_locator({"chunk_id": F.col("doc_id").cast("string")}, t)
    second = F.get(F.split(t, "\n"), F.lit(1))
    hints = F.array(F.col("lang"), F.lit("ANON"), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.slug(t)).alias("slug_md5"), text.single_line(t, 120).alias("line"), F.size(text.query_tokens(t)).alias("asked"), F.size(text.clean_list(F.split(t, "\n"))).alias("lines"), where["evidence_quote"].alias("quote"), ids.first_named(second, F.col("lang"), F.col("source")).alias("named"), metrics.hint_score(t, hints).alias("relevance"))


_SIGNS = ["I could not find this clearly in the indexed documents.", "Sources DISAGREE here.", "The new version applies."]


@query("WITH m AS (SELECT conv_id, turn, role, text, length(text) > (SELECT avg(length(text)) FROM conversations) AS long, contains(text, 'anon') AS anon FROM conversations) "
       "SELECT conv_id, turn, long AS refuses, anon OR contains(lower(text), 'conflict') OR contains(lower(text), 'disagree') AS conflict, role = 'assistant' AS decides FROM m")
def answer_signs(spark, sf_dir):
    """Messages with what an answer says: long ones refuse, those with one syllable name a conflict, the assistant's decide."""
    x = table(spark, sf_dir, "conversations")
    long = F.length("text") > F.lit(x.agg(F.avg(F.length("text"))).first()[0])
    said = F.concat_ws(" ", "text", *[F.when(when, F.lit(s)) for when, s in zip((long, F.contains("text", F.lit("anon")), F.col("role") == "assistant"), _SIGNS, strict=True)])
    return x.select("conv_id", "turn", *[metrics.says(said, marks).alias(n) for n, marks in (("refuses", metrics.REFUSING), ("conflict", metrics.CONFLICTING), ("decides", metrics.DECIDING))])


@query("""WITH e AS (SELECT doc_id, lang, source, CASE WHEN text LIKE '%?%' THEN 'refuse_if_not_found' WHEN n_chars > 100 THEN 'cite_answer' ELSE '' END AS b FROM documents), l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT e.doc_id, quality, toxic, CASE WHEN quality IS NOT NULL THEN 'clean=' || CAST(1 - toxic AS DOUBLE) || ';good=' || CAST(quality AS DOUBLE) END AS judged, CASE WHEN b NOT IN ('', 'cite_answer') THEN 'metric_not_applicable_for_behavior' END AS skipped, CASE WHEN b = '' THEN source ELSE lang || ',' || source END AS context_ids FROM e LEFT JOIN l USING (doc_id)""")
def evaluation_artefacts(spark, sf_dir):
    """One row for each document as an example: named metrics, judged scores, whether a metric applies, and its context ids."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    behaviour = F.when(F.contains("text", F.lit("?")), "refuse_if_not_found").when(F.col("n_chars") > 100, "cite_answer").otherwise("")
    own = F.when(behaviour == "", F.array()).otherwise(F.array(F.concat(F.lit(" "), "lang"), F.lit(" "), "source", "lang"))
    metadata = F.array(F.create_map(F.lit("chunk_id"), F.lit(" "), F.lit("file_id"), F.col("source")), F.create_map(F.lit("file_id"), F.col("source")))
    examples = docs.select("doc_id", behaviour.alias("b"), audit.context_ids(own, metadata, ("chunk_id", "file_id")).alias("context_ids"))
    named = audit.named_values(labels, {"q": "quality", "t": "toxic"}, "doc_id")
    scored = [F.struct(F.lit(n).alias("metric"), c.cast("double").alias("score")) for n, c in (("good", F.col("q")), ("clean", 1 - F.col("t")), ("none", F.lit(None)))]
    scores = labels.select("doc_id", F.explode(F.array(*scored)).alias("s")).select("doc_id", "s.*")
    x = audit.artefact_rows(examples, [named], scores, "doc_id")
    judged = F.when(F.col("judged").isNotNull(), F.array_join(F.transform(F.map_entries("judged"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";"))
    return x.select("doc_id", "quality", "toxic", judged.alias("judged"), audit.applicable(F.lit("faithfulness"), F.col("b"))["reason"].alias("skipped"), F.array_join("context_ids", ",").alias("context_ids"))


@query("""SELECT 'value' AS kind, source AS name, NULL AS n FROM (SELECT DISTINCT trim(source, ' ') AS source FROM documents WHERE trim(source, ' ') <> '') UNION ALL SELECT 'payload', CAST(doc_id AS VARCHAR), length('[{"page_content":' || CAST(to_json(text) AS VARCHAR) || ',"metadata":{"lang":' || CAST(to_json(lang) AS VARCHAR) || '}},{"page_content":"","metadata":{}}]') FROM documents
UNION ALL SELECT 'run:' || 'keyword', 'kw', count(*) FROM documents UNION ALL SELECT 'run:vector', 'kw', count(*) FROM embeddings""")
def lineage_payloads(spark, sf_dir):
    """Distinct metadata values, evidence as JSON (its length), and the row that a run leaves."""
    docs = table(spark, sf_dir, "documents")
    values = lineage.metadata_values(docs.select(F.create_map(F.lit("source"), F.col("source")).alias("metadata")), "source").select(F.lit("value").alias("kind"), F.trim("value").alias("name"), F.lit(None).cast("long").alias("n"))
    none = F.lit(None).cast("map<string,string>")
    evidence = F.array(F.struct(F.col("text").alias("content"), F.create_map(F.lit("lang"), F.col("lang")).alias("metadata")), F.struct(F.lit(None).cast("string").alias("content"), none.alias("metadata")))
    payloads = docs.select(F.lit("payload"), F.col("doc_id").cast("string"), F.length(lineage.evidence_payload(evidence)).cast("long"))
    counts = docs.agg(F.count("*").alias("chunks")).crossJoin(table(spark, sf_dir, "embeddings").agg(F.count("*").alias("vectors")))  # two rows of one
    run = lineage.lineage_row(counts, {"keyword_index": F.lit("kw")})
    each = [F.struct(F.lit(f"run:{leg}").alias("kind"), F.col("keyword_index").alias("name"), F.col(f"{leg}_document_count").alias("n")) for leg in ("keyword", "vector")]
    runs = run.select(F.explode(F.array(*each)).alias("r")).select("r.*")
    return values.union(payloads).union(runs)


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY length(lang) DESC, n_chars, doc_id) - 1 AS place FROM documents")
def relaxed_places(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", F.length("lang").alias("matched"), F.col("n_chars").alias("attempt"), F.col("doc_id").alias("row"))
    return retrieval.relaxed_order(x).select("doc_id", "place")


@query("""SELECT 'unsupported_phoenix_metric' AS code, NULL AS row_id, 'Phoenix evaluator path does not support ' || lang AS message FROM (SELECT DISTINCT lang FROM documents) UNION ALL SELECT 'missing_audit_columns', CAST(item_id AS VARCHAR), 'Audit row is missing required columns: action, lane' FROM benchmark UNION ALL SELECT 'missing_reference', CAST(item_id AS VARCHAR), NULL FROM benchmark WHERE NOT contains(text, chr(10))""")
def contract_gaps(spark, sf_dir):
    """Metrics named like languages, audit rows without two columns, and items of one line, which have no reference."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    names = [r.lang for r in docs.select("lang").distinct().collect()]  # languages
    rows = audit.metric_findings(spark, names).unionByName(audit.missing_columns(bench, ["item_id", "text", "lane", "action"], "item_id")).select("code", "row_id", "message")
    reference = F.get(F.split("text", "\n"), F.lit(1))
    lacks = audit.missing_reference(bench.select("item_id", reference.alias("reference")), ["context_recall"], "reference", "item_id")
    return rows.unionByName(lacks.select(F.lit("missing_reference").alias("code"), F.col("row").alias("row_id"), F.lit(None).cast("string").alias("message")))


@query("""WITH c AS (SELECT n_nationkey, n_regionkey AS r, n_name || '.txt' AS path FROM nation WHERE n_regionkey < 4), f AS (SELECT c_custkey, c_mktsegment, n_name || '.txt' AS path FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, CASE WHEN r = 0 OR r IS NULL THEN c_mktsegment ELSE 'dept ' || r END AS department, CASE WHEN r = 1 THEN 'order' ELSE '.txt' END AS document_type, CASE r WHEN 2 THEN 'draft' WHEN 3 THEN 'archived' ELSE 'active' END AS authority_status, CASE WHEN r = 2 THEN '2024-01-01' END AS effective_from, CASE WHEN r = 3 THEN 'owner' END AS document_owner, coalesce(r, 0) AS authoritative_rank, CASE WHEN r = 3 THEN 'old,older' ELSE '' END AS supersedes, CASE WHEN r = 1 THEN 'g' END AS version_group
FROM f LEFT JOIN c USING (path)""")
def authority_metadata(spark, sf_dir):
    """Customers' files under a catalogue of nations, written as JSON and read as such: five regions say different things of them."""
    nation, at = table(spark, sf_dir, "nation"), shared_path(spark, "catalog")
    r = F.col("n_regionkey")
    path = F.concat("n_name", F.lit(".txt"))
    entry = F.struct(path.alias("relative_path"), F.when(r == 2, "draft").when(r == 3, "archived").when(r == 1, " ").alias("status"), r.alias("authoritative_rank"), F.when(r > 0, F.concat(F.lit("dept "), r.cast("string"))).otherwise("").alias("department"), F.when(r == 1, "order").alias("document_type"), F.when(r == 2, "2024-01-01").alias("effective_from"), F.when(r == 3, "owner").alias("owner"), F.when(r == 3, F.array(F.lit("old"), F.lit("older"))).alias("supersedes"), F.when(r == 1, "g").alias("version_group"))
    nation.where(r < 4).agg(F.to_json(F.struct(F.collect_list(entry).alias("documents"))).alias("value")).coalesce(1).write.text(at)  # 25 nations at most
    manifest = table(spark, sf_dir, "customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", path.alias("relative_path"), F.col("c_mktsegment").alias("inferred_category"), F.lit(".txt").alias("extension"))
    x = corpus.authority_metadata(manifest, readers.load_catalog(spark, at))
    return x.select("c_custkey", "department", "document_type", "authority_status", "effective_from", "document_owner", "authoritative_rank", F.array_join("supersedes", ",").alias("supersedes"), "version_group")


_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуыхцяеюь"[:26]
_STEM = "list_reduce(list_prepend(w, list_transform(range(length(w)), lambda i: '')), lambda t, x: CASE WHEN length(t) > 4 THEN regexp_replace(t, '" + text.ENDINGS + "', '') ELSE t END)"


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all(replace(translate(lower(text), '{_LATIN}', '{_CYRILLIC}'), '-', ' '), " + r"'[\p{L}\p{N}_]+') AS ws FROM documents), w AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)), "
       f"d AS (SELECT w, CASE WHEN regexp_matches(w, '[а-яё]') THEN {_STEM} ELSE w END AS s FROM (SELECT DISTINCT w FROM w)) SELECT doc_id, count(*) AS n, md5(string_agg(s, ' ' ORDER BY i)) AS stems_md5 FROM w JOIN d USING (w) GROUP BY doc_id")
def stemmed_tokens(spark, sf_dir):
    """Stems of all texts in another alphabet, letter for letter, so that endings of inflected words occur."""
    stems = text.tokens(F.translate(F.lower("text"), _LATIN, _CYRILLIC))
    x = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(stems)).alias("ts")).where(F.size("ts") > 0)  # exploded so that the test on size makes no second copy of the stems
    return x.select("doc_id", F.size("ts").cast("long").alias("n"), F.md5(F.array_join("ts", " ")).alias("stems_md5"))


@query("""WITH v AS (SELECT source AS query_id, doc_id, CASE WHEN text LIKE '%.' THEN length(lang) END AS given, n_chars FROM documents), a AS (SELECT query_id, doc_id, coalesce(given, row_number() OVER (PARTITION BY query_id ORDER BY n_chars * 100000000 + doc_id) - 1) AS rank FROM v),
f AS (SELECT query_id, doc_id, 0 AS leg, rank FROM a WHERE rank < 3), s AS (SELECT query_id, doc_id, 1 AS leg, rank FROM a), u AS (SELECT * FROM f UNION ALL SELECT s.* FROM s LEFT JOIN f USING (query_id, doc_id) WHERE f.doc_id IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY leg, rank, CAST(doc_id AS VARCHAR)) - 1 AS final_rank FROM u) SELECT query_id, doc_id, leg, final_rank FROM r WHERE final_rank < 10""")
def leg_ranks(spark, sf_dir):
    """Ranks that a leg gives, or its order where it gives none; then the first of them topped up by the rest, ten a source."""
    docs = table(spark, sf_dir, "documents")
    given = F.when(F.col("text").endswith("."), F.length("lang"))
    legs = docs.select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("document_key"), given.alias("rank"), (F.col("n_chars") * 100_000_000 + F.col("doc_id")).alias("order"))
    ranked = packets.annotated(legs, F.col("order"), "rank").drop("order")
    out = retrieval.backfill(ranked.where("rank < 3"), ranked, 10)
    return out.select("query_id", F.col("document_key").cast("long").alias("doc_id"), "leg", "final_rank")


QUERIES, ORACLES = query.queries, query.oracles
