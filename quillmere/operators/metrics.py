"""Evaluation operators: ranking metrics, verdicts, failure classes, summaries, judge calibration, question and audit checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from quillmere.operators.corpus import ladder


def holding(texts: DataFrame, asked: DataFrame, words: int = 4) -> DataFrame:
    """(query_id, id): the documents (doc_id, text) that hold gold_start of (query_id, gold_start), white space taken as single blanks; both have words + 2 words at least.

    Each gold_start is known by the run of words from its second on. Runs are followed word by word through some texts at a
    time, all runs at once; only texts that hold a run are tested for what begins so. Nothing is shuffled.
    """
    runs: dict[tuple, list] = {}
    for r in asked.distinct().collect():
        runs.setdefault(tuple(r.gold_start.split(" ")[1 : 1 + words]), []).append((r.query_id, r.gold_start))
    names = list(dict.fromkeys(w for run in runs for w in run))
    place = {w: i for i, w in enumerate(names)}
    vocabulary = pa.array(names, pa.string())
    ids = np.array([[place[w] for w in run] for run in runs], np.int64).reshape(-1, words)
    code, steps = ids[:, 0], []
    for k in range(1, words):  # what a beginning and its next word give together
        known, code = np.unique(code * len(names) + ids[:, k], return_inverse=True)
        steps.append(known)
    wanted = dict(zip(code.tolist(), runs.values(), strict=True))
    schema = StructType([asked.schema["query_id"], StructField("id", texts.schema["doc_id"].dataType)])
    kind = to_arrow_type(schema["query_id"].dataType)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            flat = batch.column(1).flatten()
            upto = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            term = pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy().astype(np.int64)
            at = np.flatnonzero(term[: max(0, len(term) - words + 1)] >= 0)
            code = term[at]
            for k, known in enumerate(steps, 1):
                value = code * len(names) + term[at + k]
                code = np.minimum(np.searchsorted(known, value), len(known) - 1)
                same = (term[at + k] >= 0) & (known[code] == value)
                at, code = at[same], code[same]
            row = np.searchsorted(upto, at, "right")
            same = row == np.searchsorted(upto, at + words - 1, "right")
            found: tuple[list, list] = [], []
            last, t = -1, ""
            for r, c in sorted(set(zip(row[same].tolist(), code[same].tolist(), strict=True))):
                if r != last:
                    last, t = r, " ".join(batch.column(1)[r].as_py()).strip(" ")
                for q, start in wanted[c]:
                    if start in t:
                        found[0].append(q)
                        found[1].append(r)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], kind), batch.column(0).take(pa.array(found[1], pa.int64()))], ["query_id", "id"])

    if not runs:
        return asked.select("query_id").join(texts.select(F.col("doc_id").alias("id")), F.lit(False))
    return texts.where("doc_id is not null").select("doc_id", F.split("text", r"\s+").alias("ws")).mapInArrow(held, schema)


def id_metrics(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """Per query: hit, precision (over k), recall, mrr and ndcg at k. ranked: query_id, id, rank (0-based); gold: query_id, id. Queries without gold have no row."""
    n = gold.distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = ranked.where(F.col("rank") < k).join(gold.distinct(), ["query_id", "id"], "left_semi")
    h = hits.groupBy("query_id").agg(F.countDistinct("id").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 2)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(0), F.least("n_gold", F.lit(k)).cast("int") - 1), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 2))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    x = n.join(h, "query_id", "left")
    return x.select("query_id", (F.coalesce("found", F.lit(0)) > 0).alias("hit"), z(F.col("found") / k).alias("precision"), z(F.col("found") / F.col("n_gold")).alias("recall"), z(1 / (F.col("first") + 1)).alias("mrr"), z(F.col("dcg") / ideal).alias("ndcg"))


def own_ideal_ndcg(scored: DataFrame, k: int) -> DataFrame:
    """Per query hit, precision and ndcg at k where the ideal order is that of the query's own scores. scored: query_id, rank, score."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")) - 1
    x = scored.withColumn("best", best)
    at = lambda c: F.sum(F.when(F.col(c) < k, F.col("score") / F.log2(F.col(c) + 2)))
    got = x.groupBy("query_id").agg(at("rank").alias("dcg"), at("best").alias("ideal"), F.sum(F.when(F.col("rank") < k, (F.col("score") > 0).cast("int"))).alias("found"))
    return got.select("query_id", (F.col("found") > 0).alias("hit"), (F.col("found") / k).alias("precision"), F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))


def hint_score(text: Column, hints: Column) -> Column:
    """1 where the text holds any of the hints, whatever its case, else 0. Blank hints hold nowhere."""
    return F.when(F.exists(F.filter(hints, lambda h: F.trim(h) != ""), lambda h: F.contains(F.lower(text), F.lower(h))), 1.0).otherwise(0.0)


def citation_verdict(behaviour: Column, refused: Column, cited: Column, conflict: Column) -> Column:
    return F.when(behaviour == "refuse_if_not_found", refused & ~cited).when(behaviour == "cite_answer", cited & ~refused).when(behaviour == "surface_conflict", cited & conflict).otherwise(False)


# What an answer says when it refuses, names a conflict, or decides between versions.
REFUSING = ("I could not find this clearly in the indexed documents.", "не удалось найти", "не найдено", "нет в проиндексированных документах")
CONFLICTING = ("противореч", "конфликт", "disagree", "conflict")
DECIDING = ("действует новая", "действует стар", "действует только", "актуальна новая", "актуален новый", "единственная версия", "new version applies", "old version applies", "only valid version")


def says(answer: Column, marks: tuple[str, ...]) -> Column:
    """Whether an answer holds any of the marks, whatever its case; a null answer holds none."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m.lower())) for m in marks])


def failure_class(behaviour: Column, c: dict[str, Column], threshold: float = 0.5) -> Column:
    """The first reason for which a row failed, or null. Verdicts are three-valued: null is neither true nor false."""
    bad = lambda k: c[k].eqNullSafe(F.lit(False))
    not_cited = ~c["citation"].eqNullSafe(F.lit(True))
    low = lambda k: F.coalesce(c[k] < threshold, F.lit(False))
    return ladder(((behaviour == "refuse_if_not_found") & not_cited, "bad_refusal"), ((behaviour == "surface_conflict") & not_cited, "bad_conflict_handling"), ((behaviour == "cite_answer") & not_cited, "missing_citation"), ((behaviour == "surface_conflict") & bad("conflict"), "bad_conflict_handling"), (bad("id_hit"), "retrieval_miss"), (bad("hint_hit"), "retrieval_miss"), (bad("grounded"), "ungrounded_citation"), (bad("hinted"), "noisy_retrieval"), (low("faithfulness"), "ungrounded_answer"), (low("relevancy"), "irrelevant_answer"), (low("correctness"), "incorrect_answer"))


def pass_rates(rows: DataFrame, failure: str = "failure_class", single: tuple[str, ...] = ("lane",), multi: tuple[str, ...] = ("tags",)) -> DataFrame:
    """(dimension, value, total, passed, failed, pass_rate): overall, by each column and by each value of array columns. One scan: every row is emitted once for each of its values."""
    named = lambda m: lambda v: F.struct(F.lit(m).alias("dimension"), v.alias("value"))
    pairs = [F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("all").alias("value")))]
    pairs += [F.array(F.struct(F.lit(s).alias("dimension"), F.coalesce(s, F.lit("unknown")).alias("value"))) for s in single]
    pairs += [F.transform(F.when(F.size(m) > 0, F.array_distinct(F.col(m))).otherwise(F.array(F.lit("unknown"))), named(m)) for m in multi]
    x = rows.select(F.col(failure).alias("f"), F.explode(F.concat(*pairs)).alias("d")).select("f", "d.*")
    n, ok = F.count("*"), F.count_if(F.col("f").isNull())
    return x.groupBy("dimension", "value").agg(n.alias("total"), ok.alias("passed"), (n - ok).alias("failed"), F.round(ok / n, 4).alias("pass_rate"))


def calibration(rows: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """One row: confusion counts, accuracy, rates, Cohen's kappa and the gap of mean scores. rows: human (boolean), score (null counts as incorrect)."""
    p = F.coalesce(F.col("score") >= cutoff, F.lit(False))
    h = F.col("human")
    x = rows.agg(F.count_if(h & p).alias("tp"), F.count_if(~h & ~p).alias("tn"), F.count_if(~h & p).alias("fp"), F.count_if(h & ~p).alias("fn"), F.avg(F.when(h, F.col("score"))).alias("up"), F.avg(F.when(~h, F.col("score"))).alias("down"))
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    agreed = F.try_divide(F.col("tp") + F.col("tn"), n)
    chance = F.try_divide((F.col("tp") + F.col("fn")) * (F.col("tp") + F.col("fp")) + (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")), n * n)
    tpr, tnr = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return x.select("tp", "tn", "fp", "fn", agreed.alias("accuracy"), tpr.alias("tpr"), tnr.alias("tnr"), ((tpr + tnr) / 2).alias("balanced_accuracy"), F.when(n == 0, None).when(chance == 1, 1.0).otherwise((agreed - chance) / (1 - chance)).alias("kappa"), (F.col("up") - F.col("down")).alias("separation"))


BEHAVIOURS = ("cite_answer", "refuse_if_not_found", "surface_conflict")


def question_errors(rows: DataFrame) -> DataFrame:
    """(line, message) for every contract that a question breaks; the later of two rows with one id is the duplicate. rows: line, id, suite, question, expected_behavior, lane, reference_answer, tags."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    again = F.row_number().over(Window.partitionBy(F.trim("id")).orderBy("line")) > 1
    lanes = {"cite_answer": ["indexed_answerability", "known_missing_document_coverage"], "refuse_if_not_found": ["refusal_out_of_corpus_behavior", "known_missing_document_coverage"], "surface_conflict": ["conflict_version_behavior"]}
    any_lane = sorted({x for v in lanes.values() for x in v})
    wrong = reduce(lambda a, b: a | b, [(F.col("expected_behavior") == k) & ~F.col("lane").isin(v) for k, v in lanes.items()])
    x = rows.withColumn("again", again)
    checks = [(empty("id"), "missing id"), (~empty("id") & F.col("again"), "duplicate id"), (empty("suite"), "missing suite"), (empty("question"), "missing question"), (~F.coalesce(F.col("expected_behavior").isin(*BEHAVIOURS), F.lit(False)), "invalid expected_behavior"), (empty("lane"), "missing lane"), (~empty("lane") & ~F.col("lane").isin(any_lane), "invalid lane"), (F.col("lane").isin(any_lane) & wrong, "lane is not valid for expected_behavior"), (empty("reference_answer"), "missing reference_answer"), (F.exists("tags", lambda t: F.trim(t) == ""), "tags must be a list of non-empty strings")]
    return x.select("line", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in checks]))).alias("message"))


def lane_for(lane: Column, behaviour: Column, tags: Column) -> Column:
    missing = F.arrays_overlap(F.transform(tags, F.lower), F.array(*[F.lit(x) for x in ("known_missing_doc", "known-missing-doc", "missing_document", "needs_ingestion")]))
    return F.when(F.trim(lane) != "", F.trim(lane)).when(behaviour == "refuse_if_not_found", F.when(missing, "known_missing_document_coverage").otherwise("refusal_out_of_corpus_behavior")).when(behaviour == "cite_answer", "indexed_answerability").when(behaviour == "surface_conflict", "conflict_version_behavior").otherwise("unknown")


def hints_quality(hints: Column, resolved: Column, source: Column, candidates: Column) -> Column:
    """How well expected hints show: resolved and source are counts of hints held (source null: no source path)."""
    return ladder((F.size(hints) == 0, "not_required"), (F.coalesce(source, F.lit(0)) > resolved, "source_path_only"), (resolved > 0, "hit"), (candidates > 0, "candidate_only"), (source.isNotNull(), "source_path_only"), otherwise="missing")


def answer_quality(answer: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    # Phrases of reference answers that describe an answer instead of giving one.
    generic = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in ("ответ должен", "ответ должно", "должен ссылаться", "должна ссылаться", "должны быть взяты", "должен явно")])
    return F.when(text == "", "missing").when(generic, "generic_meta_reference").otherwise("evidence_shaped")


def indexed_status(lane: Column, current: Column, file_only: Column, unresolved: Column, candidates: Column, quality: Column, has_source: Column) -> Column:
    return ladder((lane == "refusal_out_of_corpus_behavior", "out_of_corpus"), (file_only > 0, "file_only_gold_ids"), (unresolved > 0, "unresolved_gold_ids"), ((current > 0) & (quality == "hit"), "indexed"), (has_source & (quality == "source_path_only"), "source_exists_not_indexed"), (candidates > 0, "candidate_indexed"), (current == 0, "missing_gold_ids"), otherwise="indexed")


def row_action(lane: Column, current: Column, resolved: Column, file_only: Column, unresolved: Column, candidates: Column, has_source: Column, answer: Column, quality: Column, quarantine: Column) -> Column:
    """struct(action, reason, backlog): what to do about an evaluation row."""
    to = lambda a, r, b: F.struct(F.lit(a).alias("action"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"), F.lit(b).alias("backlog"))
    keep = to("keep", "", "none")

    def gap(reason_here: str, reason_else: str) -> Column:
        return F.when(candidates > 0, to("rewrite", "", "gold_id_backfill")).when(has_source, to("needs_ingestion", reason_here, "missing_indexed_source")).otherwise(to("quarantine", reason_else, "row_contract"))

    mismatch = F.when(has_source, to("needs_ingestion", "gold_ids_do_not_match_hints", "missing_indexed_source")).otherwise(to("quarantine", "gold_ids_do_not_match_hints", "row_contract"))
    return ladder((F.coalesce(quarantine, F.lit("")) != "", to("quarantine", quarantine, "row_contract")), ((lane == "refusal_out_of_corpus_behavior") & (current == 0), keep), (file_only > 0, to("rewrite", "file_only_reference_context_ids", "chunk_id_migration")), (unresolved > 0, to("needs_ingestion", "unresolved_reference_context_ids", "missing_indexed_source")), ((current > 0) & quality.isin("source_path_only", "missing"), mismatch), ((lane == "conflict_version_behavior") & (resolved < 2), gap("missing_conflict_gold_ids", "missing_conflict_gold_ids")), ((lane == "indexed_answerability") & (resolved == 0), gap("missing_gold_id_for_existing_source", "missing_gold_id")), (answer == "generic_meta_reference", to("rewrite", "", "answer_key_rewrite")), otherwise=keep)
