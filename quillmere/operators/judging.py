"""Judged metrics of answers: faithfulness, relevancy, recall and correctness by a judge that is called with bounded concurrency."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import providers

# What each metric needs of a row, and the reason that a row without it is skipped for.
NEEDS = {
    "faithfulness": (("user_input", "response", "retrieved_contexts"), "missing_response_or_contexts"),
    "answer_relevancy": (("user_input", "response"), "missing_user_input_or_response"),
    "context_recall": (("user_input", "retrieved_contexts", "reference"), "missing_reference_or_contexts"),
    "factual_correctness": (("response", "reference"), "missing_response_or_reference"),
}
WORD = re.compile(r"\w+")

Judge = Callable[[str, str, str, Sequence[str], str], float | None]


def overlap_judge() -> Judge:
    """The default judge: the share of distinct words of one text that stand in another one."""

    def words(*texts: str) -> set[str]:
        return {w for t in texts for w in WORD.findall(t.lower())}

    def judge(metric: str, question: str, answer: str, contexts: Sequence[str], reference: str) -> float:
        pairs = {"faithfulness": (words(answer), words(*contexts)), "answer_relevancy": (words(question), words(answer)), "context_recall": (words(reference), words(*contexts)), "factual_correctness": (words(answer), words(reference))}
        said, known = pairs[metric]
        if not said:
            raise ValueError("nothing to judge")
        return len(said & known) / len(said)

    return judge


def judged(rows: DataFrame, metrics: Sequence[str], start: Callable[[], Judge] = overlap_judge, in_flight: int = 8, retries: int = 2, seconds: float = 60.0, pause: float = 0.1) -> DataFrame:
    """(id, metric, score, label, reason, attempts): a row for each row and metric.

    rows: id, user_input, response, retrieved_contexts (array), reference. Rows that lack what a metric needs are skipped and
    the judge is not asked; blank contexts don't count. label is scored, skipped or failed; a judge's null, NaN or infinite
    score is scored without a number. The error of a judge that fails or is late is the row's reason.
    """
    if unknown := sorted(set(metrics) - set(NEEDS)):
        raise ValueError(f"unsupported metrics: {', '.join(unknown)}")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    x = rows.select("id", *[blank(c).alias(c) for c in ("user_input", "response", "reference")], F.filter(F.transform(F.coalesce("retrieved_contexts", F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "").alias("retrieved_contexts"))
    lacks = lambda c: (F.size(c) == 0) if c == "retrieved_contexts" else (F.col(c) == "")
    each = []
    for m in metrics:
        needs, why = NEEDS[m]
        missing = lacks(needs[0])
        for c in needs[1:]:
            missing |= lacks(c)
        each.append(F.struct(F.lit(m).alias("metric"), F.when(missing, why).alias("skip")))
    x = x.withColumn("m", F.explode(F.array(*each))).select("*", "m.*").drop("m")

    def begin() -> Callable[..., float | None]:
        judge = start()

        def ask(skip: str | None, metric: str, question: str, answer: str, contexts: list[str], reference: str) -> float | None:
            if skip is not None:
                return None
            score = judge(metric, question, answer, contexts, reference)
            return float(score) if score is not None and math.isfinite(score) else None

        return ask

    got = providers.called(x, ["skip", "metric", "user_input", "response", "retrieved_contexts", "reference"], "score", "double", begin, in_flight, retries, seconds, pause)
    label = F.when(F.col("skip").isNotNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("scored")
    return got.select("id", "metric", "score", label.alias("label"), F.coalesce("skip", "error").alias("reason"), F.when(F.col("skip").isNotNull(), 0).otherwise(F.col("attempts")).alias("attempts"))
