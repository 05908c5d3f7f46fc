"""Toxicity by a classifier chain of linear models over words, word beginnings and runs of signs.

Categories are predicted one after the other; each model also sees the earlier categories' probabilities. In training those
come from models that did not see the row (out of fold). Features are words, their first three to eight letters and runs of
signs, chosen by counts over the labelled sample.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import Remembered, chosen, mapped
from quillmere.llm.training import Logistic, labelled

WORDS = re.compile(r"\w+|[^\w\s]+")
BEGINNINGS = range(3, 9)


def features(word: str) -> list[str]:
    return [f"w:{word}", *(f"{k}:{word[:k]}" for k in BEGINNINGS if len(word) >= k)]


def labels_categories() -> dict[str, Column]:
    """The chain for the table labels: it has one toxicity label; the first category is low quality, which it also marks."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    models: list[tuple[np.ndarray, np.ndarray, float]]

    def score(self, found: list[list[int]]) -> np.ndarray:
        """A row of probabilities for each document, given by its features."""
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        col = np.array([c for f in found for c in f], np.int64)
        out = np.empty((len(found), len(self.models)))
        for k, (w, d, b) in enumerate(self.models):
            x = np.bincount(row, w[col], len(found)) + b
            if k:
                x += logit(out[:, :k]) @ d
            out[:, k] = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return out


class Finder:
    """The known features of texts. What a word stands for is remembered."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.known = Remembered(lambda ws: [tuple(vocabulary[x] for x in features(w) if x in vocabulary) for w in ws])

    def __call__(self, text: str | None) -> list[int]:
        out: set[int] = set()
        out.update(*filter(None, self.known(list(set(WORDS.findall((text or "").lower()))))))
        return sorted(out)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], most: int = 20_000, most_features: int = 4096, least_count: int = 8, least_z: float = 6.0, folds: int = 3) -> Chain:
    """A chain over categories (name: 0/1 column of labels), in their order, from at most `most` labelled documents.

    Rows without an id or a label are left out (see labelled); a null text counts as empty. Without labelled rows, or without
    both labels of a category, its model is a constant: its rate among them, or next to nothing. Reruns give the same chain.
    """
    names = list(categories)
    rows = labelled(docs, labels.select("doc_id", *[c.cast("int").alias(n) for n, c in categories.items()]), names, most)
    total = rows.agg(F.count("*"), *[F.sum(n) for n in names]).first()
    if not total[0]:
        return Chain(names, {}, [(np.zeros(0), np.zeros(k), -8.0) for k in range(len(names))])

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        hits = [Counter() for _ in names]
        for x in frames:
            for t, *y in zip(x["text"], *[x[c] for c in names], strict=True):
                f = {f for w in set(WORDS.findall(t.lower())) for f in features(w)}
                n.update(f)
                for h, on in zip(hits, y, strict=True):
                    if on:
                        h.update(f)
        keys = list(n)
        yield pd.DataFrame({"feature": keys, "n": [n[k] for k in keys]} | {f"n{i}": [h[k] for k in keys] for i, h in enumerate(hits)})

    parts = rows.mapInPandas(counted, "feature string, n long" + "".join(f", n{i} long" for i in range(len(names))))
    sums = parts.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))]).where(F.col("n") >= least_count)
    share = [(total[i + 1] or 0) / total[0] for i in range(len(names))]
    z = F.greatest(*[(F.col(f"n{i}") - F.col("n") * p) / F.sqrt(F.col("n") * max(p * (1 - p), 1e-9)) for i, p in enumerate(share)], F.lit(0.0))
    best = sums.select("feature", z.alias("z")).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(most_features).collect()
    vocabulary = {r[0]: i for i, r in enumerate(best)}

    def finder():
        find = Finder(vocabulary)
        return lambda texts: [[np.array(find(t), np.int32) for t in texts.to_pylist()]]

    data = mapped(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds)).cast("int")), ["h", "fold", *names], ["text"], "f array<int>", finder)
    data = data.toPandas().sort_values("h", ignore_index=True)  # bounded by `most`
    size = [len(f) for f in data["f"]]
    row, col = np.repeat(np.arange(len(data)), size), np.concatenate([np.asarray(f, np.int64) for f in data["f"]]) if sum(size) else np.zeros(0, np.int64)
    fold = data["fold"].to_numpy()
    model, val = Logistic(len(vocabulary)), np.ones(len(row))
    earlier, models = np.zeros((len(data), 0)), []
    for k, name in enumerate(names):
        y = data[name].to_numpy(np.float64)
        models.append(model.fit(row, col, val, earlier, y))
        out = np.zeros(len(data))
        for f in range(folds if k + 1 < len(names) else 0):
            on = fold != f
            at = np.cumsum(on) - 1
            keep = on[row]
            w, d, b = model.fit(at[row[keep]], col[keep], val[keep], earlier[on], y[on])
            x = np.bincount(row, w[col], len(data)) + earlier @ d + b
            out[~on] = 1 / (1 + np.exp(-np.clip(x[~on], -30, 30)))
        earlier = np.c_[earlier, logit(out)]
    return Chain(names, vocabulary, models)


def score_chain(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and p_<category> for every row of docs, from its whole text. Null and empty texts have no features and get the models' base rates."""

    def scorer():
        find = Finder(chain.vocabulary)
        return lambda texts: list(chain.score([find(t) for t in texts.to_pylist()]).T)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, ["doc_id"], ["text"], ", ".join(f"p_{c} double" for c in chain.categories), scorer)


def drop_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs without the rows whose probability of category reaches threshold; other columns stay as they are. Null and empty texts are judged by the base rate."""
    k = chain.categories.index(category)

    def clean():
        find = Finder(chain.vocabulary)

        def keep(texts: pa.Array) -> list[bool]:
            return (chain.score([find(t) for t in texts.to_pylist()])[:, k] < threshold).tolist()

        return keep

    return chosen(docs, text, clean)
