"""What both classifiers need: a bounded sample of labelled documents and a logistic model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import stage


def labelled(docs: DataFrame, labels: DataFrame, columns: list[str], most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """At most `most` labelled documents (doc_id, columns..., text, h), those whose ids hash least; equal texts once. Staged.

    Null ids and labels are left out. An id with several labels has the least of them; of equal texts the one whose id hashes
    least stays, so reruns agree. The sample of labels is bounded by `most`, so it is broadcast and the documents are read once
    without a shuffle. h: a hash of the id and text, by which rows have an order of their own.
    """
    one = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("i"), *columns).dropna()
    one = one.groupBy("i").agg(F.min(F.struct(*columns)).alias("y"))
    some = one.orderBy(F.xxhash64("i"), "i").limit(most).select("i", "y.*")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("i")).drop("i")
    row = F.struct(F.xxhash64("doc_id").alias("by"), "doc_id", *columns, "text")
    best = rows.groupBy(F.xxhash64("text").alias("same")).agg(F.min(row).alias("r")).select("r.doc_id", *[f"r.{c}" for c in columns], "r.text")
    return stage(best.withColumn("h", F.xxhash64("doc_id", "text")), "labelled")


class Logistic:
    """Logistic regression over sparse rows by accelerated gradient descent; classes weigh the same in total up to `balance`."""

    def __init__(self, size: int, l2: float = 1e-3, rounds: int = 150, balance: float = 0.5) -> None:
        self.size, self.l2, self.rounds, self.balance = size, l2, rounds, balance

    def fit(self, row: np.ndarray, col: np.ndarray, val: np.ndarray, dense: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """row, col, val: the sparse part; dense: further columns. Returns (weights, dense weights, bias)."""
        n = len(y)
        share = np.array([(y == 0).sum(), (y == 1).sum()], float)
        if not share.all():
            return np.zeros(self.size), np.zeros(dense.shape[1]), float(np.clip(np.log((share[1] + 0.5) / (share[0] + 0.5)), -8, 8))
        weight = (n / (2 * share))[y.astype(int)] ** self.balance
        weight /= weight.sum()
        x = lambda w: np.bincount(row, val * w[col], n) + dense @ w[self.size : -1] + w[-1]
        xt = lambda r: np.r_[np.bincount(col, val * r[row], self.size), dense.T @ r, r.sum()]
        v = np.ones(self.size + dense.shape[1] + 1)
        for _ in range(12):
            v = xt(weight * x(v / np.linalg.norm(v)))
        step = 1 / (np.linalg.norm(v) / 4 + self.l2)
        w = z = np.zeros_like(v)
        for k in range(self.rounds):
            p = 1 / (1 + np.exp(-np.clip(x(z), -30, 30)))
            g = xt(weight * (p - y)) + self.l2 * np.r_[z[:-1], 0]
            new = z - step * g
            z = new + k / (k + 3) * (new - w)
            w = new
        return w[: self.size], w[self.size : -1], float(w[-1])
