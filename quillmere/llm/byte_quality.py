"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into chunks of 256 that overlap by the filters' reach; the last chunk is padded. Each filter adds
one learned number for each of eight bytes in a row; a chunk keeps each filter's maximum. A second kind of channel says how
much of each 32 bytes equals what stands the same few bytes earlier, whatever the bytes are. Chunks are combined by maximum
and mean into one logistic output, so every byte of the document counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import mapped
from quillmere.llm.training import labelled

WIDTH, CHUNK, BLOCK, FILTERS = 8, 256, 32, 12
LAGS = range(2, 18)
REACH = max(LAGS)


def chunks(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of chunks with the reach before and after, which document each is of); an empty text has one chunk of zeros."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    n = [max(1, -(-len(b) // CHUNK)) for b in data]
    rows = np.zeros((sum(n), REACH + CHUNK + WIDTH), np.uint8)
    at = 0
    for b, k in zip(data, n, strict=True):
        one = np.zeros(REACH + k * CHUNK + WIDTH, np.uint8)
        one[REACH : REACH + len(b)] = np.frombuffer(b, np.uint8)
        rows[at : at + k] = np.lib.stride_tricks.sliding_window_view(one, REACH + CHUNK + WIDTH)[:: CHUNK][:k]
        at += k
    return rows, np.repeat(np.arange(len(texts)), n)


def repeats(rows: np.ndarray) -> np.ndarray:
    """For each chunk the largest and the mean share, over blocks, of bytes that equal those some lag earlier (the best lag of each block)."""
    core = rows[:, REACH : REACH + CHUNK]
    best = np.zeros((len(rows), CHUNK // BLOCK), np.uint8)
    for d in LAGS:
        same = (core == rows[:, REACH - d : REACH - d + CHUNK]) & (core != 0)
        np.maximum(best, np.add.reduce(same.reshape(len(rows), -1, BLOCK).view(np.uint8), 2, dtype=np.uint8), out=best)
    return np.c_[best.max(1), best.mean(1)] / BLOCK


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    weights: np.ndarray
    bias: float
    centre: np.ndarray
    scale: np.ndarray

    def pairs(self) -> list[np.ndarray]:
        """Tables by two bytes at once: half the look-ups."""
        return [(self.filters[o][:, None, :] + self.filters[o + 1][None, :, :]).reshape(1 << 16, FILTERS).astype(np.float32) for o in range(0, WIDTH, 2)]


def convolve(rows: np.ndarray, tables: list[np.ndarray], where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Each filter's maximum over each chunk and, if wanted, its place."""
    out = np.empty((len(rows), FILTERS), np.float32)
    place = np.empty((len(rows), FILTERS), np.int64) if where else None
    for i in range(0, len(rows), 128):
        some = rows[i : i + 128]
        part = some[:, REACH:-1].astype(np.uint16) << 8 | some[:, REACH + 1 :]
        x = np.take(tables[0], part[:, :CHUNK], axis=0)
        for k in range(1, len(tables)):
            x += np.take(tables[k], part[:, 2 * k : 2 * k + CHUNK], axis=0)
        out[i : i + 128] = x.max(1)
        if where:
            place[i : i + 128] = x.argmax(1)
    return out, place


def pooled(per_chunk: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Maximum and mean over each document's chunks."""
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    n = np.diff(np.r_[first, len(doc)])[:, None]
    return np.c_[np.maximum.reduceat(per_chunk, first), np.add.reduceat(per_chunk, first) / n]


def train(texts: list[str], y: np.ndarray, epochs: int = 6, least_steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 3) -> Network:
    """Adam on the logistic loss; classes weigh the same in total. Small samples are gone through more often, for least_steps in all."""
    rng = np.random.default_rng(seed)
    size = 2 * (FILTERS + 2)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)), np.zeros(size), 0.0, np.zeros(size), np.ones(size))
    if not len(y) or y.min() == y.max():
        net.bias = 4.0 * (2 * float(y[0]) - 1) if len(y) else 0.0
        return net
    net.weights = rng.normal(0, 0.3, size)
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.filters, net.weights, np.zeros(1))]
    data = [chunks(texts[i : i + 1])[0] for i in range(len(texts))]
    reps = [repeats(r) for r in data]
    step = 0
    epochs = max(epochs, -(-least_steps * batch // len(y)))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            rows = np.concatenate([data[k] for k in at])
            n = np.array([len(data[k]) for k in at])
            doc = np.repeat(np.arange(len(at)), n)
            top, place = convolve(rows, net.pairs(), True)
            act = np.tanh(top)
            per = np.c_[act, np.concatenate([reps[k] for k in at])]
            x = pooled(per, doc)
            p = 1 / (1 + np.exp(-np.clip(x @ net.weights + net.bias, -30, 30)))
            g = (p - y[at]) * share[at] / len(at)
            gx = g[:, None] * net.weights
            gper = (gx[:, FILTERS + 2 :] / n[:, None])[doc][:, :FILTERS]
            gper += np.where(act == x[doc, :FILTERS], gx[doc, :FILTERS], 0)
            gtop = gper * (1 - act**2)
            gf = np.zeros_like(net.filters)
            r, f = np.nonzero(np.abs(gtop) > 1e-9)
            for o in range(WIDTH):
                np.add.at(gf[o], (rows[r, REACH + place[r, f] + o], f), gtop[r, f])
            step += 1
            lr = rate * (1 - epoch / epochs)
            for param, grad, (m, v) in zip((net.filters, net.weights, None), (gf, x.T @ g + 1e-4 * net.weights, np.array([g.sum()])), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.005 * (grad**2 - v)
                change = lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.995**step)) + 1e-8)
                if param is None:
                    net.bias -= float(change[0])
                else:
                    param -= change
    return net


def predict(net: Network, tables: list[np.ndarray], texts: list[str | None]) -> np.ndarray:
    rows, doc = chunks(texts)
    per = [np.c_[np.tanh(convolve(part, tables)[0]), repeats(part)] for part in (rows[i : i + 2048] for i in range(0, len(rows), 2048))]
    x = pooled(np.concatenate(per), doc)
    return 1 / (1 + np.exp(-np.clip(x @ net.weights + net.bias, -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, label: Column, learn: Column, most: int = 5000, most_chars: int = 20_000_000) -> Network:
    """From at most `most` labelled rows (and most_chars characters in all) for which `learn` holds, a condition on labels.

    Rows without an id or a label are left out (see labelled). Without rows, or with one label only, every score is the same.
    Reruns give the same network.
    """
    rows = labelled(docs, labels.where(learn).select("doc_id", label.cast("int").alias("y")), ["y"], most)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if total > most_chars:  # whole documents, as many as fit on average
        rows = rows.orderBy("h").limit(max(1, int(rows.count() * most_chars / total)))
    data = rows.select("h", "text", "y").toPandas().sort_values("h")
    return train(list(data["text"]), data["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) for every row of docs, from its whole text; null texts count as empty, which is scored like any other."""

    def scorer():
        tables = net.pairs()

        def scored(values) -> list:
            texts, out, some, size = values.to_pylist(), [], [], 0
            for k, t in enumerate(texts):
                some.append(t)
                size += len(t or "")
                if size > 500_000 or k + 1 == len(texts):
                    out.append(predict(net, tables, some))
                    some, size = [], 0
            return [np.concatenate(out)]

        return scored

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, ["doc_id"], ["text"], "score double", scorer, 512)
