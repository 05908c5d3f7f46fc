"""Near-duplicate vectors by Euclidean p-stable hashing, then exact cosines.

Unit vectors are projected on Gaussian directions; each table's bucket is the tuple of quantised projections. Vectors that
share a bucket in any table are compared exactly. The numbers of projections and tables follow from the number of vectors
and from the share of links at the threshold that may be missed, so buckets stay small as the input grows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import components, mapped, stage
from quillmere.llm.links import compared, dealt, pair_blocks


def collision(distance: float, width: float) -> float:
    """The chance that one quantised Gaussian projection gives two points at this distance the same cell."""
    t = width / distance
    return 1 - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2)) - math.erfc(t / math.sqrt(2))


def plan(n: int, similarity: float, width: float, miss: float, stray: float) -> tuple[int, int]:
    """(projections, tables): unrelated vectors (at right angles) meet about `stray` times a table and vector; a link at the threshold is missed with chance `miss`."""
    far, near = collision(math.sqrt(2), width), collision(math.sqrt(2 - 2 * similarity), width)
    k = max(4, math.ceil(math.log(max(n, 2) / stray) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log1p(-(near**k)))


class Units:
    """Unit vectors, linked by exact cosines in double precision."""

    few = 24

    def __init__(self, x: pd.DataFrame, similarity: float) -> None:
        size = np.array([len(u) for u in x["unit"]]) // 8  # a bucket holds vectors of one size
        self.size, self.similarity = size, similarity
        self.at = np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(x["unit"]), np.float64)

    def _some(self, rows: np.ndarray) -> np.ndarray:
        return self.flat[self.at[rows][:, None] + np.arange(self.size[rows[0]])]

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), bool)
        for n in np.unique(self.size[i]):
            at = np.flatnonzero(self.size[i] == n)
            for c in range(0, len(at), 4096):
                k = at[c : c + 4096]
                out[k] = np.einsum("pd,pd->p", self._some(i[k]), self._some(j[k])) >= self.similarity
        return out

    def grid(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._some(i) @ self._some(j).T >= self.similarity


class Hasher:
    """For some vectors their class (label and components), unit vector and bucket in each table; nulls for those that link with nothing."""

    def __init__(self, k: int, tables: int, width: float, seed: int) -> None:
        self.k, self.tables, self.width, self.seed = k, tables, width, seed
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def _directions(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if size not in self.known:
            rng = np.random.default_rng([self.seed, size])
            n = self.tables * self.k
            self.known[size] = rng.standard_normal((size, n)), rng.uniform(0, self.width, n), rng.integers(1, 1 << 62, (self.tables, self.k), dtype=np.int64) | 1
        return self.known[size]

    def __call__(self, vectors: pa.Array, labels: pa.Array) -> list:
        n = len(vectors)
        key: list[bytes | None] = [None] * n
        unit: list[bytes | None] = [None] * n
        codes: list[np.ndarray | None] = [None] * n
        size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component is not a number
        at, label = np.cumsum(size) - size, labels.to_pylist()
        named = np.array([v is not None for v in label], bool)
        for d in np.unique(size[named & (size > 0)]):
            rows = np.flatnonzero(named & (size == d))
            raw = flat[at[rows][:, None] + np.arange(d)]
            good = np.isfinite(raw).all(1) & raw.any(1)
            rows, raw = rows[good], raw[good] + 0.0
            if not rows.size:
                continue
            directions, shift, mixing = self._directions(int(d))
            v = raw / np.abs(raw).max(1, keepdims=True)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            cells = np.floor((v @ directions + shift) / self.width).astype(np.int64).reshape(len(rows), self.tables, self.k)
            names = [f"{label[i]}\0{d}\0".encode() for i in rows]
            salt = np.array([np.frombuffer(hashlib.blake2b(s, digest_size=8).digest(), np.int64)[0] for s in names])
            with np.errstate(over="ignore"):
                c = (cells * mixing).sum(2) + np.arange(self.tables) * np.int64(0x1000193) * mixing[:, 0] + salt[:, None]
                c ^= c >> 29
                c *= np.int64(0x5851F42D4C957F2D)
            c[c == 0] = 1  # 0 stands for no bucket
            for j, i in enumerate(rows):
                key[i], unit[i], codes[i] = hashlib.blake2b(names[j] + raw[j].tobytes(), digest_size=16).digest(), v[j].tobytes(), c[j]
        return [key, unit, codes]


def near_vectors(vectors: DataFrame, similarity: float = 0.98, width: float = 2.0, miss: float = 1e-7, stray: float = 1.0, block: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", seed: int = 7) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors with equal non-null labels and as many components are linked when their cosine is at least `similarity`. Null, empty,
    zero or non-finite vectors and null labels link with nothing: n_links 0, component_id their own id. Rows with equal vectors
    are links of one another and are compared with the rest once. Repeated ids count as rows of their own; ids may be of any
    type that sorts, and a null id takes part but names no component that has another.
    """
    most = vectors.where(F.col(label).isNotNull()).groupBy(label).count().agg(F.max("count")).first()[0] or 0
    k, tables = plan(most, similarity, width, miss, stray)
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))
    rows = stage(mapped(given, ["vec_id"], ["embedding", "label"], "key binary, unit binary, codes array<long>", lambda: Hasher(k, tables, width, seed), 1024), "vectors")
    reps = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("same"), F.first("unit").alias("unit"), F.first("codes").alias("codes"))
    reps = stage(reps, "vector-classes")

    def units(x: pd.DataFrame) -> Units:
        return Units(x, similarity)

    met = pair_blocks(reps.select("key", F.explode("codes").alias("code")), "code", "key", block)
    edges = compared(met.join(reps.select("key", "unit"), "key"), units, "code", "key")
    comp = components(edges.select("a", "b"), "vectors").withColumnRenamed("id", "key")
    inside = pair_blocks(dealt(comp, reps.select("key", "codes"), block, "vectors"), "grp", "key", block)
    counted = compared(inside.join(reps.select("key", "unit", "same"), "key"), units, "grp", "key", "same")
    more = counted.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    comp = stage(comp.join(more, "key", "left").select("key", "comp", F.coalesce("n", F.lit(0)).alias("n")), "vector-links")
    least = comp.join(reps.select("key", "rep"), "key").groupBy("comp").agg(F.min("rep").alias("least"))
    classes = reps.select("key", "rep", "same").join(comp, "key", "left").join(least, "comp", "left")
    classes = classes.select("key", (F.col("same") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = rows.select("vec_id", "key").join(classes, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
