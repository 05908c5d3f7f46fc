"""Groups of rows compared in blocks: no group is held whole, and no list of all pairs leaves a task.

A group of m rows is cut into blocks; each task sees one pair of blocks. It returns at most one edge for each row (a
spanning forest of the links it found) and, where links are counted, one number for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import grouped, stage

PAIRS = 1 << 17


class Rows(Protocol):
    """Some rows, ready to be compared."""

    few: int  # groups of at most so many rows are compared pair by pair, others by `grid`

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows (i[k], j[k]) are linked."""

    def grid(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The matrix of which rows i are linked to which rows j."""


def pair_blocks(rows: DataFrame, group: str, key: str, block: int, weight: str | None = None, most: int = 1) -> DataFrame:
    """rows of groups of two or more, with (bi, bj, b): each row goes to every pair of blocks that has its block b.

    A group has ceil(rows / block) blocks, or more so that a block's weight is about `most`.
    """
    size = rows.groupBy(group).agg(F.count("*").alias("m"), F.sum(F.col(weight) if weight else F.lit(0)).alias("w")).where("m > 1")
    nb = F.greatest(F.ceil(F.col("m") / block), F.least(F.col("m"), F.ceil(F.col("w") / most)), F.lit(1)).cast("int")
    x = rows.join(size.select(group, nb.alias("nb")), group).withColumn("b", F.pmod(F.xxhash64(key), "nb").cast("int"))
    return x.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("bi", F.least("b", "o")).withColumn("bj", F.greatest("b", "o")).drop("o", "nb")


def dealt(comp: DataFrame, codes: DataFrame, block: int, name: str) -> DataFrame:
    """comp's rows (key, comp) with the group that each is compared in: grp, t and codes.

    A component of m rows takes m^2 comparisons as a whole; within the buckets (key, codes: one for each table, 0 where that
    bucket is not used) that its rows share it takes the sum of their squares. A large component goes the cheaper way. By
    buckets, a pair is counted in the first table in which it shares one, so t and codes come along; t is -1 where a component
    is compared whole.
    """
    whole = comp.select("key", F.col("comp").alias("grp"), F.lit(-1).alias("t"), F.lit(None).cast("array<bigint>").alias("codes"))
    large = comp.groupBy("comp").agg(F.count("*").alias("m")).where(F.col("m") > 4 * block)
    if large.isEmpty():
        return whole
    rows = comp.join(large, "comp").join(codes, "key").select("key", "comp", "m", "codes", F.posexplode("codes").alias("t", "code")).where("code <> 0")
    work = rows.groupBy("comp", "m", "t", "code").agg(F.count("*").alias("c")).groupBy("comp", "m").agg(F.sum(F.col("c") * F.col("c")).alias("work"))
    cheap = stage(work.where(F.col("work") * 2 < F.col("m") * F.col("m")).select("comp"), f"{name}-cheap")
    apart = rows.join(cheap, "comp", "left_semi").select("key", F.concat("comp", F.encode(F.concat_ws(":", "t", "code"), "UTF-8")).alias("grp"), "t", "codes")
    return whole.join(cheap.withColumnRenamed("comp", "grp"), "grp", "left_anti").select("key", "grp", "t", "codes").union(apart)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the first row of its component under the links (i[k], j[k])."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return root
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]


def reached(rows: Rows, at: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the rows `at` as all their links would. A row is only compared with those that nothing has reached yet.

    side: the rows' blocks, where links within a block are looked for elsewhere.
    """
    left, a, b = np.ones(len(at), bool), [], []
    for s in range(len(at)):
        front = [s] if left[s] else []
        left[s] = False
        while front:
            k = front.pop()
            rest = np.flatnonzero(left if side is None else left & (side != side[k]))
            if not rest.size:
                continue
            new = rest[rows.grid(at[k : k + 1], at[rest])[0]]
            left[new] = False
            front += new.tolist()
            a += [at[k]] * len(new)
            b += at[new].tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def first_shared(codes: pd.Series, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of rows the first table in which both have the same bucket."""
    table = np.zeros((len(codes), max(map(len, codes))), np.int64)
    for k, c in enumerate(codes):
        table[k, : len(c)] = c
    out = np.empty(len(i), np.int64)
    for c in range(0, len(i), 1 << 14):
        p, q = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
        out[c : c + len(p)] = ((table[p] == table[q]) & (table[p] != 0)).argmax(1)
    return out


def over_blocks(rows_of: Callable[[pd.DataFrame], Rows], group: str, key: str, count: str | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For mapInPandas over pair_blocks' rows sorted by (group, bi, bj, key): rows (a, b, n).

    Rows of the same block are compared in (b, b) only. a is a row's key, b the key of the first row of its component here, n
    the sum of `count` over what it is linked to; rows without links give nothing.
    """

    def frame(x: pd.DataFrame) -> pd.DataFrame:
        g, bi, bj = x[group].to_numpy(), x["bi"].to_numpy(), x["bj"].to_numpy()
        cut = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])])
        size = np.diff(np.r_[cut, len(x)])
        stop, block = np.repeat(cut + size, size), x["b"].to_numpy()
        rows = rows_of(x)
        few = np.flatnonzero(np.repeat((size > 1) & (size <= rows.few), size))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(1, rows.few):
            few = few[few + d < stop[few]]
            if not few.size:
                break
            for c in range(0, len(few), PAIRS):
                i = few[c : c + PAIRS]
                i = i[(bi[i] == bj[i]) | (block[i] != block[i + d])]
                on = rows.near(i, i + d) if i.size else np.zeros(0, bool)
                found.append((i[on], i[on] + d))
        for a, m in zip(cut[size > rows.few], size[size > rows.few], strict=True):
            at = np.arange(a, a + m)
            side = block[at] if bi[a] != bj[a] else None
            if count is None:
                found.append(reached(rows, at, side))
                continue
            for c in range(0, m, 256):
                adj = rows.grid(at[c : c + 256], at[c:])
                i, j = np.nonzero(np.triu(adj, 1) if side is None else np.triu(adj, 1) & (side[c : c + 256, None] != side[c:]))
                found.append((at[c + i], at[c + j]))
        i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
        n = np.zeros(len(x))
        if count and len(i):
            w, p, q = x[count].to_numpy().astype(np.float64), i, j
            if "t" in x and (x["t"] >= 0).any():
                own = x["t"].to_numpy()[i]
                at = np.unique(np.r_[i[own >= 0], j[own >= 0]])
                mine = own < 0
                mine[own >= 0] = first_shared(x["codes"].iloc[at], np.searchsorted(at, i[own >= 0]), np.searchsorted(at, j[own >= 0])) == own[own >= 0]
                p, q = i[mine], j[mine]
            n = np.bincount(p, w[q], len(x)) + np.bincount(q, w[p], len(x))
        root = roots(len(x), i, j)
        on = np.unique(np.r_[i, j])
        keys = x[key].to_numpy()
        return pd.DataFrame({"a": keys[on], "b": keys[root[on]], "n": n[on].astype(np.int64)})

    return grouped(frame, [group, "bi", "bj"])


def compared(rows: DataFrame, rows_of: Callable[[pd.DataFrame], Rows], group: str, key: str, count: str | None = None) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()
    together = rows.repartition(group, "bi", "bj").sortWithinPartitions(group, "bi", "bj", key)  # so the same rows lead a component in many groups
    return together.mapInPandas(over_blocks(rows_of, group, key, count), f"a {kind}, b {kind}, n long")
