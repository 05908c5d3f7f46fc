"""N-gram Jaccard join by an LSH forest of MinHash signatures, then exact Jaccard.

Every document has one label per tree, a run of MinHash values; a node of a tree is a prefix that labels share. Prefixes are as
long as the target recall for a pair at the threshold allows with all trees together: most documents meet there. Where a node
at that length is crowded, its documents keep whole labels in that tree and get further trees, as many as give the same recall
at whole labels, so work does not grow with the square of what many documents only partly share. A document thus has one of two
prefix lengths in each tree. Pairs that meet are weighed by all their MinHash values (pairs five
standard deviations below the threshold are dropped), then verified by their sets of shingles.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import components, mapped, stage
from quillmere.llm.links import compared, dealt, pair_blocks

TREES, DEPTH = 16, 6
PARTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def prefix_depth(similarity: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with chance `recall`."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


def further_trees(similarity: float, recall: float, values: int = TREES * DEPTH, depth: int = DEPTH) -> int:
    """How many trees, each over `depth` of the values drawn at random, make a pair at the threshold meet at whole labels with chance `recall`."""
    chance = [math.comb(values, k) * similarity**k * (1 - similarity) ** (values - k) for k in range(values + 1)]
    inside = [math.comb(k, depth) / math.comb(values, depth) for k in range(values + 1)]
    n = 1
    while sum(c * (1 - p) ** n for c, p in zip(chance, inside, strict=True)) > 1 - recall:
        n += 1
    return n


def mixed(columns: list[np.ndarray], salt: int) -> np.ndarray:
    """One number, never 0, from several for each row."""
    with np.errstate(over="ignore"):
        c = np.full(len(columns[0]), salt + 1, np.uint64) * PARTS[0]
        for v in columns:
            c = (c ^ v.astype(np.uint64)) * PARTS[1]
            c ^= c >> np.uint64(29)
    c[c == 0] = 1
    return c.view(np.int64)


class Shingler:
    """Sorted distinct hashes of the n-word shingles of texts; a text of fewer words is one shingle. Words are what white space parts, lower-cased."""

    def __init__(self, n: int) -> None:
        self.n = n

    def __call__(self, text: str | None) -> np.ndarray:
        return self._shingles(np.frombuffer(b"".join(map(xxhash.xxh64_digest, (text or "").lower().split())), ">u8").astype(np.uint64))

    def _shingles(self, h: np.ndarray) -> np.ndarray:
        n = min(self.n, h.size)
        if not n:
            return h
        with np.errstate(over="ignore"):
            x = np.zeros(h.size - n + 1, np.uint64)
            for i in range(n):
                x = (x ^ (h[i : h.size - n + 1 + i] * PARTS[i % len(PARTS)])) * np.uint64(0x9FB21C651E98DF25)
                x ^= x >> np.uint64(32)
        return np.unique(x)


class MinHasher:
    def __init__(self, count: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(1, 1 << 32, count, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)

    def __call__(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of MinHash values for each non-empty set."""
        x = np.concatenate(sets)
        x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), len(self.a)), np.uint32)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            out[:, i] = np.minimum.reduceat(x * a + b, starts)
        return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sorted sets share. Elements of few sets are counted by pairs, those of many by matrix products."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    df = np.diff(np.r_[first, len(flat)])
    out = np.zeros((m, m), np.float64)
    for c in range(2, 17):
        at = first[df == c]
        for i in range(0, len(at), 1 << 14):
            who = owner[at[i : i + (1 << 14), None] + np.arange(c)]
            for p in range(c):
                for q in range(c):
                    if p != q:
                        out += np.bincount(who[:, p] * m + who[:, q], minlength=m * m).reshape(m, m) if len(who) * 8 > m * m else 0
                        if len(who) * 8 <= m * m:
                            np.add.at(out, (who[:, p], who[:, q]), 1)
    wide = np.flatnonzero(df > 16)
    for i in range(0, len(wide), 4096):
        some = wide[i : i + 4096]
        dense = np.zeros((m, len(some)), np.float32)
        col = np.repeat(np.arange(len(some)), df[some])
        row = owner[np.concatenate([np.arange(first[k], first[k] + df[k]) for k in some])]
        dense[row, col] = 1
        out += dense @ dense.T
    return out


class Signed:
    """Rows by their MinHash values: pairs that may reach the threshold."""

    few = 24

    def __init__(self, x: pd.DataFrame, similarity: float) -> None:
        self.sig = np.stack([np.frombuffer(v, np.uint16) for v in x["sig"]])
        self.size, self.similarity = x["shingles"].to_numpy(), similarity
        n = self.sig.shape[1]
        self.enough = math.floor(n * similarity - 5 * math.sqrt(n * similarity * (1 - similarity)))

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        on = np.minimum(self.size[i], self.size[j]) >= self.similarity * np.maximum(self.size[i], self.size[j])
        for c in range(0, len(i), 1 << 13):
            part = slice(c, c + (1 << 13))
            on[part] &= (self.sig[i[part]] == self.sig[j[part]]).sum(1) >= self.enough
        return on

    def grid(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.stack([self.near(np.full(len(j), r), j) for r in i])


class Sets:
    """Rows by their sets of shingles: exact Jaccard similarity."""

    few = 6

    def __init__(self, x: pd.DataFrame, similarity: float) -> None:
        self.sets, self.similarity = [np.frombuffer(v, np.uint64) for v in x["set"]], similarity
        self.size = np.array([len(v) for v in self.sets], np.float64)
        self.held: tuple[int, int, np.ndarray] = (0, 0, np.zeros((0, 0)))

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.minimum(self.size[i], self.size[j]) >= self.similarity * np.maximum(self.size[i], self.size[j])
        for k in np.flatnonzero(out):
            both = np.sort(np.concatenate([self.sets[i[k]], self.sets[j[k]]]), kind="stable")
            shared = np.count_nonzero(both[1:] == both[:-1])
            out[k] = shared >= self.similarity * (len(both) - shared) - 1e-9
        return out

    def grid(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = int(i[0]), int(j[-1]) + 1
        if not (self.held[0] <= a and b == self.held[1]):  # rows of a group follow each other; all its tiles come from one count
            self.held = a, b, intersections(self.sets[a:b])
        a, _, both = self.held
        shared = both[np.ix_(i - a, j - a)]
        return shared >= self.similarity * (self.size[i][:, None] + self.size[j] - shared) - 1e-9


def _joined(docs: DataFrame, similarity: float = 0.8, n: int = 5, recall: float = 0.99998, crowd: int = 512, block: int = 512, block_shingles: int = 1 << 18, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, thash, key, class_id, n_links, component_id, kept) for every row of docs; thash: the text's hash, key: its set's, null if empty."""
    depth, hashes = prefix_depth(similarity, recall), TREES * DEPTH
    more = further_trees(similarity, recall)
    drawn = [np.random.default_rng([13, k]).permutation(hashes)[:DEPTH] for k in range(more)]

    def signer():
        shingle, sign = Shingler(n), MinHasher(hashes)

        def signed(texts: pa.Array) -> list:
            sets = list(map(shingle, texts.to_pylist()))
            on = [j for j, s in enumerate(sets) if s.size]
            key: list[bytes | None] = [None] * len(sets)
            sig: list[bytes | None] = [None] * len(sets)
            codes: list[np.ndarray | None] = [None] * len(sets)
            if on:
                mins = sign([sets[j] for j in on])
                c = np.stack([mixed([mins[:, t * DEPTH + d] for d in range(depth)], t) for t in range(TREES)], axis=1)
                short = mins.astype(np.uint16)
                for r, j in enumerate(on):
                    key[j], sig[j], codes[j] = hashlib.blake2b(sets[j].tobytes(), digest_size=16).digest(), short[r].tobytes(), c[r]
            return [key, [len(s) for s in sets], sig, codes]

        return signed

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("thash"))
    rows = stage(mapped(given, ["doc_id", "thash"], ["text"], "key binary, shingles long, sig binary, codes array<bigint>", signer), "signatures")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "thash"))
    reps = rows.where("key is not null").groupBy("key").agg(rep.alias("rep"), F.count("*").alias("same"), F.first("shingles").alias("shingles"), F.first("sig").alias("sig"), F.first("codes").alias("codes"))
    reps = stage(reps, "classes")

    nodes = reps.select("key", F.explode("codes").alias("code"))
    crowded = stage(nodes.groupBy("code").agg(F.count("*").alias("m")).where(F.col("m") > crowd).select("code"), "crowded")
    places = reps.select("key", "codes")
    if not crowded.isEmpty():  # their documents keep whole labels there, and get further trees
        gone = nodes.join(crowded, "code").groupBy("key").agg(F.collect_set("code").alias("gone"))  # a code for each tree at most

        def longer():
            def labels(sig: pa.Array) -> list:
                s = np.stack([np.frombuffer(v, np.uint16) for v in sig.to_pylist()])
                return [list(np.stack([mixed([s[:, v] for v in at], TREES + k) for k, at in enumerate(drawn)], axis=1))]

            return labels

        whole = mapped(gone.join(reps.select("key", "sig"), "key"), ["key", "gone"], ["sig"], "further array<bigint>", longer)
        left = F.transform("codes", lambda c: F.when(F.array_contains("gone", c), F.lit(0).cast("long")).otherwise(c))
        places = places.join(whole, "key", "left").select("key", F.when(F.col("gone").isNull(), F.col("codes")).otherwise(F.concat(left, "further")).alias("codes"))
        places = stage(places, "places")

    met = pair_blocks(places.select("key", F.explode("codes").alias("code")).where("code <> 0"), "code", "key", 8192)
    maybe = compared(met.join(reps.select("key", "sig", "shingles"), "key"), lambda x: Signed(x, similarity), "code", "key")
    maybe = components(maybe.select("a", "b"), "text-maybe").withColumnRenamed("id", "key")
    maybe = stage(dealt(maybe, places, block, "text").join(reps.select("key", "same", "shingles", "rep"), "key"), "text-maybe")

    def setter():
        shingle = Shingler(n)
        return lambda texts: [[shingle(t).tobytes() for t in texts.to_pylist()]]

    wanted = maybe.select("key", F.col("rep.doc_id").alias("d"), F.col("rep.thash").alias("h")).distinct()
    # what is wanted grows with the input, so it is never broadcast
    found = given.join(wanted.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("thash") == F.col("h")))
    found = stage(mapped(found.select("key", "text"), ["key"], ["text"], "set binary", setter).dropDuplicates(["key"]), "shingles")

    inside = pair_blocks(maybe.select("key", "grp", "t", "codes", "same", "shingles"), "grp", "key", block, "shingles", block_shingles)
    pairs = stage(compared(inside.join(found, "key"), lambda x: Sets(x, similarity), "grp", "key", "same"), "text-links")
    comp = components(pairs.select("a", "b"), "text").withColumnRenamed("id", "key")
    counts = pairs.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    comp = stage(comp.join(counts, "key", "left").select("key", "comp", F.coalesce("n", F.lit(0)).alias("n")), "text-components")
    least = comp.join(reps.select("key", "rep"), "key").groupBy("comp").agg(F.min("rep").alias("least"))
    classes = reps.select("key", "rep", "same").join(comp, "key", "left").join(least, "comp", "left")
    classes = classes.select("key", "rep", (F.col("same") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("least"))
    out = rows.select("doc_id", "thash", "key").join(classes, "key", "left")
    first = F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == F.col("least.doc_id")).otherwise(F.col("least.no") & (F.col("thash") == F.col("least.thash")))
    own = lambda c: F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col(c))
    kept, same_text = F.col("key").isNull() | F.coalesce(first, F.lit(False)), F.coalesce(F.col("least.thash") == F.col("thash"), F.lit(True))
    return out.select("doc_id", "thash", "key", own("rep.doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own("least.doc_id").alias("component_id"), kept.alias("kept"), same_text.alias("same_text"))


def jaccard_join(docs: DataFrame, **how) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, component_id, kept. `how`: see _joined.

    Documents with the same set of shingles form a class, named by its least doc_id; classes are compared once. n_links counts
    the other rows whose Jaccard similarity is at least `similarity`; component_id is the least doc_id reachable by links.
    kept: doc_id = component_id. Null, empty and blank texts have no shingles and link with nothing. A null doc_id takes part;
    it is kept where nothing that it reaches has an id, one text of them. Ids that repeat are rows of their own with their own
    texts; ids may be of any type that sorts. Other columns of docs are not looked at.
    """
    return _joined(docs, **how).select("doc_id", "class_id", "n_links", "component_id", "kept")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one document of each group of linked ones: that of the least doc_id (ids before null), then of the least hash of its text.

    Rows that repeat its id and text are left once. Documents without shingles (null, empty or blank texts) all stay. The
    columns of docs stay as they are, whatever their names.
    """
    found = _joined(docs, doc_id=doc_id, text=text, **how).where("kept and same_text").select("doc_id", "thash", F.col("key").isNotNull().alias("full"))
    kept = stage(found.groupBy("doc_id", "thash").agg(F.max(F.when(F.col("full"), F.lit(1)).otherwise(0)).alias("full"), F.count("*").alias("n")), "text-kept")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[doc_id].alias("d"), F.xxhash64(docs[text]).alias("h"))
    out = whole.join(kept.hint("merge"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("thash")))
    again = F.col("full") * F.col("n") > 1
    if kept.where(again).isEmpty():
        return out.select("row.*")
    return out.where(~again).select("row.*").union(out.where(again).dropDuplicates(["d", "h"]).select("row.*"))
