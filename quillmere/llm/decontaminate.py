"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answers.

Terms are the words of the benchmark; words outside it count only by their mass. Passages of documents and the benchmark's
items make a TF-IDF matrix whose leading right singular vectors come from a randomised SVD: every partition multiplies its own
passages with one random test matrix, the products are summed by term, and a small factorisation (Nystrom's, for the Gram
matrix) ends it. Items are searched in blocks; a block's own vectors always span a part of its latent space, so none is lost in
it. Windows of several lengths are compared with the items by inner products in that space; a window is checked word by word
where its product with an item is at least what the least share of the item's words must give, so that nothing that the rule
accepts is passed over. Products are whole numbers, rounded up, so no order of summation can lose a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmere.llm.common import chosen, mapped, stage

WORDS = re.compile(r"\w+")
PASSAGE, CHUNK = 32, 8
MORE = 16  # dimensions of the latent space beyond those that the items span
BLOCKS = 4  # blocks of items that a task searches at once
SHORT = 5  # items of fewer words are found where all their words stand side by side


@dataclass
class Item:
    item_id: object
    words: list[int]
    answer: list[int]


def answer_of(text: str) -> str:
    """Where no answer is given: the last clause of the item, five words at least."""
    parts = [p for p in re.split(r"[.!?;:,\n]+", text) if p.strip()]
    for i in range(len(parts) - 1, -1, -1):
        if len(WORDS.findall(" ".join(parts[i:]))) >= 5:
            return " ".join(parts[i:])
    return text


def lcs(words: list[int], text: np.ndarray, rows: dict[int, int]) -> int:
    """Length of the longest common subsequence; rows has, for each word, the bits of its places in `words`."""
    full = (1 << len(words)) - 1
    v = full
    for w in text:
        m = rows.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(words) - v.bit_count()


def places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def in_passages(ids: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term, count) of the known terms of many documents: ids of all, first place of each; passages don't cross documents."""
    n = np.diff(np.r_[starts, len(ids)])
    inside = np.arange(len(ids)) - np.repeat(starts, n)
    per = -(-n // width)
    passage = np.repeat(np.cumsum(np.r_[0, per[:-1]]), n) + inside // width
    on = ids >= 0
    key, count = np.unique(passage[on] << 32 | ids[on], return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count


class Gram:
    """The sum of x x' over passages x scaled to length 1, its lower half: dense for few terms, else as sorted pairs of terms."""

    DENSE, MOST = 1 << 23, 1 << 22

    def __init__(self, size: int) -> None:
        self.size, self.keys, self.values, self.held = size, [], [], 0
        self.first = np.arange(size + 1, dtype=np.int64) * np.arange(1, size + 2) // 2  # of each row in the dense half
        self.dense = np.zeros(self.first[-1]) if self.first[-1] <= self.DENSE else None

    def add(self, passage: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Terms ascend within a passage."""
        if not len(passage):
            return
        first = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
        count = np.diff(np.r_[first, len(passage)])
        weight = weight / np.sqrt(np.repeat(np.add.reduceat(weight * weight, first), count))
        for k in np.unique(count):  # at most as many as a passage has words
            at = first[count == k, None] + np.arange(k)
            t, w = term[at], weight[at]
            row, col = np.tril_indices(k)
            value = (w[:, row] * w[:, col]).ravel()
            if self.dense is not None:
                np.add.at(self.dense, (self.first[t[:, row]] + t[:, col]).ravel(), value)
            else:
                self.keys.append((t[:, row] * self.size + t[:, col]).ravel())
                self.values.append(value)
                self.held += len(value)
        if self.held > 2 * self.MOST:
            self._sum()

    def _sum(self) -> None:
        if self.keys:
            key, back = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.keys, self.values, self.held = [key], [np.bincount(back, np.concatenate(self.values))], 0

    def times(self, test: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, their rows of the product with test)."""
        z, seen = np.zeros((self.size, test.shape[1])), np.zeros(self.size, bool)
        if self.dense is not None:
            seen = self.dense[self.first[1:] - 1] > 0
            for i in range(0, self.size, 256):
                n = min(256, self.size - i)
                rows = np.zeros((n, i + n))
                for k in range(n):
                    rows[k, : i + k + 1] = self.dense[self.first[i + k] : self.first[i + k + 1]]
                z[i : i + n] += rows @ test[: i + n]
                rows[np.arange(n), i + np.arange(n)] = 0
                z[: i + n] += rows.T @ test[i : i + n]
        else:
            self._sum()
            key, value = (self.keys[0], self.values[0]) if self.keys else (np.zeros(0, np.int64), np.zeros(0))
            row, col = key // max(1, self.size), key % max(1, self.size)
            cut = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
            for a, b in zip(cut, [*cut[1:], len(row)], strict=len(row) > 0):
                r, c, v = row[a], col[a:b], value[a:b]
                z[r] += v @ test[c]
                z[c] += np.where(c != r, v, 0)[:, None] * test[r]
                seen[r] = True
        on = np.flatnonzero(seen)
        return on, z[on]


def _read(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    some = [np.frombuffer(b, np.int32) for b in blobs]
    return np.concatenate(some).astype(np.int64), np.cumsum([0, *map(len, some[:-1])])


@dataclass
class Searcher:
    """A block of benchmark items, ready to be looked for in one document after another."""

    local: np.ndarray  # the block's number of each term of the benchmark, -1 where the block has no such term
    items: list[Item]  # by length; in the block's numbers
    short: list[Item]
    basis: np.ndarray
    latent: np.ndarray  # the items in the latent space
    idf: np.ndarray
    copied: float
    paraphrased: float
    answered: float

    def __post_init__(self) -> None:
        self.masks = [(places(it.words), places(it.answer)) for it in self.items]
        # what each term adds to the inner product with each item; the last row is of other words
        product = ((self.basis * self.idf[:, None]) @ self.latent.T).clip(0)
        scale = 4000 / max(product.max(initial=0), 1e-9)  # a chunk's sum stays within 16 bits
        self.against = np.concatenate([np.ceil(product * scale - 0.01), np.zeros((1, len(self.items)))]).astype(np.int16)
        size = np.array([len(it.words) for it in self.items], np.int64)
        # The least product of an accepted window: it has so many of the item's words, and these may be those of least weight.
        self.share = least = np.ceil(min(self.copied, self.paraphrased) * size - 1e-9).astype(int)
        weight = [np.sort(self.idf[it.words] ** 2)[:m].sum() for it, m in zip(self.items, least, strict=True)]
        self.least = np.floor(np.array(weight) * (1 - 1e-4) * scale).astype(np.int32)
        # windows, in chunks, that hold a stretch of twice the item's length wherever in its first chunk it begins
        self.chunks = -(-2 * size // CHUNK) + 1  # rises, as items are sorted by length
        self.windows = [(int(k), slice(*np.searchsorted(self.chunks, [k, k + 1]).tolist())) for k in np.unique(self.chunks)]
        self.count = np.zeros((len(self.idf) + 1, len(self.items)), np.int16)  # of each term in each item
        for j, it in enumerate(self.items):
            np.add.at(self.count[:, j], it.words, 1)
        self.runs: dict[int, dict[int, list[int]]] = {}  # of short items: by length and key
        for j, it in enumerate(self.short):
            self.runs.setdefault(len(it.words), {}).setdefault(int(self._key(np.array([it.words]))[0]), []).append(j)

    @staticmethod
    def _key(words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(words.shape[1]):
                out = (out ^ words[:, k].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
                out ^= out >> np.uint64(29)
        return out

    def near(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, item, start) for every window that comes near an item; ids of some documents, first place of each.

        A window begins at a multiple of CHUNK. A term counts once in a chunk, with all its places in the item, and a window may
        reach into the next document; both only raise the product. In windows that pass, a term counts once.
        """
        size = np.diff(np.r_[first, len(ids)])
        count = -(-size // CHUNK)
        base = np.cumsum(count) - count
        doc = np.repeat(np.arange(len(first)), count)
        inside = (np.arange(len(doc)) - base[doc]) * CHUNK
        start, stop = first[doc] + inside, (first + size)[doc]
        most = max(k for k, _ in self.windows)
        for i in range(0, len(doc), 2048):
            part = slice(i, i + 2048 + most)
            at = start[part, None] + np.arange(CHUNK)
            some = np.sort(np.where(at < stop[part, None], ids[np.minimum(at, len(ids) - 1)], -1), axis=1)
            some[:, 1:][some[:, 1:] == some[:, :-1]] = -1
            sums = self.against[some[:, 0]]
            for k in range(1, CHUNK):
                sums += self.against[some[:, k]]
            total = np.zeros((len(self.items), 2049 + most), np.int32)
            np.cumsum(sums.T, axis=1, dtype=np.int32, out=total[:, 1 : len(sums) + 1])
            total[:, len(sums) + 1 :] = total[:, len(sums), None]
            n = min(2048, len(doc) - i)
            for k, of in self.windows:
                items, rows = np.nonzero(total[of, k : k + n] - total[of, :n] >= self.least[of, None])
                for c in range(0, len(rows), 4096):
                    row, j = i + rows[c : c + 4096], items[c : c + 4096] + of.start
                    at = start[row, None] + np.arange(k * CHUNK)
                    seen = np.sort(np.where(at < stop[row, None], ids[np.minimum(at, len(ids) - 1)], -1), axis=1)
                    seen[:, 1:][seen[:, 1:] == seen[:, :-1]] = -1
                    enough = self.count[seen, j[:, None]].sum(1) >= self.share[j]
                    yield from zip(doc[row[enough]].tolist(), j[enough].tolist(), inside[row[enough]].tolist(), strict=True)

    def side_by_side(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, short item) for every run of a short item's words."""
        doc = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
        for n, known in self.runs.items():
            if len(ids) < n:
                continue
            grams = np.lib.stride_tricks.sliding_window_view(ids, n)
            for at in np.flatnonzero(np.isin(self._key(grams), np.array(list(known), np.uint64)) & (doc[: len(grams)] == doc[n - 1 :])):
                for j in known.get(int(self._key(grams[at : at + 1])[0]), ()):
                    if self.short[j].words == grams[at].tolist():
                        yield int(doc[at]), j

    def cosine(self, ids: np.ndarray, j: int) -> float:
        """The best cosine with the item, in the latent space, of windows of the item's length; words that no item has do not count."""
        best, n = 0.0, len(self.items[j].words)
        for s in range(0, max(1, len(ids) - n + 1), max(1, n // 4)):
            t, c = np.unique(ids[s : s + n], return_counts=True)
            x = (c * self.idf[t] * (t >= 0)) @ self.basis[t]
            best = max(best, float(x @ self.latent[j]) / max(1e-9, np.linalg.norm(x) * np.linalg.norm(self.latent[j])))
        return min(best, 1.0)

    def hits(self, blobs: list[np.ndarray]) -> list[dict[object, tuple[float, float, float]]]:
        """For each document, given by its words in the benchmark's numbers, the items that it holds: (cosine, shared, answer_shared) by id."""
        out: list[dict[object, tuple[float, float, float]]] = [{} for _ in blobs]
        full = [d for d, x in enumerate(blobs) if len(x)]
        if not full or not (self.items or self.short):
            return out
        ids = np.concatenate([blobs[d] for d in full]).astype(np.int64)
        ids = np.where(ids >= 0, self.local[ids], -1)
        size = np.array([len(blobs[d]) for d in full])
        first = np.cumsum(size) - size
        for k, j in self.side_by_side(ids, first):
            out[full[k]][self.short[j].item_id] = 1.0, 1.0, 1.0
        found: dict[tuple[int, int], tuple[float, float, int]] = {}
        for k, j, a in self.near(ids, first) if self.items else ():
            it, (rows, answer) = self.items[j], self.masks[j]
            n, words = len(it.words), ids[first[k] : first[k] + size[k]]
            last = max(0, len(words) - 2 * n)
            if a > last or found.get((k, j), (0.0, 0.0))[:2] == (1.0, 1.0) or lcs(it.words, words[a : a + int(self.chunks[j]) * CHUNK].tolist(), rows) < self.share[j]:
                continue
            for s in range(a, min(a + CHUNK, last + 1)):
                some = words[s : s + 2 * n].tolist()
                shared = lcs(it.words, some, rows)
                if shared >= self.share[j]:
                    got = shared / n, lcs(it.answer, some, answer) / max(1, len(it.answer)), s
                    if got[0] >= self.copied or got[0] >= self.paraphrased and got[1] >= self.answered:
                        found[k, j] = max(found.get((k, j), got), got)
        for (k, j), (shared, answered, s) in found.items():
            words = ids[first[k] : first[k] + size[k]]
            out[full[k]][self.items[j].item_id] = self.cosine(words[s : s + 2 * len(self.items[j].words)], j), shared, answered
        return out


def coded(terms: dict[str, int], text: str | None) -> np.ndarray:
    """Numbers of the words of a whole text; words that no item has are -1."""
    return np.fromiter(map(terms.get, WORDS.findall((text or "").lower()), repeat(-1)), np.int32)


def contaminated(docs: DataFrame, items: DataFrame, items_at_once: int = 4000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, rank: int = 256, **how) -> DataFrame:
    """(doc_id, item_id, cosine, shared, answer_shared) for every document and item of which the document holds a passage.

    shared is the longest common subsequence over the item's words, answer_shared the same for the answer. A pair is returned
    when shared >= copied, or shared >= paraphrased and answer_shared >= answered (see fit), in a stretch of twice the item's
    length, wherever it begins; the figures are those of the best such stretch. cosine is that of the stretch in the latent
    space. An item of fewer than five words is held where all its words stand side by side; null or blank items give no pairs;
    a null id takes part; rows that repeat a doc_id give one pair with the best figures. The benchmark's words and items are
    held by the driver and by each task; it is searched in blocks of no more than the latent space's rank can span.
    """
    rows, _, searchers = fit(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), _bench(items, item_id, item_text, answer), max(1, min(items_at_once, rank - MORE)), rank, **how)
    kind = items.schema[item_id].dataType
    out = None
    for some in _groups(searchers):

        def search(batches: Iterator[pa.RecordBatch], some: list[Searcher] = some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 128):
                    part = batch.slice(i, 128)
                    blobs = [np.frombuffer(b, np.int32) for b in part.column(1).to_pylist()]
                    found = [(d, k, *v) for s in some for d, hits in enumerate(s.hits(blobs)) for k, v in hits.items()]
                    at, item, *figures = zip(*found, strict=True) if found else ((),) * 5
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(item, to_arrow_type(kind)), *(pa.array(v, pa.float64()) for v in figures)], ["doc_id", "item_id", "cosine", "shared", "answer_shared"])

        got = rows.mapInArrow(search, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {kind.simpleString()}, cosine double, shared double, answer_shared double")
        out = got if out is None else out.union(got)
    best = out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max(F.struct("shared", "answer_shared")).alias("s"))
    return best.select("doc_id", "item_id", "cosine", "s.shared", "s.answer_shared")


def drop_contaminated(docs: DataFrame, items: DataFrame, items_at_once: int = 4000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None, rank: int = 256, **how) -> DataFrame:
    """docs without the rows that hold a passage of an item, as contaminated says; null, empty and blank texts hold none. The other columns stay as they are."""
    _, terms, searchers = fit(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), _bench(items, item_id, item_text, answer), max(1, min(items_at_once, rank - MORE)), rank, **how)
    out, groups = docs, _groups(searchers)
    for k, some in enumerate(groups):

        def clean(some: list[Searcher] = some):
            def keep(texts: pa.Array) -> list[bool]:
                blobs = [coded(terms, t) for t in texts.to_pylist()]
                held = [s.hits(blobs) for s in some]
                return [not any(h[d] for h in held) for d in range(len(blobs))]

            return keep

        out = chosen(out, text, clean)
        if k + 1 < len(groups):
            out = stage(out, "decontaminated")
    return out


def _bench(items: DataFrame, item_id: str, item_text: str, answer: str | None) -> DataFrame:
    return items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("t"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("a"))


def _groups(searchers: list[Searcher]) -> list[list[Searcher]]:
    return [searchers[i : i + BLOCKS] for i in range(0, len(searchers), BLOCKS)]


def fit(docs: DataFrame, bench: DataFrame, block: int, rank: int, copied: float = 0.8, paraphrased: float = 0.6, answered: float = 0.8, common: float = 0.05, seed: int = 5) -> tuple[DataFrame, dict[str, int], list[Searcher]]:
    """(the documents' words as numbers, staged; the numbers; a searcher for each block) from all passages of docs (doc_id, text) and the items (item_id, t, a).

    Every term has a positive weight, however common it is. Terms in more than `common` of all passages are left out of the sketch
    of the passages only; the items' own vectors, which span the latent space with them, hold all their terms.
    """
    raw = [(r[0], WORDS.findall(r[1].lower()), WORDS.findall((r[2] or answer_of(r[1])).lower())) for r in bench.collect()]
    raw = sorted((r for r in raw if r[1]), key=lambda r: (len(r[1]), str(r[0]), r[1]))
    terms = {w: i for i, w in enumerate(sorted({w for _, a, b in raw for w in [*a, *b]}))}
    size = len(terms)
    things = [Item(i, [terms[w] for w in a], [terms[w] for w in b]) for i, a, b in raw]

    def coder():
        return lambda texts: [[coded(terms, t).tobytes() for t in texts.to_pylist()]]

    rows = stage(mapped(docs, ["doc_id"], ["text"], "ids binary", coder), "passages").where(F.length("ids") > 0)

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, passages = np.zeros(size, np.int64), 0
        for x in frames:
            for i in range(0, len(x), 512):
                ids, starts = _read(list(x["ids"].iloc[i : i + 512]))
                passages += int((-(-np.diff(np.r_[starts, len(ids)]) // PASSAGE)).sum())
                df += np.bincount(in_passages(ids, starts, PASSAGE)[1], minlength=size)
        on = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[-1, on], "n": np.r_[passages, df[on]]})

    words = rows.select("ids")
    sums = {r[0]: r[1] for r in words.mapInPandas(seen, "term long, n long").groupBy("term").agg(F.sum("n")).collect()} if size else {}
    total = sums.get(-1, 0) + len(things)
    df = np.array([sums.get(t, 0) for t in range(size)], float)
    for it in things:
        df[list(set(it.words))] += 1
    idf = np.log((1 + total) / (1 + np.minimum(df, total))) + 1
    sketch = df <= max(common * total, 8)
    r = max(1, min(size, rank, len(things) + MORE))
    test = np.random.default_rng(seed).standard_normal((size, r))

    def sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = Gram(size)
        for x in frames:
            for i in range(0, len(x), 512):
                ids, starts = _read(list(x["ids"].iloc[i : i + 512]))
                p, t, c = in_passages(ids, starts, PASSAGE)
                keep = sketch[t]
                gram.add(p[keep], t[keep], (1 + np.log(c[keep])) * idf[t[keep]])
        on, z = gram.times(test)
        yield pd.DataFrame({"term": on, "z": pd.Series(list(z), dtype=object)})

    z = np.zeros((size, r))
    if size:
        parts = words.mapInPandas(sketched, "term long, z array<double>")
        parts = parts.groupBy("term").agg(*[F.sum(F.get("z", F.lit(k))).alias(f"z{k}") for k in range(r)])
        for row in parts.toLocalIterator():  # a row for each term of the benchmark
            z[row[0]] = row[1:]
    long = [it for it in things if len(it.words) >= SHORT]
    cuts = [long[i : i + block] for i in range(0, len(long), block)] or [[]]
    spaces = [_space(some, idf) for some in cuts]
    mine = np.zeros((size, r))
    for at, own in spaces:
        unit = own / np.linalg.norm(own, axis=1, keepdims=True)
        mine[at] += unit.T @ (unit @ test[at])
    z += max(1.0, np.linalg.norm(z) / max(np.linalg.norm(mine), 1e-9)) * mine  # the items' rows weigh as much as all passages, so the leading vectors tell them apart
    leading = _leading(z, test)
    short = [it for it in things if len(it.words) < SHORT]
    searchers = []
    for some, (at, own) in zip(cuts, spaces, strict=True):
        spare, own_terms = (short if not searchers else []), at
        if spare:
            own_terms = np.union1d(at, np.array([t for it in spare for t in it.words], np.int64)).astype(np.int64)
        local = np.full(size, -1, np.int64)
        local[own_terms] = np.arange(len(own_terms))
        wide = np.zeros((len(some), len(own_terms)))
        wide[:, local[at]] = own
        basis = _with(wide, leading[own_terms], max(r, len(some)))
        here = lambda its: [Item(it.item_id, local[it.words].tolist(), [int(local[t]) for t in it.answer]) for it in its]  # noqa: B023, E731
        searchers.append(Searcher(local, here(some), here(spare), basis.astype(np.float32), wide @ basis, idf[own_terms], copied, paraphrased, answered))
    return rows, terms, searchers


def _space(items: list[Item], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the terms of the items and their answers, the items' TF-IDF rows over them)."""
    at = np.unique(np.array([t for it in items for t in [*it.words, *it.answer]], np.int64))
    own = np.zeros((len(items), len(at)))
    for k, it in enumerate(items):
        t, c = np.unique(it.words, return_counts=True)
        own[k, np.searchsorted(at, t)] = c * idf[t]
    return at, own


def _leading(z: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Leading eigenvectors of a positive Gram matrix G from z = G @ test."""
    if not z.size or not z.any():
        return np.zeros((z.shape[0], 1))
    shift = 1e-8 * np.linalg.norm(z)
    y = z + shift * test
    values, vectors = np.linalg.eigh((test.T @ y + y.T @ test) / 2)
    keep = values > values.max() * 1e-10
    u, s, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return u[:, s > s[0] * 1e-6]


def _with(own: np.ndarray, leading: np.ndarray, r: int) -> np.ndarray:
    """An orthonormal basis of the space of own's rows, then what the leading vectors add to it, r columns at most."""
    if not len(own):
        return leading[:, :r]
    _, s, v = np.linalg.svd(own, full_matrices=False)
    mine = v[s > 1e-9 * max(s.max(initial=0.0), 1e-300)].T
    rest = leading - mine @ (mine.T @ leading)
    u, s, _ = np.linalg.svd(rest - mine @ (mine.T @ rest), full_matrices=False)
    return np.concatenate([mine, u[:, s > 1e-6][:, : max(0, r - mine.shape[1])]], axis=1)
