"""Best-fit decreasing packing of documents into windows of a fixed number of tokens.

Overlong documents are first cut into full windows. What best fit decreasing does depends on lengths alone, so it runs once
over the histogram of piece lengths, which has no more rows than a window has tokens: a segment tree indexed by remaining
capacity finds the tightest open windows, and all pieces of one length go into windows of one capacity in one step. The
steps say which ranks of a length go where; tasks look up each piece's rank. No group of pieces ever meets in one place.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from quillmere.llm.common import stage
from quillmere.llm.token_files import Encoder


class Capacities:
    """A segment tree over the remaining capacities 0 to most: how many open windows have each."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.windows = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.windows[i] += n
            i //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open window that is not below least."""
        i = least + self.size
        while not self.windows[i]:
            while i % 2:  # a right child has nothing to its right below its parent
                i //= 2
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.windows[2 * i] else 2 * i + 1
        return i - self.size


def placements(counts: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Steps (length, first rank, first window, pieces a window, offset) in order of length and rank, and the number of windows.

    A step's pieces fill its windows one after the other, each with the same number of pieces from the same offset on; it ends
    where the next step of its length begins.
    """
    tree, ranges, steps, made = Capacities(window), defaultdict(list), [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, n = window, -(-left // (window // length))
                ranges[room].append((made, n))
                tree.add(room, n)
                made += n
            first, n = ranges[room].pop()
            each = room // length
            full = min(n, left // each)
            used, per = (full, each) if full else (1, left)  # fewer pieces than one window takes: they all go into one
            steps.append((length, rank, first, per, window - room))
            if n > used:
                ranges[room].append((first + used, n - used))
            tree.add(room, -used)
            if room > per * length:
                ranges[room - per * length].append((first, used))
                tree.add(room - per * length, used)
            rank += used * per
            left -= used * per
    return sorted(steps), made


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, keep_ids: bool, doc_id: str, text: str) -> DataFrame:
    """A row for each piece, with its place `nth` among the pieces of its length in its part of the rows."""
    fields = [StructField("doc_id", docs.schema[doc_id].dataType), *StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, part long, nth long" + ", ids array<int>" * keep_ids)]
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = Encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for b in (x.slice(i, 32) for x in batches for i in range(0, x.num_rows, 32)):
            rows, of = [], []
            for k, data in enumerate(encode(b.column(1).to_pylist(), [end_id])):
                a = np.frombuffer(data, encode.kind).astype("<u4")
                for at in range(0, len(a), window):
                    some = a[at : at + window]
                    rows.append((at, len(some), zlib.crc32(some.tobytes()), len(a), part, int(seen[len(some)]), some)[: len(names) - 1])
                    seen[len(some)] += 1
                    of.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), *[pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds[1:], strict=True)]], names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, StructType(fields))


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, keep_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with keep_ids also ids, for each piece of each row.

    Every whole text is encoded and end_id appended; null texts count as empty and give the end id alone. A document of more
    than `window` tokens is cut into full windows and a rest. Rows that repeat an id, and null ids, are documents of their own.
    Pieces of equal length are alike to the packing; sequences are numbered from 0. No rows give no pieces.
    """
    cut = stage(pieces(docs, tokenizer, window, end_id, keep_ids, doc_id, text), "pack-pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    steps, _ = placements(counts, window)
    length, rank, first, per, offset = np.array(steps or np.zeros((0, 5)), np.int64).T
    keys = (length.astype(object) << 48 | rank.astype(object)).astype(np.int64)
    kept = [c for c in cut.columns if c not in ("part", "nth")]
    out = StructType([*[cut.schema[c] for c in kept], *StructType.fromDDL("sequence_id long, offset long")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, nth = (b.column(len(kept) - k).to_numpy(zero_copy_only=False) for k in (0, -1))
            s = np.searchsorted(keys, size << 48 | nth, side="right") - 1
            k = nth - rank[s]
            made = [first[s] + k // per[s], offset[s] + k % per[s] * size]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *map(pa.array, made)], out.names)

    ranked = cut.join(before, ["part", "length"]).select(*kept, F.col("length").alias("size"), (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, out)


def sequences(packed: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids): what pack gives with keep_ids, joined in order and padded to `window`, but not at a power of two."""
    joined = packed.groupBy("sequence_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("offset", "ids"))).getField("ids")).alias("ids"))  # a window's tokens
    n = F.size("ids")
    padding = F.when(F.bit_count(n) == 1, 0).otherwise(window - n)
    return joined.select("sequence_id", n.cast("long").alias("n_tokens"), F.concat("ids", F.array_repeat(F.lit(pad_id), padding)).alias("ids"))
