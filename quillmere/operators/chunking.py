"""Chunks by token count: tables in row windows under their header, other text by separators, with offsets and ids."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.functions import ids

TOKEN = re.compile(r"\w+|[^\w\s]")
SEPARATORS = ("\n\n", "\n", ". ", "; ", ": ", " - ", " ", "")


def count(text: str) -> int:
    return len(TOKEN.findall(text))


def row_windows(text: str, size: int) -> list[tuple[str, int, int]]:
    """(text, first row, last row) of a table: its header line and the rows between two cuts.

    Token counts are summed along the rows; a cut stands where the sum since the last one would outgrow what the header leaves
    of size. A row that is too long by itself stands alone. Tables of two rows or less, and those that fit, stay whole.
    """
    rows = [r.strip() for r in text.splitlines() if r.strip()]
    if len(rows) <= 2 or count(text) <= size:
        return [(text, 0, 0)]
    head, body = rows[0], rows[1:]
    total = [0, *accumulate(map(count, body))]
    cuts = [0]
    while cuts[-1] < len(body):
        fits = bisect_right(total, total[cuts[-1]] + size - count(head)) - 1
        cuts.append(max(fits, cuts[-1] + 1))
    return [("\n".join([head, *body[a:b]]), a + 2, b + 1) for a, b in pairwise(cuts)]


def _pieces(text: str, size: int, level: int = 0) -> Iterator[str]:
    """Parts that each fit, cut at the coarsest separator that does it; a separator stays with what follows it."""
    if count(text) <= size or level == len(SEPARATORS):
        yield text
        return
    sep = SEPARATORS[level]
    parts = list(text) if not sep else [p if not i else sep + p for i, p in enumerate(text.split(sep))]
    if len(parts) == 1:
        yield from _pieces(text, size, level + 1)
        return
    for p in parts:
        if p:
            yield from _pieces(p, size, level + 1)


def split(text: str, size: int = 400, overlap: int = 50) -> list[tuple[int, str]]:
    """(offset, chunk): consecutive pieces packed up to `size` tokens; the next chunk begins with the last pieces that fit `overlap`."""
    pieces, at = [], 0
    for p in _pieces(text, size):
        pieces.append((at, p, count(p)))
        at += len(p)
    out, have, used = [], [], 0
    for piece in pieces:
        if have and used + piece[2] > size:
            out.append(have)
            keep, n = [], 0
            for old in reversed(have):
                if n + old[2] > overlap or n + old[2] + piece[2] > size:
                    break
                keep.insert(0, old)
                n += old[2]
            have, used = keep, n
        have = [*have, piece]
        used += piece[2]
    if have:
        out.append(have)
    chunks = []
    for group in out:
        body = "".join(p for _, p, _ in group)
        if body.strip():
            chunks.append((group[0][0] + len(body) - len(body.lstrip()), body.strip()))
    return chunks


def build_chunks(docs: DataFrame, size: int = 400, overlap: int = 50) -> DataFrame:
    """Chunks of (file_id, relative_path, source_type, text): chunk_index runs on across the windows of a table. Each document is cut on its own, so there is no shuffle."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for r in x.itertuples(index=False):
                k = 0
                table = r.source_type in ("table", "sheet")
                for text, a, b in row_windows(r.text or "", size) if table else [(r.text or "", 0, 0)]:
                    where = f"body:1:header:1:rows:{a}-{b}" if a else "body:1"
                    for start, chunk in split(text, size, overlap):
                        rows.append((r.file_id, r.relative_path, r.source_type, k, where, start, count(chunk), chunk))
                        k += 1
            yield pd.DataFrame(rows, columns=["file_id", "relative_path", "source_type", "chunk_index", "base_locator", "body_start_index", "body_token_count", "text"])

    x = docs.select("file_id", "relative_path", "source_type", "text").mapInPandas(cut, "file_id string, relative_path string, source_type string, chunk_index int, base_locator string, body_start_index int, body_token_count int, text string")
    where = F.concat_ws(":chunk:", "base_locator", F.col("chunk_index").cast("string"))
    x = x.withColumn("source_locator", where)
    index, start = F.col("chunk_index").cast("string"), F.col("body_start_index").cast("string")
    return x.withColumns({"citation_id": ids.citation_id(F.col("relative_path"), F.col("source_type"), where, start, index), "chunk_id": ids.chunk_id(F.col("file_id"), F.col("source_type"), where, index, start, F.col("text"))})
