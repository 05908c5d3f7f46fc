"""Removal of passages that an earlier document has, by merged Burrows-Wheeler transforms.

Every string of 50 bytes has a minimiser, the least hash of its 27 substrings of 24 bytes, so equal strings meet where their
minimisers do and corpora are parted by minimiser without losing a match. Minimisers that only one document has are
dropped. Around the others, the text over which one minimiser holds is a segment; a bucket of minimisers gets its distinct
segments, each once, with the least and the greatest id that holds it.

In a bucket, shards of segments are transformed one by one: for every depth, what stands before the shard's suffixes in the
order of that many symbols (at each depth only the suffixes that some start of 50 bytes reaches are kept). The shards are then
merged: their interleave, a shard's number for each suffix, is refined depth by depth by the symbols that the transforms list,
without sorting suffixes of different shards against each other. Common prefixes of neighbours follow; runs that share all 50
symbols are the repeated intervals, and each interval's least document id says from which id on its bytes go. Nothing is removed that
no interval says; segments of one document that cannot share 50 bytes with another are left out beforehand.

Documents are shuffled once, in batches by a hash; all else travels in packed arrays, a row for each batch and bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import ordinals

LENGTH, GRAM = 50, 24
WINDOW = LENGTH - GRAM + 1
PLACE = np.uint64((1 << 28) - 1)
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes: a batch of documents, a bucket, a partition, documents worked on at once, a piece of a long document, a merge. And shards a merge.
BATCH, BUCKET, PARTITION, CHUNK, PIECE, MERGE, SHARDS = 4 << 20, 8 << 20, 16 << 20, 1 << 16, 1 << 26, 2 << 20, 2
#: In place of a minimiser's place: the string is looked at by itself.
ALONE = 255
#: Bytes before and after a minimiser: 26 shared bytes, of which 6 k or more lie before it, reach at least this far on both sides.
AROUND = [(b, max(0, LENGTH - GRAM - b - 5)) for b in range(0, LENGTH - GRAM + 1, 6)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * M1
    x ^= x >> np.uint64(31)
    return x


def segments(docs: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, minimiser's 48-bit hash, its place, first and last start of a 50-byte string that has it, document) in order of the text."""
    flat = b"".join(docs)
    n = len(flat)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return flat, none.astype(np.uint64), none, none, none, none
    words = np.ndarray((n - GRAM + 1 + 16,), "<u8", flat + bytes(8), 0, (1,))
    m = n - GRAM + 1
    with np.errstate(over="ignore"):
        h = _mix(words[:m].copy())
        h ^= words[8 : 8 + m]
        h = _mix(h)
        h ^= words[16 : 16 + m]
        h *= M2
        h ^= h >> np.uint64(32)
        h *= M1
    low = (h & ~PLACE) | np.arange(m, dtype=np.uint64)
    step = 1
    while step * 2 <= WINDOW:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[: n - LENGTH + 1], low[WINDOW - step : WINDOW - step + n - LENGTH + 1])
    size = np.array([len(d) for d in docs])
    doc = np.repeat(np.arange(len(docs)), size)
    start = np.flatnonzero(doc[: n - LENGTH + 1] == doc[LENGTH - 1 :])
    at = (low[start] & PLACE).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else none
    return flat, h[at[cut]] >> np.uint64(16), at[cut], start[cut], start[np.r_[cut[1:] - 1, len(start) - 1]] if len(cut) else none, doc[start[cut]]


def _rows(x: pd.DataFrame) -> tuple[list[int | None], list[bytes]]:
    """A batch's (id, bytes) in an order that its rows alone decide."""
    both = sorted(zip(x["no"].tolist(), x["id"].tolist(), map(bytes, x["data"]), strict=True))
    return [None if no else i for no, i, _ in both], [t for _, _, t in both]


def _chunked(ids: list[int | None], texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], tuple]]:
    """Documents that have an id and 50 bytes, some at a time: (place in the batch, offset, size) of each piece, segments.

    A very long document comes in pieces; they overlap by 49 bytes, so that each string of 50 bytes begins in one of them.
    """
    at, some, size = [], [], 0
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        if i is None or len(t) < LENGTH:
            continue
        for o in range(0, len(t) - LENGTH + 1, PIECE):
            piece = t if len(t) <= PIECE else t[o : o + PIECE + LENGTH - 1]
            if at and size + len(piece) > CHUNK:
                yield at, segments(some)
                at, some, size = [], [], 0
            at.append((k, o, len(piece)))
            some.append(piece)
            size += len(piece)
    if at:
        yield at, segments(some)


def _owners(ids: list[int | None], at: list[tuple[int, int, int]], doc: np.ndarray) -> np.ndarray:
    return np.array([ids[k] for k, _, _ in at], np.int64)[doc]


def _minimisers(ids: list[int | None], chunks: list[tuple[list, tuple]], buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, sorted hashes, for each 0 if one id of this batch has it, else 1 + the binary logarithm of how often it occurs)."""
    hashes, owners = [], []
    for at, (_, h, _, _, _, doc) in chunks:
        hashes.append(h)
        owners.append(_owners(ids, at, doc))
    if not hashes:
        return []
    h, o = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h)
    h, o = h[order], o[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    often = 1 + np.log2(np.diff(np.r_[first, len(h)])).astype(np.uint8)
    shared = np.where(np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first), often, 0).astype(np.uint8)
    h = h[first]
    bucket = (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, h, shared = bucket[order], h[order], shared[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return [(int(bucket[a]), h[a:b], shared[a:b]) for a, b in zip(cut, [*cut[1:], len(h)], strict=True)]


def _six(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def symbols(text: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(what begins at each place: as many symbols as 16 bits hold, packed; for each depth, from a window's end to its start, the offset and the bits to drop)."""
    values = np.flatnonzero(np.bincount(text, minlength=256))
    bits = max(1, int(len(values) - 1).bit_length())
    dense = np.zeros(256, np.uint16)
    dense[values] = np.arange(len(values))
    per = 16 // bits
    padded = np.r_[dense[text], np.zeros(per, np.uint16)]
    packed = np.zeros(len(text), np.uint16)
    for i in range(per):
        packed = packed << np.uint16(bits) | padded[i : i + len(text)]
    return packed, [(o, bits * max(0, o + per - LENGTH)) for o in range(0, LENGTH, per)][::-1]


def transform(packed: np.ndarray, starts: np.ndarray, depths: list[tuple[int, int]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """One shard's transform: its starts in the order of their 50 symbols, and for each depth what stands before its suffixes, in their order so far."""
    before = []
    for offset, drop in depths:
        c = packed[starts + offset] >> np.uint16(drop)
        before.append(c)
        starts = starts[np.argsort(c, kind="stable")]
    return starts, before


def merge(shards: list[tuple[np.ndarray, list[np.ndarray]]]) -> np.ndarray:
    """All shards' starts in merged order.

    The interleave says of which shard each suffix is; a shard's own suffixes stay in the order of its transform. Reading the
    shards' symbols through the interleave and parting it by them, stably, gives the interleave of the next depth.
    """
    line = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(order) for order, _ in shards])
    c = np.empty(len(line), np.uint16)
    for k in range(len(shards[0][1])):
        for s, (_, before) in enumerate(shards):
            c[line == s] = before[k]
        line = line[np.argsort(c, kind="stable")]
    merged = np.empty(len(line), np.int64)
    for s, (order, _) in enumerate(shards):
        merged[line == s] = order
    return merged


def prefixes(packed: np.ndarray, merged: np.ndarray, depths: list[tuple[int, int]]) -> np.ndarray:
    """How many symbols, in whole steps, each start of the merged order has in common with the one before; 0 for the first."""
    out, same = np.zeros(len(merged), np.int64), np.arange(1, len(merged))
    for k, (offset, drop) in enumerate(depths[::-1]):
        at = merged[same] + offset, merged[same - 1] + offset
        same = same[packed[at[0]] >> np.uint16(drop) == packed[at[1]] >> np.uint16(drop)]
        out[same] = depths[::-1][k + 1][0] if k + 1 < len(depths) else LENGTH
    return out


def apart(group: list[tuple[bytes, int]]) -> list[bytes]:
    """Of segments with one minimiser (text, its place), those that may share 50 bytes with another.

    Around the minimiser 26 more bytes are shared; whichever way they lie, one of five windows of 45 bytes or more is shared.
    """
    seen: dict[tuple[int, bytes], int] = {}
    windows = []
    for s, o in group:
        own = [(k, s[o - b : o + GRAM + a]) for k, (b, a) in enumerate(AROUND) if o >= b and len(s) >= o + GRAM + a]
        windows.append(own)
        for w in own:
            seen[w] = seen.get(w, 0) + 1
    return [s for (s, _), own in zip(group, windows, strict=True) if any(seen[w] > 1 for w in own)]


def least_ids(strings: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(for each string's each start the least id of the strings that hold the same 50 bytes, all in one row; the first start of each string)."""
    size = np.array([len(s) for s in strings])
    count, base = size - LENGTH + 1, np.cumsum(size) - size
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(strings), dtype=np.int32), count)
    starts = np.arange(len(owner)) + np.repeat(base - first, count)
    packed, depths = symbols(np.frombuffer(b"".join(strings), np.uint8))
    cut = np.linspace(0, len(strings), min(SHARDS, len(strings)) + 1).astype(int)
    edge = np.r_[first, len(owner)][cut]
    merged = merge([transform(packed, starts[a:b], depths) for a, b in zip(edge[:-1], edge[1:], strict=True)])
    intervals = np.flatnonzero(prefixes(packed, merged, depths) < LENGTH)  # where repeated strings of 50 bytes begin
    number = np.zeros(len(packed), np.int32)  # of the start at each place
    number[starts] = np.arange(len(starts), dtype=np.int32)
    merged = number[merged]
    least = np.empty(len(owner), np.int64)
    least[merged] = np.repeat(np.minimum.reduceat(ids[owner[merged]], intervals), np.diff(np.r_[intervals, len(merged)]))
    return least, first


def wanted(strings: list[bytes], place: np.ndarray, kind: np.ndarray, many: np.ndarray) -> list[list[int]]:
    """The strings to merge, group by group: those of one minimiser that several documents hold or that may share 50 bytes with another."""
    out: list[list[int]] = []
    if not strings:
        return out
    order = np.argsort(kind, kind="stable")
    cut = np.flatnonzero(np.r_[True, kind[order][1:] != kind[order][:-1]])
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
        group = order[a:b].tolist()
        if b - a > 1 and not many[order[a:b]].all():
            may = set(apart([(strings[k], int(place[k])) for k in group]))
            group = [k for k in group if many[k] or strings[k] in may]
        elif not many[group[0]]:
            continue
        if group:
            out.append(group)
    return out


def judge(packs: list[bytes]) -> list[bytes | None]:
    """For each pack of a bucket what goes in its batch: (minimiser, string's hash, place and end, least id) for every stretch of a string's starts."""
    open_ = zstandard.ZstdDecompressor()
    number: dict[bytes, int] = {}
    of, infos, places = [], [], []
    for blob in packs:
        b = open_.decompress(blob)
        n = int(np.frombuffer(b, "<i8", 1)[0])
        cut = np.cumsum(np.r_[8 + 26 * n, np.frombuffer(b, np.uint8, n, 8 + 25 * n).astype(np.int64)]).tolist()
        of.append(np.array([number.setdefault(b[i:j], len(number)) for i, j in zip(cut[:-1], cut[1:], strict=True)], np.int64))
        infos.append(np.frombuffer(b, "<i8", 3 * n, 8).reshape(n, 3))
        places.append(np.frombuffer(b, np.uint8, n, 8 + 24 * n))
    strings, every, info = list(number), np.concatenate(of), np.concatenate(infos)
    lo, hi = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), np.iinfo(np.int64).min)
    np.minimum.at(lo, every, info[:, 1])
    np.maximum.at(hi, every, info[:, 2])
    kind, place = np.empty(len(strings), np.int64), np.empty(len(strings), np.uint8)
    kind[every], place[every] = info[:, 0], np.concatenate(places)
    many, alone = lo < hi, place == ALONE
    held = np.flatnonzero(~alone)
    groups = [held[g].tolist() for g in wanted([strings[k] for k in held], place[held], kind[held], many[held])]
    rest = np.flatnonzero(alone & many).tolist()  # strings that go alone are all different, so they may be merged in parts
    groups += [rest[i : i + MERGE // LENGTH] for i in range(0, len(rest), MERGE // LENGTH)]

    count, begin = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)  # the stretches of each string
    start, stop, least, made = [], [], [], 0
    some: list[int] = []
    size = 0
    for g, group in enumerate([*groups, None]):
        more = sum(len(strings[k]) for k in group) if group else 0
        if some and (group is None or size + more > MERGE):
            at = np.array(some)
            v, first = least_ids([strings[k] for k in some], lo[at])
            fresh = np.r_[True, v[1:] != v[:-1]]
            fresh[first] = True
            cut = np.flatnonzero(fresh)
            owner = np.searchsorted(first, cut, "right") - 1
            start.append(cut - first[owner])
            stop.append(np.r_[cut[1:], len(v)] - first[owner])
            least.append(v[cut])
            count[at] = np.bincount(owner, minlength=len(at))
            begin[at] = made + np.searchsorted(owner, np.arange(len(at)))
            made += len(cut)
            some, size = [], 0
        if group:
            some += group
            size += more
    if not made:
        return [None] * len(packs)
    start, stop, least = np.concatenate(start), np.concatenate(stop), np.concatenate(least)
    out: list[bytes | None] = []
    for mine, own in zip(of, infos, strict=True):
        n = count[mine]
        row = np.repeat(np.arange(len(mine)), n)
        at = np.repeat(begin[mine] - np.cumsum(n) + n, n) + np.arange(len(row))
        on = least[at] < own[row, 2]
        row, at = row[on], at[on]
        if not len(row):
            out.append(None)
            continue
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        tags = np.array([xxhash.xxh3_64_intdigest(strings[k]) for k in mine[row[first]].tolist()], np.uint64).view(np.int64)
        i = np.where(alone[mine[row]], ALONE, start[at])
        out.append(np.c_[own[row, 0], np.repeat(tags, np.diff(np.r_[first, len(row)])), i << 32 | stop[at], least[at]].astype("<i8").tobytes())
    return out


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, crowd: int = 50_000) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (what is left, binary).

    A byte goes when it is inside 50 equal bytes that also start in a document of a smaller id; strings are judged on the
    input. Null texts count as empty; documents of fewer than 50 bytes keep all; a null id neither loses nor takes; rows that
    share an id are one document to each other and lose nothing to one another. An empty table gives no rows. Ids may be of any
    type that sorts. A minimiser that occurs about `crowd` times or more is not looked at in one place: its strings of 50 bytes
    are parted by their own hashes.
    """
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    raw, known = ordinals(docs.select(F.col(doc_id).alias("doc_id"), data.alias("data")), "doc_id", "suffix")
    raw = raw.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no"), "data")
    total = docs.select(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    batches, buckets = max(8, -(-total // BATCH)), max(8, -(-total // BUCKET))
    parts = int(min(max(8, -(-total // PARTITION)), 1 << 17))
    rows = raw.withColumn("batch", F.pmod(F.xxhash64("id", "data"), F.lit(batches)).cast("int")).repartition(parts, "batch")

    def first(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        ids, texts = _rows(x)
        got = _minimisers(ids, [(at, (b"", *rest)) for at, (_, *rest) in _chunked(ids, texts)], buckets)
        return pd.DataFrame({"bucket": [b for b, _, _ in got], "batch": [key[0]] * len(got), "h": [_six(h) for _, h, _ in got], "shared": [s.tobytes() for _, _, s in got]})

    def repeated(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        some = [_from_six(b) for b in x["h"]]
        h, n = np.concatenate(some), np.concatenate([np.frombuffer(b, np.uint8) for b in x["shared"]])
        n = np.where(n > 0, np.int64(1) << np.maximum(n, 1).astype(np.int64), 1)  # about how often
        order = np.argsort(h)
        s, n = h[order], n[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        size = np.diff(np.r_[first, len(s)])
        level = np.empty(len(s), np.uint8)  # 0: one document has it, 1: more, 2: very many
        level[order] = np.repeat(((size > 1) | (n[first] > 1)).astype(np.uint8) + (np.add.reduceat(n, first) >= crowd), size)
        cut = np.cumsum([0, *map(len, some)])
        masks = [level[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        on = [k for k, m in enumerate(masks) if m.any()]
        two = lambda m: np.packbits(np.concatenate([m > 0, m > 1])).tobytes()
        return pd.DataFrame({"batch": x["batch"].to_numpy()[on], "bucket": [key[0]] * len(on), "mask": [two(masks[k]) for k in on]})

    def second(key: tuple, x: pd.DataFrame, masks: pd.DataFrame) -> pd.DataFrame:
        if not len(masks) or not len(x):
            return pd.DataFrame({"bucket": [], "batch": [], "pack": []})
        ids, texts = _rows(x)
        mask = dict(zip(masks["bucket"], masks["mask"], strict=True))
        chunks = list(_chunked(ids, texts))
        hashes = [(h, np.unpackbits(np.frombuffer(mask[b], np.uint8), count=2 * len(h)).astype(bool)) for b, h, _ in _minimisers(ids, chunks, buckets) if b in mask]
        wanted = np.sort(np.concatenate([h[m[: len(h)]] for h, m in hashes]))
        crowded = {int(v) for h, m in hashes for v in h[m[len(h) :]]}
        found: dict[bytes, list] = {}
        for at, (flat, h, p, a, b, doc) in chunks:
            k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            on = wanted[k] == h
            owner = _owners(ids, at, doc[on]).tolist()
            for hh, o, i, j, one in zip(h[on].tolist(), (p - a)[on].tolist(), a[on].tolist(), (b[on] + LENGTH).tolist(), owner, strict=True):
                # very many surroundings: each 50 bytes go alone, to a bucket of their own hash
                for u, v in [(i, j)] if hh not in crowded else [(w, w + LENGTH) for w in range(i, j - LENGTH + 1)]:
                    had = found.get(flat[u:v])
                    if had is None:
                        found[flat[u:v]] = [hh, one, one, o if hh not in crowded else ALONE]
                    elif one > had[2]:
                        had[2] = one
                    elif one < had[1]:
                        had[1] = one
        by: dict[int, list[bytes]] = {}
        for s, info in found.items():
            by.setdefault((info[0] if info[3] != ALONE else xxhash.xxh3_64_intdigest(s, 7)) % buckets, []).append(s)
        squeeze = zstandard.ZstdCompressor(level=3)
        packs = []
        for strings in by.values():
            strings.sort()
            info = [found[s] for s in strings]
            table = np.array(info, "<i8")
            head = np.array([len(strings)], "<i8").tobytes() + table[:, :3].tobytes() + table[:, 3].astype(np.uint8).tobytes() + np.array([len(s) for s in strings], np.uint8).tobytes()
            packs.append(squeeze.compress(head + b"".join(strings)))
        return pd.DataFrame({"bucket": list(by), "batch": [key[0]] * len(by), "pack": packs})

    def judged(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        runs = judge(list(x["pack"]))
        on = [k for k, r in enumerate(runs) if r]
        return pd.DataFrame({"batch": x["batch"].to_numpy()[on], "runs": [runs[k] for k in on]})

    def third(key: tuple, x: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        ids, texts = _rows(x)
        gone: dict[int, list[tuple[int, int]]] = {}
        if len(runs):
            r = np.concatenate([np.frombuffer(b, "<i8").reshape(-1, 4) for b in runs["runs"]])
            known: dict[int, list[tuple[int, int, int]]] = {}  # by the string's hash
            crowded = set(r[r[:, 2] >> 32 == ALONE, 0].tolist())
            r[:, 2] &= np.where(r[:, 2] >> 32 == ALONE, 0xFFFFFFFF, -1)
            for _, t, ij, lo in r.tolist():
                known.setdefault(t & ((1 << 64) - 1), []).append((ij >> 32, ij & 0xFFFFFFFF, lo))
            wanted = np.unique(r[:, 0]).astype(np.uint64)
            for at, (flat, h, _, a, b, doc) in _chunked(ids, texts):
                base = np.cumsum([0, *(n for _, _, n in at)])
                k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                on = wanted[k] == h
                for hh, i, j, d in zip(h[on].tolist(), a[on].tolist(), b[on].tolist(), doc[on].tolist(), strict=True):
                    for u, v in [(i, j + LENGTH)] if hh not in crowded else [(w, w + LENGTH) for w in range(i, j + 1)]:
                        for p, q, lo in known.get(xxhash.xxh3_64_intdigest(flat[u:v]), ()):
                            place, offset, _ = at[d]
                            if lo < ids[place]:
                                begin = u - int(base[d]) + offset
                                gone.setdefault(place, []).append((begin + p, begin + q + LENGTH - 1))
        out = []
        for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
            spans: list[list[int]] = []
            for a, b in gone.get(k, ()):  # in order of the text
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            left = b"".join(t[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(t)], strict=True))
            row = (i or 0, i is None, len(t), len(t) - len(left), len(spans), hashlib.sha256(left).hexdigest())
            out.append((*row, left) if keep_text else row)
        return pd.DataFrame(out, columns=["id", "no", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 + keep_text])

    grouped = rows.groupBy("batch")
    inside = int(min(max(8, buckets), 1 << 17))
    hashes = grouped.applyInPandas(first, "bucket int, batch int, h binary, shared binary").repartition(inside, "bucket")
    masks = hashes.groupBy("bucket").applyInPandas(repeated, "batch int, bucket int, mask binary").repartition(parts, "batch")
    packs = grouped.cogroup(masks.groupBy("batch")).applyInPandas(second, "bucket int, batch int, pack binary").repartition(inside, "bucket")
    runs = packs.groupBy("bucket").applyInPandas(judged, "batch int, runs binary").repartition(parts, "batch")
    kinds = "id long, no boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    out = grouped.cogroup(runs.groupBy("batch")).applyInPandas(third, kinds)
    out = out.select(F.when(~F.col("no"), F.col("id")).alias("doc_id"), *out.columns[2:])
    if known is None:
        return out
    return out.join(known, out.doc_id == known.ordinal, "left").select(F.col("value").alias("doc_id"), *out.columns[1:])
