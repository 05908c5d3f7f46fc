"""Alignment of two tokenizers' tokens over the same texts by an event sweep.

Each token ends at a byte offset of its text; these ends are the events. The ends of both sides go, in blocks, to one set of
rows, which are repartitioned by document and sorted by offset. A sweep then needs no more than the tokens since the last
offset at which both sides end: there a group closes, and each offset at which any side ends closes one overlap, a link.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from quillmere.llm.common import stage
from quillmere.llm.token_files import LETTERS, PRINTED

#: Tokens of one side in a row, tokens of both that are swept at once, and links after which another part begins.
BLOCK, SWEEP, PART = 4096, 1 << 18, 1 << 22
#: A word or stretch of white space of more characters is a long one; characters of texts that are encoded together.
LONG, TEXTS = 1000, 1 << 22
#: Fixed value: what parts texts for byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of an offset within its document, and of a token id in a pair of them.
OFFSET_BITS, ID_BITS = 40, 24
EMPTY = np.zeros(0, np.int64)


class Side:
    """A vocabulary and its tokens' bytes."""

    def __init__(self, table: list[bytes]) -> None:
        self.table = np.array([*table, b""], object)[:-1]
        self.lengths = np.array([len(t) for t in table])
        self.parted = True
        self.kinds = np.dtype("<u2" if len(table) <= 1 << 16 else "<u4"), np.dtype("u1" if self.lengths.max() < 256 else "<u2")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """ids of texts, with a space before each."""
        raise NotImplementedError

    def encode_parts(self, parts: list[str]) -> np.ndarray:
        """ids of parts that are put together to a text; each begins with its own blank or line end, the first one with a space."""
        return self.encode(["".join(parts)[1:]])[0]

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(self.table[ids].tolist())

    def packed(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        return ids.astype(self.kinds[0]).tobytes(), self.lengths[ids].astype(self.kinds[1]).tobytes()


def encoded(sides: list[Side], texts: list[str | None]) -> list[list[tuple[bytes, bytes]] | None]:
    """Each text's tokens by both sides, None for one without tokens.

    Texts whose words are parted by single spaces and line ends are cut before each of these; neither kind of tokenizer joins
    what stands before one with what stands behind it (`parted` says so of its vocabulary). The distinct parts of all texts,
    one after the other, are a text too: it is encoded instead, and the tokens of its parts are dealt to where they occur. Other
    texts are encoded whole, and so are all where a part does not end with a token.
    """
    out: list[list[tuple[bytes, bytes]] | None] = [None] * len(texts)
    plain = [i for i, t in enumerate(texts) if t and all(s.parted for s in sides) and "▁" not in t and " ".join(words := t.split()) == t.replace("\n", " ") and len(max(words, key=len)) <= LONG]
    if plain:
        parts = [texts[i].replace("\n", " \n").split(" ") for i in plain]
        every = list(chain.from_iterable(parts))
        known = dict.fromkeys(every)
        known = dict(zip(known, range(len(known)), strict=True))
        at = np.fromiter(map(known.__getitem__, every), np.int64, len(every))
        each = [w if w.startswith("\n") else " " + w for w in known]
        text = "".join(each)
        data = text.encode()
        ends = np.cumsum(list(map(len, each if text.isascii() else map(str.encode, each))))
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        dealt = []
        for s in sides:
            ids = s.encode_parts(each)
            upto = np.cumsum(s.lengths[ids])
            k = np.searchsorted(upto, ends)
            if s.joined(ids) != data or not (upto[k] == ends).all():
                break
            first = np.concatenate([[0], k[:-1] + 1])
            n = (k + 1 - first)[at]
            total = np.concatenate([[0], np.cumsum(n)])
            ids = ids[np.repeat(first[at] - total[:-1], n) + np.arange(total[-1])]
            dealt.append([s.packed(ids[x:y]) for x, y in zip(total[bounds[:-1]], total[bounds[1:]], strict=True)])
        if len(dealt) == len(sides):
            for i, tokens in zip(plain, zip(*dealt, strict=True), strict=True):
                out[i] = list(tokens)
    rest = [i for i, t in enumerate(texts) if t and out[i] is None]
    for s in sides:
        for i, ids in zip(rest, s.encode([texts[i] for i in rest]), strict=True):
            good = s.joined(ids) == b" " + texts[i].encode()
            out[i] = [*(out[i] or []), *([s.packed(ids)] if good else [])]
    return [x if x and len(x) == len(sides) else None for x in out]


class ByteLevel(Side):
    """A byte-level vocabulary of the tokenizers library; special tokens' strings in texts are plain text.

    Where the file's merges stand in the order of their ids and texts are parted by the usual pattern, the ids are merge ranks,
    and tiktoken gives the same ids sooner. Its time grows with the square of what the pattern leaves in one piece, so texts
    with very long words or stretches of white space go to the library itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        byte_of = {LETTERS.get(b, chr(b)): b for b in {*LETTERS, *PRINTED}}
        entries = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        super().__init__([bytes(byte_of[c] for c in e) if all(c in byte_of for c in e) else e.encode() for e in entries])
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
        before, model = said["pre_tokenizer"] or {}, said["model"]
        first = len(byte_of)
        ranked = all(entries[first + k] == x + y for k, (x, y) in enumerate(merges)) and {*entries[:first]} == {*byte_of}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")) and not said["normalizer"] and not said["truncation"]
        self.ranks = None
        if ranked and plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"):
            import tiktoken

            self.ranks = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.table[i]: i for i in range(first + len(merges))}, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        if self.ranks:
            for i, t in enumerate(texts):
                words = list(map(len, t.split()))
                if max(words, default=0) < LONG and len(t) - sum(words) - len(words) < LONG:
                    out[i] = self.ranks.encode_to_numpy(" " + t, disallowed_special=()).astype(np.int64)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([" " + texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.int64)
        return out


class Pieces(Side):
    """A sentencepiece model that puts a space before each text; U+2581 is a space, <0xHH> a byte."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.parted = not any(re.search("[^▁]▁|[^▁].*\n|\n.", p) for i, p in enumerate(names) if not self.model.is_byte(i))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def encode_parts(self, parts: list[str]) -> np.ndarray:
        cuts = [0]  # short texts are encoded sooner; each begins with a space
        for i in range(32, len(parts)):
            if i - cuts[-1] >= 32 and parts[i].startswith(" "):
                cuts.append(i)
        texts = ["".join(parts[a:b])[1:] for a, b in zip(cuts, [*cuts[1:], len(parts)], strict=True)]
        return np.array(list(chain.from_iterable(self.model.encode(texts, num_threads=1))), np.int64)


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(offset, length) of stretches of at most TEXTS bytes of texts, or of one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TEXTS, side="right")))
        yield at, to - at
        at = to


def events(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The end events of both sides, made in one scan: blocks (key, first, side, ids, lengths) of tokens from byte `first` on.

    key numbers rows of docs; each has a row with first -1, which alone holds its doc_id. Documents without tokens have no other.
    """
    kind = docs.schema[doc_id].dataType
    schema = StructType([*StructType.fromDDL("key long, first long, side int"), StructField("doc_id", kind), *StructType.fromDDL("ids binary, lengths binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, key = [ByteLevel(path_a), Pieces(path_b)], TaskContext.get().partitionId() << 33
        for b in (x.slice(i, n) for x in batches for i, n in _stretches(x.column(1))):
            rows, of = [], []
            for i, tokens in enumerate(encoded(sides, b.column(1).to_pylist())):
                rows.append((key, -1, 0, b"", b""))
                of.append(i)
                for k, (s, (ids, sizes)) in enumerate(zip(sides, tokens, strict=True) if tokens else ()):
                    w, z, first = s.kinds[0].itemsize, s.kinds[1].itemsize, 0
                    for at in range(0, len(ids) // w, BLOCK):
                        some = sizes[at * z : (at + BLOCK) * z]
                        rows.append((key, first, k, ids[at * w : (at + BLOCK) * w], some))
                        of.append(None)
                        first += int(np.frombuffer(some, s.kinds[1]).sum(dtype=np.int64))
                key += 1
            made = [pa.array(c, type=to_arrow_type(schema[n].dataType)) for n, c in zip(("key", "first", "side", "ids", "lengths"), zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([*made[:3], b.column(0).take(pa.array(of, pa.int32())), *made[3:]], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _tables(vocabulary: int, first: bytes, group: bytes) -> np.ndarray:
    """Decimal ids behind what may stand before them: nothing, what begins a group, a comma."""
    ids = [b"%d" % i for i in range(vocabulary)]
    return np.array([*[first + i for i in ids], *[group + i for i in ids], *[b"," + i for i in ids]], object)


class Sweep:
    """The state machine: the open document's counts and the tokens since its last group closed."""

    def __init__(self, sizes: tuple[int, int], links: bool) -> None:
        self.sizes, self.links = sizes, links
        self.text = _tables(sizes[0], b"", b";"), _tables(sizes[1], b"|", b"|")
        self.rest = [(EMPTY, EMPTY), (EMPTY, EMPTY)]  # ids and ends of each side's tokens of the open document's open group
        self.open: dict | None = None

    def begin(self, doc_id: object) -> dict:
        return {"doc_id": doc_id, "n": [0, 0], "groups": 0, "links": 0, "sha": hashlib.sha256(), "pairs": [], "arrays": ([], [], [])}

    def __call__(self, docs: list[dict], ids: list[np.ndarray], ends: list[np.ndarray], last_open: bool) -> None:
        """Sweep tokens of docs: ids and ends of both sides, an end with the document's place in docs in its upper bits."""
        ends = [np.concatenate([r[1], e]) for r, e in zip(self.rest, ends, strict=True)]
        ids = [np.concatenate([r[0], i]) for r, i in zip(self.rest, ids, strict=True)]
        every = np.sort(np.concatenate(ends), kind="stable")
        every = every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every
        at = [np.searchsorted(e, every) for e in ends]
        both = np.ones(len(every), bool)
        for e, i in zip(ends, at, strict=True):
            both &= e[np.minimum(i, len(e) - 1)] == every if len(e) else False
        closed = every[both]
        if last_open:  # what comes behind the last common end waits for more tokens
            upto = closed[-1] if len(closed) else -1
            k = [np.searchsorted(e, upto, side="right") for e in ends]
            base = (len(docs) - 1) << OFFSET_BITS
            self.rest = [(i[n:], e[n:] - base) for i, e, n in zip(ids, ends, k, strict=True)]
            ids, ends = [i[:n] for i, n in zip(ids, k, strict=True)], [e[:n] for e, n in zip(ends, k, strict=True)]
            n = np.searchsorted(every, upto, side="right")
            every, at = every[:n], [i[:n] for i in at]
        else:
            self.rest = [(EMPTY, EMPTY), (EMPTY, EMPTY)]
        if not len(every):
            return
        upto = [np.searchsorted(e, closed, side="right") for e in ends]  # tokens up to each group's end
        group = [np.searchsorted(closed, e) for e in ends]
        before = [np.concatenate([[0], u[:-1]]) for u in upto]
        bounds = [np.searchsorted(e >> OFFSET_BITS, np.arange(len(docs) + 1)) for e in ends]
        words = np.empty(len(ids[0]) + len(ids[1]), object)
        for s in (0, 1):
            lead = np.where(np.arange(len(ids[s])) == before[s][group[s]], 1, 2)
            if not s:  # a document's first token, unless it was open before
                starts = bounds[0][:-1][np.diff(bounds[0]) > 0]
                lead[starts[1:] if docs[0]["n"][0] and starts[0] == 0 and bounds[0][1] else starts] = 0
            words[np.arange(len(ids[s])) + (before[1][group[0]] if not s else upto[0][group[1]])] = self.text[s][lead * self.sizes[s] + ids[s]]
        doc = every >> OFFSET_BITS
        pair = doc.astype(np.uint64) << np.uint64(2 * ID_BITS) | ids[0][at[0]].astype(np.uint64) << np.uint64(ID_BITS) | ids[1][at[1]].astype(np.uint64)
        pair, times = np.unique(pair, return_counts=True)
        of_pair = np.searchsorted(pair >> np.uint64(2 * ID_BITS), np.arange(len(docs) + 1, dtype=np.uint64))
        of_link, of_group = np.searchsorted(doc, np.arange(len(docs) + 1)), np.searchsorted(closed >> OFFSET_BITS, np.arange(len(docs) + 1))
        pair = (pair & np.uint64((1 << 2 * ID_BITS) - 1)).astype(np.int64)
        both_bounds = bounds[0] + bounds[1]
        for d, x in enumerate(docs):
            a, b = of_link[d], of_link[d + 1]
            if a == b:
                continue
            if self.links:
                lists = closed[of_group[d] : of_group[d + 1]] & ((1 << OFFSET_BITS) - 1), at[0][a:b] - bounds[0][d] + x["n"][0], at[1][a:b] - bounds[1][d] + x["n"][1]
                for own, new in zip(x["arrays"], lists, strict=True):
                    own.append(new)
            x["sha"].update(b"".join(words[both_bounds[d] : both_bounds[d + 1]].tolist()))
            x["n"] = [n + int(u[d + 1] - u[d]) for n, u in zip(x["n"], bounds, strict=True)]
            x["groups"] += int(of_group[d + 1] - of_group[d])
            x["links"] += int(b - a)
            x["pairs"].append((pair[of_pair[d] : of_pair[d + 1]], times[of_pair[d] : of_pair[d + 1]]))
            if len(x["pairs"]) > 8:
                x["pairs"] = [summed(x["pairs"])]


def summed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their numbers."""
    keys, n = (np.concatenate([p[k] for p in pairs]) if pairs else EMPTY for k in (0, 1))
    keys, of = np.unique(keys, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, of.ravel(), n)
    return keys, total


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32), pa.array(np.concatenate([EMPTY, *arrays]), kind))


def sweep(ends: DataFrame, path_a: str, path_b: str, links: bool = False) -> DataFrame:
    """A row for each document of events(): counts, digest of its groups, its distinct id pairs and how often each is linked.

    With links also group_ends (byte offsets) and link_a, link_b (ordinals of the linked tokens). part numbers stretches of
    about PART links within a task.
    """
    columns = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair_a array<int>, pair_b array<int>, pair_n array<int>, part long" + ", group_ends array<long>, link_a array<int>, link_b array<int>" * links
    schema = StructType([ends.schema["doc_id"], *StructType.fromDDL(columns)])
    sides = [ByteLevel(path_a), Pieces(path_b)]
    sizes, id_kinds, length_kinds = tuple(len(s.table) for s in sides), [s.kinds[0] for s in sides], [s.kinds[1] for s in sides]
    del sides
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Sweep(sizes, links)
        part, linked = TaskContext.get().partitionId() << 33, 0
        docs: list[dict] = []
        ids, found, held = ([], []), ([], []), 0

        def flush(last_open: bool) -> pa.RecordBatch | None:
            nonlocal docs, ids, found, held, linked
            machine(docs, *[[np.concatenate([EMPTY, *x]) for x in y] for y in (ids, found)], last_open)
            done, docs = (docs[:-1], docs[-1:]) if last_open else (docs, [])
            ids, found, held = ([], []), ([], []), 0
            if not done:
                return None
            pairs, parts = [d["pairs"][0] if len(d["pairs"]) == 1 else summed(d["pairs"]) for d in done], []  # those of one sweep are distinct
            for d in done:
                parts.append(part + (linked // PART))
                linked += d["links"]
            keys, n = [p[0] for p in pairs], [p[1] for p in pairs]
            plain = [[d["doc_id"] for d in done], *[[d["n"][s] for d in done] for s in (0, 1)], [d["groups"] for d in done], [d["links"] for d in done], [d["sha"].hexdigest() if d["links"] else "" for d in done]]
            made = [*[pa.array(c, type=t) for c, t in zip(plain, kinds, strict=False)], lists([k >> ID_BITS for k in keys], pa.int32()), lists([k & ((1 << ID_BITS) - 1) for k in keys], pa.int32()), lists(n, pa.int32()), pa.array(parts, pa.int64())]
            if links:
                made += [lists([np.concatenate([EMPTY, *d["arrays"][k]]) for d in done], pa.int32() if k else pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays(made, schema.names)

        for batch in batches:
            ids_of, lengths_of = batch.column(4), batch.column(5)
            for i, (first, side, doc_id) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                if first < 0:
                    if (held >= SWEEP or len(docs) >= 1 << 14) and (out := flush(False)) is not None:
                        yield out
                    docs.append(machine.begin(doc_id))
                    continue
                if held >= SWEEP and (out := flush(True)) is not None:
                    yield out
                some = np.frombuffer(ids_of[i].as_buffer(), id_kinds[side]).astype(np.int64)
                ids[side].append(some)
                found[side].append(np.cumsum(np.frombuffer(lengths_of[i].as_buffer(), length_kinds[side]), dtype=np.int64) + (first + ((len(docs) - 1) << OFFSET_BITS)))
                held += len(some)
        if docs and (out := flush(False)) is not None:
            yield out

    ordered = ends.repartition("key").sortWithinPartitions("key", "first", "side")
    return ordered.mapInArrow(run, schema)


def pair_counts(swept: DataFrame) -> DataFrame:
    """(part, a, b, n): how often each pair of ids is linked in each part; a part that several tasks read repeats pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, some, held = None, [], 0

        def out() -> pa.RecordBatch:
            keys, n = summed(some)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part)), pa.array(keys >> ID_BITS), pa.array(keys & ((1 << ID_BITS) - 1)), pa.array(n.astype(np.int64))], ["part", "a", "b", "n"])

        for batch in batches:
            parts, offsets = batch.column(0).to_numpy(), batch.column(1).offsets.to_numpy()
            a, b, n = (batch.column(k).values.to_numpy().astype(np.int64) for k in (1, 2, 3))
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)] if len(parts) else []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if parts[i] != part:
                    if some:
                        yield out()
                    part, some, held = int(parts[i]), [], 0
                x, y = offsets[i], offsets[j]
                some.append((a[x:y] << ID_BITS | b[x:y], n[x:y]))
                held += y - x
                if held > SWEEP:
                    some = [summed(some)]
                    held = 0
        if some:
            yield out()

    return swept.select("part", "pair_a", "pair_b", "pair_n").mapInArrow(run, "part long, a long, b long, n long")


def align(docs: DataFrame, path_a: str, path_b: str, links: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs; with links the links themselves.

    path_a is a byte-level vocabulary of the tokenizers library, path_b a sentencepiece model; both see a space before the
    text. Null and empty texts, and texts of which the joined bytes of one side's tokens differ, have no tokens: zeros and ''.
    Rows that repeat an id, and null ids, are documents of their own. Other columns are not looked at. No rows give no rows.
    """
    swept = stage(sweep(events(docs, path_a, path_b, doc_id, text), path_a, path_b, links), "align-swept")
    parts = stage(pair_counts(swept), "align-pairs")
    totals = parts.groupBy("a", "b").agg(F.sum("n").alias("n"))
    best = totals.groupBy("b").agg(F.max("n").alias("best"))  # no more rows than B has ids
    known = totals.join(F.broadcast(best), "b").select("a", "b", "n", (F.col("n") == F.col("best")).alias("top"))
    known = parts.select("part", "a", "b").join(known, ["a", "b"])
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["group_ends", "link_a", "link_b"] if links else [])]
    schema = StructType([*[swept.schema[c] for c in kept], *StructType.fromDDL("n_best long, count_sum long")])

    def count(rows: pa.Table, known: pa.Table) -> pa.Table:
        a, b, n = (known.column(c).to_numpy() for c in ("a", "b", "n"))
        keys, top = a << ID_BITS | b, known.column("top").to_numpy()
        order = np.argsort(keys)
        keys, n, top = keys[order], n[order], top[order]
        sums = []
        for chunk in rows.combine_chunks().to_batches():
            ids = [chunk.column(c).values.to_numpy().astype(np.int64) for c in ("pair_a", "pair_b", "pair_n")]
            bounds = chunk.column("pair_a").offsets.to_numpy()
            at = np.searchsorted(keys, ids[0] << ID_BITS | ids[1])
            got = [ids[2] * top[at], ids[2] * n[at]] if len(keys) else [ids[2], ids[2]]
            run = [np.concatenate([[0], np.cumsum(g)]) for g in got]
            new = [pa.array(r[bounds[1:]] - r[bounds[:-1]], pa.int64()) for r in run]
            sums.append(pa.RecordBatch.from_arrays([*[chunk.column(c) for c in kept], *new], schema.names))
        return pa.Table.from_batches(sums)

    return swept.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(count, schema)
