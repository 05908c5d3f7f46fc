"""Token ids in binary files: one zstandard frame a document, one shared dictionary, an offset index for single documents.

A data set is a folder of shards, a dictionary and format.json. Integers are little-endian.

    shard = MAGIC (8) | sha256 of the dictionary (32) | bytes an id, 2 or 4 (1) | frames | index | footer
    index = doc ids | token counts (uint32 each) | frame offsets (uint64, one more than documents)
    footer = offset of the index (uint64) | documents (uint64) | MAGIC (8)

Doc ids are int64 each, a null one the least int64, where format.json says "long"; where it says "string" they are lengths
(uint32 each, a null id the greatest uint32) and then UTF-8. Shards are numbered in ascending order of doc_id, and documents
ascend within a shard; a task begins another shard when one has reached its size. Tasks write to a name of their own and
rename, so a task that runs again leaves the same shards.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from unicodedata import is_normalized
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from quillmere.llm.common import Remembered, qualified, stage

MAGIC = b"QMTOKEN2"
NULL_ID, NULL_SIZE = -(1 << 63), (1 << 32) - 1
#: Full stops and commas behind another sign, and letters that may not be lower-cased one by one: such texts are encoded as they are.
SIGNS = re.compile(r"[.,](?<![^\W_][.,])(?<!\s[.,])|<\|")
TAILED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
RARE = re.compile("[\u0130\u0250-\U0010ffff]")
# What a tokenizer's file says where its texts may be parted at blanks.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The letters that stand for bytes: printable ones for themselves, the others in order from 256 on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTED)}


class _Files:
    """Local or shared POSIX folders by open(); other stores by pyarrow's file systems. The path has a scheme."""

    def __init__(self, path: str) -> None:
        at = urlparse(path)
        self.local = at.scheme in ("", "file")
        self.path = at.path if self.local else path
        if not self.local:
            from pyarrow import fs

            self.store, self.root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))

    @contextlib.contextmanager
    def create(self, name: str):
        """An open file that gets its name when all is written."""
        own = f"{self.path if self.local else self.root}/.{name}-{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self.path, exist_ok=True)
        with open(own, "wb") if self.local else self.store.open_output_stream(own) as f:
            yield f
        if self.local:
            os.replace(own, f"{self.path}/{name}")
        else:
            self.store.move(own, f"{self.root}/{name}")

    def write(self, name: str, data: bytes) -> None:
        with self.create(name) as f:
            f.write(data)

    def open(self, name: str):
        return open(f"{self.path}/{name}", "rb") if self.local else self.store.open_input_file(f"{self.root}/{name}")


class Encoder:
    """ids of whole texts by the tokenizers library, as little-endian bytes.

    Where the tokenizer's own file says that it lower-cases letter by letter, parts texts at white space and splits signs from
    letters and digits, a text's ids are those of its pieces in order. Then what blanks part is encoded once and remembered,
    and a text of plain Latin letters is lower-cased first and parted before full stops and commas that follow no other sign.
    Any other tokenizer gets each text whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype("<u4" if self.tok.get_vocab_size() > 1 << 16 else "<u2")
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model, before = said["model"], said["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback"))
        added = all(t["content"].startswith("<|") and not t["normalized"] for t in said["added_tokens"])
        self.parted = model["type"] == "BPE" and plain and added and said["normalizer"] == NORMALIZER and before.get("pretokenizers") == [SPLIT, BYTES] and not said["truncation"]
        self.known = Remembered(self._learn, 1 << 17)

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _learn(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(pieces)
        tokenize, rest, ids, ends, words = self.tok.model.tokenize, [], [], [], []
        for i, w in enumerate(pieces):
            # letters, or letters and then signs, which the tokenizer parts; it changes no such piece but that bytes get letters
            m = None if w.isalpha() else TAILED.fullmatch(w)
            a = m[1] if m else w
            if a.isalpha() and (a.isascii() or not RARE.search(a) and is_normalized("NFC", a)) and a == a.lower():
                ids += [t.id for t in tokenize(a if a.isascii() else a.encode().decode("latin-1").translate(LETTERS))]
                if m:
                    ids += [t.id for t in tokenize(m[2])]
                words.append(i)
                ends.append(len(ids) * self.kind.itemsize)
            else:
                rest.append(i)
        data = self._bytes(ids)
        for i, a, b in zip(words, [0, *ends], ends, strict=False):
            out[i] = data[a:b]
        for i, e in zip(rest, self.tok.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = self._bytes(e.ids)
        return out

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if not SIGNS.search(text) and not any(c in text for c in "\x1c\x1d\x1e\x1f") and (text.isascii() or not RARE.search(text)):
            text = text.lower().replace(".", " .").replace(",", " ,")
        return text.replace("\n", " ").split(" ")

    def __call__(self, texts: list[str | None], end: list[int]) -> list[bytes]:
        last = self._bytes(end)
        if not self.parted:
            return [self._bytes(e.ids) + last for e in self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        parts = [self._pieces(t or "") for t in texts]
        ids, out, at = self.known(list(chain.from_iterable(parts))), [], 0
        for p in parts:
            out.append(b"".join(ids[at : at + len(p)]) + last)
            at += len(p)
        return out


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, samples: int, sample_chars: int, size: int) -> bytes:
    """A dictionary from the serialized ids of at most `samples` documents of at most `sample_chars` characters, those of the least hash; empty when there are too few."""
    short = docs.where(F.col("text").isNotNull() & (F.length("text") <= sample_chars) & (F.length("text") > 0))
    share = min(1.0, 4 * samples / max(1, docs.count()))  # about four times what is wanted, by the hash of the id, so that one reading of the texts is enough
    some = short.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).where(F.col("h") < int(share * (1 << 40)))
    texts = [r[0] for r in some.orderBy("h", "text").select("text").limit(samples).collect()]
    data = Encoder(tokenizer)(texts, [end_id])
    if sum(map(len, data)) < 8 * size or len(data) < 64:
        return b""
    return zstandard.train_dictionary(size, data).as_bytes()


def _ids(values: list, number: bool) -> bytes:
    if number:
        return np.array([NULL_ID if v is None else v for v in values], "<i8").tobytes()
    some = [None if v is None else v.encode("utf-8", "surrogatepass") for v in values]
    return np.array([NULL_SIZE if v is None else len(v) for v in some], "<u4").tobytes() + b"".join(v for v in some if v is not None)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, samples: int = 2048, sample_chars: int = 8192, dictionary_bytes: int = 32768, level: int = 3, shard_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, write shards in ascending doc_id order. Returns the manifest: shard, docs, tokens.

    Null texts count as empty and give the end id alone. Rows that repeat an id are all written, side by side, by text; a null
    id comes first. Integer ids are kept as int64, ids of other types as their text, in its order. An empty table gives no
    shards. The dictionary is the one thing learned from a bounded sample (samples, sample_chars).
    """
    number = isinstance(docs.schema[doc_id].dataType, IntegralType)
    path = qualified(docs.sparkSession, path)
    rows = docs.select(F.col(doc_id).cast("long" if number else "string").alias("doc_id"), F.col(text).alias("text"))
    words = train_dictionary(rows, tokenizer, end_id, samples, sample_chars, dictionary_bytes)
    digest = hashlib.sha256(words).digest()
    files = _Files(path)
    files.write("dictionary", words)
    files.write("format.json", json.dumps({"dictionary_sha256": digest.hex(), "end_id": end_id, "doc_id": "long" if number else "string"}).encode())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        known = zstandard.ZstdCompressionDict(words) if words else None
        if known:
            known.precompute_compress(level=level)  # else each frame would digest it again
        pack = zstandard.ZstdCompressor(level=level, dict_data=known)
        own, width = _Files(path), encode.kind.itemsize
        some = (b.slice(i, 32) for b in batches for i in range(0, b.num_rows, 32))
        part, made = next(some, None), 0
        while part is not None:  # a shard
            name = f"shard-{TaskContext.get().partitionId():07d}-{made:05d}"
            ids, counts, offsets, at = [], [], [], 41
            with own.create(name) as f:
                f.write(MAGIC + digest + bytes([width]))
                while part is not None and at < shard_bytes:
                    for a in encode(part.column(1).to_pylist(), [end_id]):
                        frame = pack.compress(a)
                        f.write(frame)
                        offsets.append(at)
                        at += len(frame)
                        counts.append(len(a) // width)
                    ids += part.column(0).to_pylist()
                    part = next(some, None)
                f.write(_ids(ids, number) + np.array(counts, "<u4").tobytes() + np.array([*offsets, at], "<u8").tobytes())
                f.write(struct.pack("<QQ", at, len(ids)) + MAGIC)
            made += 1
            yield pa.RecordBatch.from_pydict({"shard": [name], "docs": [len(ids)], "tokens": [int(np.sum(counts, dtype=np.int64))]})

    in_order = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stage(in_order.mapInArrow(write, "shard string, docs long, tokens long"), "token-manifest")


def _index(f, number: bool) -> tuple[bytes, int, list, np.ndarray, np.ndarray]:
    """(dictionary hash, bytes an id, doc ids, counts, offsets) of an open shard."""
    f.seek(0)
    head = f.read(41)
    f.seek(-24, 2)
    at, n = struct.unpack("<QQ", f.read(16))
    if head[:8] != MAGIC or f.read(8) != MAGIC:
        raise ValueError("not a whole shard")
    f.seek(at)
    if number:
        ids = [None if i == NULL_ID else i for i in np.frombuffer(f.read(8 * n), "<i8").tolist()]
    else:
        sizes = np.frombuffer(f.read(4 * n), "<u4").tolist()
        ids = [None if k == NULL_SIZE else f.read(k).decode("utf-8", "surrogatepass") for k in sizes]
    data = f.read(n * 4 + (n + 1) * 8)
    return head[8:40], head[40], ids, np.frombuffer(data, "<u4", n), np.frombuffer(data, "<u8", n + 1, n * 4)


def _unpacker(files: _Files, digest: bytes) -> zstandard.ZstdDecompressor:
    with files.open("dictionary") as f:
        words = f.read()
    if hashlib.sha256(words).digest() != digest:
        raise ValueError("the dictionary is not the one that the shard was written with")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)


def _numbered(files: _Files) -> bool:
    with files.open("format.json") as f:
        return json.loads(f.read())["doc_id"] == "long"


def read_document(path: str, shard: str, k: int) -> tuple[int | str | None, np.ndarray]:
    """(doc_id, ids) of the k-th document of a shard; reads the index and that one frame."""
    files = _Files(path)
    with files.open(shard) as f:
        digest, width, ids, _, offsets = _index(f, _numbered(files))
        f.seek(int(offsets[k]))
        data = _unpacker(files, digest).decompress(f.read(int(offsets[k + 1] - offsets[k])))
    return ids[k], np.frombuffer(data, "<u2" if width == 2 else "<u4")


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens, ids_crc32 and, if wanted, ids: all decoded from the files."""
    path = qualified(spark, path)
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("shard", before.alias("before"))  # a row for each shard
    number = _numbered(_Files(path))
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + keep_ids]
    kinds = [pa.int64() if number else pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 4 + keep_ids]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(path)
        for shard, first in ((s, b) for x in batches for s, b in zip(*(c.to_pylist() for c in x.columns), strict=True)):
            with files.open(shard) as f:
                digest, width, ids, counts, offsets = _index(f, number)
                unpack, start = _unpacker(files, digest), int(first)
                for i in range(0, len(ids), 512):
                    out = []
                    for k in range(i, min(i + 512, len(ids))):
                        f.seek(int(offsets[k]))
                        a = np.frombuffer(unpack.decompress(f.read(int(offsets[k + 1] - offsets[k]))), "<u2" if width == 2 else "<u4")
                        if len(a) != counts[k]:
                            raise ValueError(f"{shard}: document {k} has {len(a)} ids, the index says {counts[k]}")
                        out.append((ids[k], start, len(a), zlib.crc32(a.astype("<u4").tobytes()), a)[: len(names)])
                        start += len(a)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    apart = shards.repartition(max(1, manifest.count()))  # a task for each shard: the rows are too small for Spark to part by size
    return apart.mapInArrow(read, f"doc_id {'long' if number else 'string'}, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * keep_ids)
