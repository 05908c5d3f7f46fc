"""Importance resampling, packing and token alignment against plain versions, on the tables and on odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmere.llm import alignment, packing, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKENIZER, PATH_A, PATH_B = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
CLASHING = "doc_id {}, text string, key string, digest string, rank string, part string, length string, start string, n string, bucket string, first string, side string"


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghijABé"), 6)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, words(30_000)), (6, words(40, 1)), (6, words(40, 1)), (7, words(40, 1)), (None, words(40, 1)), (None, None), (8, "\x00́é" * 40), (9, "a ▁ b <|endoftext|> <s> <0x41>"), (10, "one  two\n\n three\t\n four "), (11, "日本語 \U0001f600️ it's"), ((1 << 60) + 1, words(30, 2)), ((1 << 60) + 2, words(30, 3)), (12, "x" * 9000), (13, "\x1c a\x1db\u0085 c ")]


def frame(spark, rows, kind="long"):
    return spark.createDataFrame([(i if kind == "long" or i is None else f"id{i}", t, *"abcdefghij") for i, t in rows], CLASHING.format(kind))


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:]))]], len(w)


def plain_resample(rows, target):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[0])
    for text in target:
        t.update(features(text)[0])
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        f, n = features(text)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, hashlib.sha256((text or "").encode()).hexdigest()))
    fit = sorted((o for o in out if o[4] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0, o[5]))
    drawn = fit[: 25 * len(fit) // 100]
    return Counter([(*o[:4], k + 1) for k, o in enumerate(drawn)] + [(*o[:4], None) for o in [*fit[len(drawn) :], *(o for o in out if o[4] < 20)]])


@pytest.mark.parametrize("rows", [ODD, [(5, words(25))] * 40 + [(i, words(25, i)) for i in range(30)] + [(None, words(25, 3))] * 30], ids=["odd", "repeats"])
def test_resample_odd(spark, rows):
    target = spark.createDataFrame([("t", words(50, 1)), ("u", None), ("v", words(9, 7))], "item_id string, text string")
    got = resampling.resample(frame(spark, rows).repartition(5), target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain_resample(rows, [words(50, 1), None, words(9, 7)])


def test_resample_table(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert Counter(map(tuple, resampling.resample(docs, target).collect())) == plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])


def test_resample_hot_texts_alone(spark, monkeypatch):
    """All ways back to the documents give the same rows: by broadcast of hot texts, and by a join of the others."""
    target, rows = spark.createDataFrame([(words(50, 1),)], "text string"), [(i, words(25, i % 3)) for i in range(30)]
    every = [sorted(map(tuple, resampling.resample(frame(spark, rows), target).collect())) for hot in (1, 2, 1 << 16) if not monkeypatch.setattr(resampling, "HOT", hot)]
    assert every[0] == every[1] == every[2]


def test_resample_long_text_in_blocks(monkeypatch):
    text = words(4000).lower().encode()
    want = sorted(resampling.feature_buckets(text, 10_000))
    monkeypatch.setattr(resampling, "BLOCK", 50)
    assert sorted(resampling.feature_buckets(text, 10_000)) == want == sorted(features(text.decode())[0])


def test_empty_tables(spark):
    none, target = frame(spark, ODD).limit(0), spark.createDataFrame([(None,)], "text string")
    assert resampling.resample(none, target).count() == 0
    assert resampling.resample(frame(spark, ODD), target.limit(0)).count() == len(ODD)
    assert packing.pack(none, TOKENIZER).count() == 0
    assert alignment.align(none, PATH_A, PATH_B, links=True).count() == 0


def plain_best_fit(lengths, window):
    """Windows of best fit decreasing, by looking at every open window."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, r in enumerate(rooms) if r >= n]
        if fit:
            k = min(fit, key=lambda k: rooms[k])
            rooms[k] -= n
        else:
            rooms.append(window - n)
    return sorted(window - r for r in rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_placements_are_best_fit_decreasing(lengths):
    counts = Counter(lengths)
    steps, made = packing.placements(counts, 40)
    used = {}
    for (length, rank, first, per, offset), after in zip(steps, [*steps[1:], None], strict=False):
        upto = after[1] if after and after[0] == length else counts[length]
        for k in range(upto - rank):
            used.setdefault(first + k // per, []).append((offset + k % per * length, length))
    assert made == len(used) and set(used) == set(range(made))
    for cells in used.values():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at
            at += length
        assert at <= 40
    assert sorted(sum(n for _, n in cells) for cells in used.values()) == plain_best_fit(lengths, 40)
    assert Counter(n for cells in used.values() for _, n in cells) == counts


def check_packing(spark, docs, window):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(docs, TOKENIZER, window).collect()
    want = Counter((r.doc_id, tuple([*tok.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in docs.select("doc_id", "text").collect())
    spans, sequences = {}, {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        spans.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for (doc_id, n), some in spans.items():
        if n <= window:
            assert all((r.start, r.length) == (0, n) for r in some)
        texts = [t for t in want.elements() if t[0] == doc_id and len(t[1]) == n]
        assert Counter((r.start, tuple(r.ids)) for r in some) == Counter((at, t[1][at : at + window]) for t in texts for at in range(0, n, window))
    assert set(sequences) == set(range(len(sequences)))
    for some in sequences.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sorted(sum(r.length for r in s) for s in sequences.values()) == plain_best_fit([r.length for r in got], window)
    return sequences


@pytest.mark.parametrize("kind", ["long", "string"])
def test_pack_odd(spark, kind):
    docs = frame(spark, ODD, kind).repartition(3).cache()
    sequences = check_packing(spark, docs, 100)
    for r in packing.sequences(packing.pack(docs, TOKENIZER, 100), 100, 7).collect():
        some = sorted(sequences[r.sequence_id], key=lambda x: x.offset) if r.sequence_id in sequences else []
        n = sum(x.length for x in some)
        assert len(r.ids) == (r.n_tokens if r.n_tokens & (r.n_tokens - 1) == 0 else 100) and r.n_tokens == n and set(r.ids[n:]) <= {7}


def test_pack_table(spark, sf):
    check_packing(spark, spark.read.parquet(f"{sf}/documents.parquet"), 4096)


def plain_align(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATH_A), sentencepiece.SentencePieceProcessor(model_file=PATH_B)
    a.encode_special_tokens = True
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in printed} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in printed)}
    found, times = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append((doc_id, 0, 0, [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b))
        common = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for c in common:
            p, q = i, j
            while i < len(ends_a) and ends_a[i] <= c:
                i += 1
            while j < len(ends_b) and ends_b[j] <= c:
                j += 1
            groups.append((ids_a[p:i], ids_b[q:j], c))
        links, i, j = [], 0, 0
        while i < len(ids_a):
            links.append((i, j, ids_a[i], ids_b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
        times.update(k[2:] for k in links)
        found.append((doc_id, len(ids_a), len(ids_b), groups, links))
    most = Counter()
    for (_, y), n in times.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), hashlib.sha256(said.encode()).hexdigest() if groups else "", sum(times[k[2:]] == most[k[3]] for k in links), sum(times[k[2:]] for k in links), tuple(g[2] for g in groups), tuple(k[0] for k in links), tuple(k[1] for k in links)))
    return Counter(out)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "group_ends", "link_a", "link_b"]


def aligned(docs):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in alignment.align(docs, PATH_A, PATH_B, links=True).select(COLUMNS).collect())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_align_odd(spark, kind):
    rows = [(i if kind == "long" or i is None else f"id{i}", t) for i, t in ODD]
    assert aligned(frame(spark, ODD, kind).repartition(3)) == plain_align(rows)


def test_align_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert aligned(docs) == plain_align([(r.doc_id, r.text) for r in docs.collect()])


def test_align_in_pieces(monkeypatch):
    """The sweep gives the same however few tokens it sees at once."""
    rng = np.random.default_rng(5)
    for _ in range(40):
        docs, ids, ends = [], [], []
        for d in range(rng.integers(1, 5)):
            size = int(rng.integers(1, 60))
            cuts = [sorted({*rng.integers(1, size + 1, rng.integers(0, size)).tolist(), size}) for _ in (0, 1)]
            docs.append((d, cuts, [rng.integers(0, 9, len(c)) for c in cuts]))
        outs = []
        for step in (1, 3, 1000):
            machine, done, opened = alignment.Sweep((9, 9), True), [], []
            for d, cuts, tokens in docs:
                opened = [machine.begin(d)]
                blocks = sorted(((cuts[s][k - 1] if k else 0), s, k) for s in (0, 1) for k in range(0, len(cuts[s]), step))
                for n, (_, s, k) in enumerate(blocks):
                    given = [(np.array(tokens[x][k : k + step]), np.array(cuts[x][k : k + step])) if x == s else (alignment.EMPTY, alignment.EMPTY) for x in (0, 1)]
                    machine(opened, [g[0] for g in given], [g[1] for g in given], n < len(blocks) - 1)
                done += opened
            outs.append([(x["n"], x["groups"], x["links"], x["sha"].hexdigest(), alignment.summed(x["pairs"])[1].tolist(), [np.concatenate(a).tolist() for a in x["arrays"]]) for x in done])
        assert outs[0] == outs[1] == outs[2]
