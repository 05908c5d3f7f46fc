"""Hash trees, ranks and ordered texts under hot keys, legs that fail by question, and the persisted index."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from quillmere.operators import corpus, legs, ranks, versions


def plain_tree(files, leaf):
    """The tree from above, by recursion."""
    out = {}

    def node(prefix, rows):
        lines = sorted(f"{i}:{h}" for i, h in rows)
        if len(rows) <= leaf:
            digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        else:
            kids = [(prefix + d, [r for r in rows if r[0].startswith(prefix + d)]) for d in "0123456789abcdef"]
            digest = hashlib.sha256("\n".join(f"{p}:{len(x)}:{node(p, x)}" for p, x in kids if x).encode()).hexdigest()
        out[prefix] = (len(rows), digest, len(rows) <= leaf)
        return digest

    node("", files)
    return out


def some_files(n, seed=0):
    return [(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:16], f"h{i}") for i in range(n)]


def frame(spark, files):
    return spark.createDataFrame(files, "file_id string, file_hash string")


@pytest.mark.parametrize("n", [0, 1, 4, 5, 90])
def test_hash_tree(spark, n):
    files = some_files(n)
    got = {r.prefix: (r.n, r.hash, r.leaf) for r in versions.hash_tree(frame(spark, files), leaf=4).collect()}
    assert got == plain_tree(files, 4)


def test_changed_ranges(spark):
    old, new = some_files(80), some_files(80)
    new[7] = (new[7][0], "other")
    new = [*new[:50], *new[51:], *some_files(1, 1)]
    a, b = (versions.hash_tree(frame(spark, x), leaf=4) for x in (old, new))
    got = {r.prefix: (r.n_old, r.n_new) for r in versions.changed_ranges(a, b).collect()}
    ids = {old[7][0], old[50][0], some_files(1, 1)[0][0]}
    assert all(any(i.startswith(p) for i in ids) for p in got) and all(any(i.startswith(p) for p in got) for i in ids)
    x, y = plain_tree(old, 4), plain_tree(new, 4)
    assert got == {p: (x.get(p, [None])[0], y.get(p, [None])[0]) for p in got} and len(got) <= 3
    assert versions.changed_ranges(a, a).count() == 0
    assert [tuple(r) for r in versions.changed_ranges(versions.hash_tree(frame(spark, old[:0])), versions.hash_tree(frame(spark, old[:3]))).collect()] == [("", 0, 3)]


@pytest.mark.parametrize("hot", [2, 1000])
def test_rank_within_a_hot_key(spark, hot):
    """Half of all rows have one key, and some none: the ranks are those of a window, and no part of the hot key is far above the others."""
    rng = random.Random(3)
    rows = [("same" if i % 2 else rng.choice(["a", "b", None, f"k{i}"]), rng.randrange(50), i) for i in range(2000)]
    x = spark.createDataFrame(rows, "k string, o int, i int").repartition(8)
    got = {r.i: r.place for r in ranks.rank_within(x, ["k"], ["o", "i"], "place", hot).collect()}
    for key in {r[0] for r in rows}:
        assert [got[i] for _, i in sorted((o, i) for k, o, i in rows if k == key)] == list(range(sum(r[0] == key for r in rows)))


def test_a_hot_key_is_dealt_to_all_tasks(spark, monkeypatch):
    seen = []
    real = ranks.staged
    monkeypatch.setattr(ranks, "staged", lambda df, name: seen.append(real(df, name)) or seen[-1])
    x = spark.range(4000).select(F.lit("same").alias("k"), "id")
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows are brought together again
    spark.conf.set(name, "false")
    try:
        assert ranks.rank_within(x, ["k"], ["id"], "place").where("place <> id").count() == 0
    finally:
        spark.conf.unset(name)
    sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_places_of_all_rows(spark):
    x = spark.range(100).select((F.col("id") % 7).alias("a"), "id").repartition(5)
    got = ranks.over_parts(x, [], ["a", "id"], "place").orderBy("place").collect()
    assert [r.place for r in got] == list(range(100)) and [(r.a, r.id) for r in got] == sorted((i % 7, i) for i in range(100))
    assert ranks.over_parts(x.limit(0), [], ["a"], "place").count() == 0


def test_id_map_of_equal_lines(spark):
    old = spark.createDataFrame([(f"o{i}", f"f{i % 3}", f"l{i}", "same" if i % 2 else f"h{i}", i) for i in range(60)], "chunk_id string, file_id string, locator string, hash string, ord int")
    new = spark.createDataFrame([(f"n{i}", f"f{(i + 1) % 3}", f"l{i + 1}", "same" if i % 2 else f"h{i}", i) for i in range(0, 50)], "chunk_id string, file_id string, locator string, hash string, ord int")
    got = corpus.id_map(old, new).collect()
    assert sum(r.match_strategy == "unmatched" for r in got) == 10 and {r.new_chunk_id for r in got if r.new_chunk_id} == {f"n{i}" for i in range(50)}
    assert len({r.old_chunk_id for r in got}) == 60


def test_provenance_bounded(spark):
    x = spark.createDataFrame([("h", f"p{i:03}") for i in range(50)] * 2 + [("g", "p"), (None, "q")], "file_hash string, relative_path string").repartition(4)
    got = {r.file_hash: (r.n_paths, r.first_paths) for r in corpus.provenance_bounded(x, 5).collect()}
    assert got == {"h": (50, [f"p{i:03}" for i in range(5)]), "g": (1, ["p"]), None: (1, ["q"])}


def test_ordered_text(spark):
    rng = random.Random(1)
    rows = [("a", i, "x" * rng.randrange(0, 40) + str(i)) for i in range(300)] + [("b", 5, None), ("b", 6, ""), ("c", 1, "long " * 100), ("d", 0, "é"), (None, 3, "n"), (None, 2, "m"), ("e", -2000, "first"), ("e", 10**12, "last")]
    x = spark.createDataFrame(rows, "k string, at long, t string").repartition(6)
    got = {r.k: r.t for r in ranks.ordered_text(x, "k", "at", "t", limit=200, block=4).collect()}
    want = {}
    for k, at, t in sorted(rows, key=lambda r: r[1]):
        if t:
            want.setdefault(k, []).append(t)
    assert got == {k: "\n".join(v)[:200] for k, v in want.items()}


def test_a_very_long_key_is_not_held(spark):
    """One key of 40 MB: only the blocks that begin before the limit reach the last step."""
    x = spark.range(40_000).select(F.lit("k").alias("k"), "id", F.repeat(F.lit("x"), 1000).alias("t"))
    got = ranks.ordered_text(x, "k", "id", "t", limit=12_000)
    assert got.select(F.length("t")).first()[0] == 12_000
    near = [n for n in got._jdf.queryExecution().analyzed().toString().split("\n") if "Join" in n]
    assert near  # lengths are summed apart from the texts


def test_legs_fail_by_question(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(0, "good"), (1, "bad"), (2, "none"), (3, "good")], "query_id long, question string")

    def start():
        def embed(question):
            if question == "bad":
                raise RuntimeError("down")
            return None if question == "none" else [1.0, 4.0]

        return embed

    hits, states = legs.vector_leg(asked, vectors, start, ["question"], k=2, retries=0)
    assert {r.query_id: r.vector_error for r in states.collect()} == {0: None, 1: "RuntimeError: down", 2: "no vector", 3: None}
    assert sorted((r.query_id, r.doc_id) for r in hits.collect()) == [(0, 3), (0, 4), (3, 3), (3, 4)]
    keyword = spark.createDataFrame([(1, 7), (2, 7), (2, 8)], "query_id long, doc_id long")
    got = {r.query_id: (r.vector_status, r.keyword_status, r.tags) for r in legs.leg_states(states, hits, keyword).collect()}
    assert got == {0: ("ok", "empty", []), 1: ("failed", "ok", ["vector_failed"]), 2: ("failed", "ok", ["vector_failed"]), 3: ("ok", "empty", [])}


def test_rerank_falls_back_by_question(spark):
    rows = [(q, f"question {q}", f"d{i}", "x" * (9 - i), float(i), i) for q in range(3) for i in range(4)]
    x = spark.createDataFrame(rows, "query_id long, question string, document_key string, text string, fallback_score double, rank int")

    def start():
        def score(question, texts):
            if question.endswith("1"):
                raise RuntimeError("busy")
            return [float(len(t)) for t in texts][: 3 if question.endswith("2") else None]

        return score

    got = legs.rerank_calls(x, start, 2, "m", retries=0).orderBy("query_id", "final_rank").collect()
    assert [(r.query_id, r.document_key) for r in got] == [(0, "d0"), (0, "d1"), (1, "d3"), (1, "d2"), (2, "d3"), (2, "d2")]
    assert [r.fallback_reason for r in got[::2]] == [None, "reranker_failed:m", "reranker_failed:m"] and got[4].reranker_error == "wrong number of scores"


def test_index_reads_fewer_blocks_and_finds_the_same(spark, tmp_path):
    from quillmere.operators import index, retrieval

    rng = random.Random(2)
    common = [f"word{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(common, k=rng.randrange(3, 60)) + ["rare"] * (i % 50 == 0))) for i in range(1500)] + [(9000 + i, f"word{5 * (i % 2)} word1 word2 " * 20) for i in range(24)] + [(9990, ""), (9991, None)]
    docs = retrieval.tokenized(spark.createDataFrame(rows, "doc_id long, text string"), {"text": F.col("text"), "name": F.concat(F.lit("name "), F.col("doc_id").cast("string"))}).cache()
    asked = spark.createDataFrame([(0, "word1 word2"), (1, "rare word3"), (2, "word5"), (3, "nothing here"), (4, "word1 word2 absent word4"), (5, "name 77"), (6, "")], "query_id long, question string")
    index.build(docs, str(tmp_path), slot=8, buckets=4)
    for limit in (1, 5, 30):
        hits, effort = index.search(spark, str(tmp_path), asked, limit)
        want = sorted(map(tuple, retrieval.keyword_search(docs, asked, limit).collect()))
        assert sorted(map(tuple, hits.select("query_id", "doc_id", "keyword_score", "keyword_rank", "match_mode").collect())) == want
        read = {r.query_id: (r.read, r.blocks) for r in effort.collect()}
        assert all(a <= b for a, b in read.values())
        if limit < 30:
            assert all(read[q][0] < share * read[q][1] for q, share in ((0, 0.9), (2, 0.5))), read
    index.build(docs.limit(0), str(tmp_path))
    assert index.search(spark, str(tmp_path), asked)[0].count() == 0


def shuffled_rows(spark, action):
    """Rows that the stages of an action wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        x = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")())
        return {(x.apply(i).stageId(), x.apply(i).attemptId()): x.apply(i).shuffleWriteRecords() for i in range(x.size())}

    before = stages()
    got = action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return got, sum(n for k, n in stages().items() if k not in before)


def test_keyword_search_moves_counts_not_pairs_of_questions_and_documents(spark):
    from quillmere.operators import retrieval

    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    docs = retrieval.tokenized(spark.createDataFrame([(i, " ".join(words[: 2 + i % 5] * (1 + i % 3)), None) for i in range(400)] + [(400, "", None), (401, None, None)], "doc_id long, text string, other string"), {"text": F.col("text"), "other": F.col("other")})
    asked = spark.createDataFrame([(q, " ".join([*words[q % 6 :], *words[: q % 6]])) for q in range(40)] + [(40, "nowhere"), (41, ""), (42, "alpha nowhere")], "query_id long, question string")
    one, moved = shuffled_rows(spark, lambda: sorted(map(tuple, retrieval.keyword_search(docs, asked, 5).collect())))
    assert moved < 12_000  # 40 questions of 6 words that nearly all of 400 documents hold are 70,000 pairs
    assert one == sorted(map(tuple, retrieval.keyword_search(docs, asked, 5, block=7).collect()))
    modes = {r[0]: (r[4], r[1]) for r in one if r[3] == 0}
    assert set(modes) == {*range(40), 42} and all(m[0] == "strict" for q, m in modes.items() if q < 40 and q % 6 == 0)
    assert modes[42][0] == "relaxed" and all(sum(r[0] == q for r in one) == 5 for q in modes)
    assert retrieval.keyword_search(docs, asked.where("query_id = 41")).count() == 0


def test_nearest_vectors_take_bounded_memory(spark, monkeypatch):
    import tracemalloc

    import numpy as np
    import pandas as pd

    from quillmere.operators import retrieval

    rng = np.random.default_rng(0)
    ids, vectors = rng.permutation(8000), rng.integers(-2, 3, (8000, 8)).astype(float)
    vectors[:, 0] += 0.5  # none is zero
    asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids[:1500], vectors[:1500], strict=True)], "vec_id long, embedding array<double>")
    caught = []
    real = type(asked).mapInPandas
    monkeypatch.setattr(type(asked), "mapInPandas", lambda self, f, schema: caught.append(f) or real(self, f, schema))
    retrieval.cosine_topk(asked, asked, 5)
    frames = [pd.DataFrame({"vec_id": ids[a:b], "embedding": list(vectors[a:b])}) for a, b in ((0, 7000), (7000, 7003), (7003, 8000))]
    tracemalloc.start()
    got = pd.concat(caught[0](iter(frames)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all cosines of 1500 and 7000 vectors at once are 84 MB, and their order as much again, several times
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for at in (0, 700, 1499):
        cos = np.round(unit @ unit[at], 9)
        cos[at] = -2
        best = np.lexsort((ids, -cos))[:5]
        mine = got[got["query_id"] == ids[at]].sort_values(["cosine", "vec_id"], ascending=[False, True])
        assert mine["vec_id"].tolist() == ids[best].tolist() and mine["cosine"].tolist() == cos[best].tolist()


def test_stems_need_no_more_cuts_than_letters_beyond_four(spark):
    import re

    from quillmere.functions import text

    def plain(t):
        while len(t) > 4 and (cut := re.sub(text.ENDINGS, "", t, count=1)) != t:
            t = cut
        return t

    words = ["ами", "мама", "мамам", "аяяяя", "еееееееее", "иямиямиями", "программами", "ыыыы", "ооооо", "дома", "словарями", "abcdeами", "английскими", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s"))
    assert all(r.s == plain(r.w) for r in df.collect())
    plan = spark.range(1).select(text.stem(F.col("id").cast("string")).alias("s"))
    assert "sequence(5, length" in plan._jdf.queryExecution().analyzed().toString()


def test_no_task_writes_all_of_a_bucket(spark, tmp_path):
    from quillmere.operators import index, retrieval

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 300}" for j in range(40))) for i in range(200)], "doc_id long, text string")
    tokenized = retrieval.tokenized(docs, {"body": F.col("text")})
    index.build(tokenized, str(tmp_path / "one"), buckets=2)
    index.build(tokenized, str(tmp_path / "some"), buckets=2, at_once=500)
    files = lambda root: sorted(p.parent.name for p in (tmp_path / root / "postings").glob("bucket=*/*.parquet"))
    assert files("one") == ["bucket=0", "bucket=1"] and files("some") == ["bucket=0"] * 8 + ["bucket=1"] * 8  # 8,000 tokens
    held = lambda root: sorted((r.term, r.slot, r.n) for r in index._postings(spark, str(tmp_path / root))[0].collect())
    assert held("one") == held("some")


def test_default_vectors_shuffle_each_text_once(spark):
    from quillmere.operators import embedding

    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "c"), (1, "b"), (None, "a")], "doc_id long, text string")
    made = embedding.hashed(docs, "doc_id", "text", 8)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # and not a row for each key and dimension
    got = {r.doc_id: r.embedding for r in made.collect()}
    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % 8
    want = lambda ts: [1 + math.log(n) if (n := sum(place(t) == d for t in ts)) else 0.0 for d in range(8)]
    assert got == {1: pytest.approx(want("abab")), 3: pytest.approx(want("c")), None: pytest.approx(want("a"))}


def test_hints_leave_a_task_as_few_rows_as_are_wanted(spark):
    from quillmere.operators import retrieval

    r = random.Random(5)
    texts = [(None if i == 3 else i + 2**60, r.choice([None, "", " ".join(r.choices(["as", "basin", "sin", "a.in", "tin"], k=4))])) for i in range(600)]
    items = [(7, ["as", "as", "sin"]), (8, []), (9, ["in", "zz"]), (9, ["tin"]), (None, ["bas"])]
    docs = spark.createDataFrame(texts, "doc_id long, t string").repartition(3)
    got = retrieval.most_hints(docs, items, 4).collect()
    assert len(got) <= 3 * 4 * len(items)  # each document holds some hint, and was a row for each item
    held = lambda ws, t: sum(w in (t or "") for w in ws)
    for item in (7, 8, None):
        ws = next(w for i, w in items if i == item)
        want = sorted(((-held(ws, t), d is not None, d or 0) for d, t in texts if held(ws, t)))[:4]
        assert sorted((-x.score, x.doc_id is not None, x.doc_id or 0) for x in got if x.item_id == item)[:4] == want
    assert {x.score for x in got if x.item_id == 9} == {1}
    assert retrieval.most_hints(docs, [(1, [])], 4).count() == 0


def test_default_vectors_count_tokens_within_their_row(spark):
    from quillmere.functions import text
    from quillmere.operators import embedding

    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 37}" for j in range(500))) for i in range(60)] + [(60, "--"), (61, None), (7, "w1 w1")], "doc_id long, text string")
    made = embedding.hashed(docs, "doc_id", "text", 8)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()  # no row for each token
    of_tokens = embedding.hashed(docs.select("doc_id", text.tokens(F.col("text")).alias("ts")), "doc_id", "ts", 8)
    got = sorted(map(tuple, made.collect()))
    assert got == sorted(map(tuple, of_tokens.collect())) and [r[0] for r in got] == [*range(60)]
    place = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:6], 16) % 8
    ts = [f"w{7 * j % 37}" for j in range(500)] + ["w1", "w1"]
    assert got[7][1] == pytest.approx([1 + math.log(n) if (n := sum(place(t) == d for t in ts)) else 0.0 for d in range(8)])


def test_both_legs_read_the_same_tokens(spark, sf, monkeypatch):
    from quillmere.functions import text
    from quillmere.operators import embedding, retrieval
    from quillmere.plans import retrieval as plans

    made = []
    real = text.tokens
    for module in (embedding, retrieval):
        monkeypatch.setattr(module, "tokens", lambda c: made.append(str(c)) or real(c))
    assert plans._legs(spark, sf).count() > 0
    assert len([c for c in made if "text" in c]) == 1  # the questions' tokens are others


@pytest.mark.parametrize("most", [500_000, 2])
def test_wanted_terms_are_counted_within_their_row(spark, monkeypatch, most):
    from collections import Counter

    from quillmere.operators import retrieval

    monkeypatch.setattr(retrieval, "TERMS_AT_ONCE", most)
    rows = [(i, f"f{i % 2}", [f"w{i * j % 23}" for j in range(1, 2 + i % 40)]) for i in range(3000)] + [(None, "f0", ["w1"])]
    docs = spark.createDataFrame(rows, "doc_id long, field string, ts array<string>").withColumn("length", F.size("ts"))
    terms = spark.createDataFrame([("w1", 10), ("w0", 11), ("w22", 12), ("none", 13)], "term string, id long")
    made = retrieval.wanted_counts(docs, terms)
    if most > 4:
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    ids = {"w1": 10, "w0": 11, "w22": 12}
    want = sorted((d, f, len(ts), k, n) for d, f, ts in rows if d is not None for k, n in [(-1, 1), *Counter(ids[t] for t in ts if t in ids).items()])
    assert sorted(map(tuple, made.select("doc_id", "field", "length", "id", "tf").collect())) == want


def test_counts_are_ranked_in_as_many_tasks_as_they_need(spark, monkeypatch):
    from quillmere.operators import retrieval

    docs = retrieval.tokenized(spark.createDataFrame([(i % 390, "alpha " * (1 + i % 7) + "beta") for i in range(400)], "doc_id long, text string"), {"text": F.col("text")})
    asked = spark.createDataFrame([(1, "alpha beta")], "query_id long, question string")
    one = sorted(map(tuple, retrieval.keyword_search(docs, asked, 50).collect()))
    parts = []
    real = type(docs).repartition
    monkeypatch.setattr(type(docs), "repartition", lambda self, n, *c: parts.append(n) or real(self, n, *c))
    monkeypatch.setattr(retrieval, "COUNTS_AT_ONCE", 64)
    assert sorted(map(tuple, retrieval.keyword_search(docs, asked, 50).collect())) == one and len({r[1] for r in one}) == len(one) == 50
    assert max(p for p in parts if isinstance(p, int)) >= 400 * 3 // 64


@pytest.mark.parametrize("most", [50_000, 1])
def test_gold_is_found_in_one_pass(spark, tmp_path, monkeypatch, most):
    from quillmere.operators import metrics
    from quillmere.plans import evaluation

    if most == 1:  # as if there were too many items for a task
        monkeypatch.setattr(evaluation, "_small", lambda x: False)
    r = random.Random(3)
    words = ["a", "b", "cc", "dé", "e-f"]
    items = [(i, " ".join(r.choices(words, k=7 + i % 3))) for i in range(60)]
    blank = lambda: r.choice([" ", "  ", "\n", "\t \n"])
    texts = [(i, "".join(w + blank() for w in r.choices(words, k=i % 90))) for i in range(400)] + [(400 + i, r.choice(["", "\n", "x "]) + t.replace(" ", blank()) + r.choice(["", "x", " x"])) for i, t in items] + [(900, None), (901, ""), (None, items[0][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((x.query_id, x.id) for x in evaluation.gold(spark, str(tmp_path)).collect())
    assert got == sorted((q, d) for q, t in items for d, x in texts if d is not None and x and t in " ".join(x.split())) and len(got) >= 60
    asked = spark.createDataFrame(items, "query_id long, gold_start string")
    if most > 1:
        made = metrics.holding(spark.createDataFrame(texts, "doc_id long, text string"), asked)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan  # texts neither move nor are read again
        assert metrics.holding(spark.createDataFrame(texts, "doc_id long, text string"), asked.limit(0)).count() == 0


def test_degraded_legs_read_the_same_tokens(spark, sf, monkeypatch):
    from quillmere.operators import embedding, retrieval
    from quillmere.plans import scale

    made = []
    real = retrieval.tokens
    for module in (embedding, retrieval):
        monkeypatch.setattr(module, "tokens", lambda c: made.append(str(c)) or real(c))
    assert scale.degraded_legs(spark, sf).count() > 0
    assert len([c for c in made if "text" in c]) == 1
