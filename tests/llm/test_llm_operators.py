"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmere.llm import byte_quality, decontaminate, main_text, mixing, near_vectors, queries, secrets, suffix_dedup, text_join, token_files, toxicity, training
from quillmere.llm.common import components, new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, h long, ids string, score double, comp string"
LARGER = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "k", 5, 6, "i", 0.5, "c") for r in rows], DOCS)


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, words(30000)), (6, words(40, 1)), (6, words(40, 1)), (7, words(40, 1)), (None, words(40, 1)), (None, None), (8, "\x00́é" * 40)]


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def groups(n, pairs):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return [top(i) for i in range(n)]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (60, 60)], "a long, b long")
    got = {r.id: r.comp for r in components(edges, "t").collect()}
    assert got == {i: 0 for i in range(21)} | {50: 50, 51: 50}
    assert components(edges.limit(0), "t").count() == 0


# 1: vectors


def brute_vectors(rows, similarity):
    ok = [r[1] is not None and len(r[1]) > 0 and r[2] is not None and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    unit = [np.asarray(r[1], float) / np.linalg.norm(np.asarray(r[1], float)) if o else None for r, o in zip(rows, ok, strict=True)]
    links = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= similarity] for i in range(len(rows))]
    comp = groups(len(rows), [(i, j) for i, x in enumerate(links) for j in x])
    least = defaultdict(lambda: 1 << 60)
    for i, c in enumerate(comp):
        least[c] = min(least[c], rows[i][0])
    return sorted((r[0], len(x), least[c]) for r, x, c in zip(rows, links, comp, strict=True))


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(120):  # a hot group of near copies, pairs, copies
        base = np.ones(16) if i < 60 else rng.normal(size=16)
        rows += [(2 * i, (base + rng.normal(size=16) * 0.1).tolist(), i % 2), (2 * i + 1, (base + rng.normal(size=16) * 0.1).tolist(), i % 2)]
    rows += [(900, rows[0][1], 0), (901, [2 * v for v in rows[0][1]], 0), (902, None, 0), (903, [0.0] * 16, 0), (904, [float("nan")] * 16, 0), (905, rows[0][1], None), (906, [1.0], 0), (907, [], 0), (908, [None] * 16, 0), (909, [float("inf")] + [0.0] * 15, 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, key string, comp long")
    got = near_vectors.near_vectors(df, block=32).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute_vectors(rows, 0.98)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_table(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in queries.op1_near_vectors(spark, sf).collect()) == brute_vectors(rows, 0.98)


# 2: pages


def test_main_text_windows_decide_on_bare_pages(spark):
    """On pages without a class, id, role, article or other tag that names a part, lengths alone find the article.

    What the article is comes from a pattern over the pages as they were.
    """
    pages = [r.html for r in spark.read.parquet(f"{LARGER}/pages.parquet").select("html").collect() if r.html]
    kept = wanted = out = leaked = every = 0
    for page in pages:
        inner = re.sub(r"(?s)<(script|style)\b.*?</\1>", " ", re.search(r"(?s)<article[^>]*>(.*?)</article>", page)[1])
        want = Counter(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        bare = re.sub(r"(?i)</?(article|main)\b[^>]*>", "", re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page))
        bare = re.sub(r"(?i)<(/?)(nav|footer|header|aside|section|form)\b[^>]*>", r"<\1div>", bare)
        got = Counter(main_text.main_text(bare).split())
        kept, wanted, out, leaked = kept + (want & got).total(), wanted + want.total(), out + got.total(), leaked + (got - want).total()
        every += got != Counter(" ".join(line for line, _, _ in main_text.lines(bare)).split())
    assert kept >= 0.95 * wanted and leaked <= 0.05 * out
    assert every == len(pages)  # all lines together would be another text on every page


def test_main_text_table(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op2_main_text(spark, sf).collect():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html.unescape(re.sub("</?b>", "", re.sub("<(?!/?b>)[^>]*>", " ", article))).split())
        assert (r.text, r.n_chars) == (want, len(want))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<html></html>", ""),
        ("<article><h1>A&amp;B</h1><p>x<p>y <b>z</b>w&#33;</article>", "A&B x y zw!"),
        ("<nav>n</nav><article><p>a</p><aside>s</aside><div class='ad'>ad</div><form><p>f</p></form><div id=comments><p>c</p></div><p>b</article><footer>f", "a b"),
        ("<article><p>a<!-- <p>no</p> --><script>var x='<p>';</script><style>p{}</style> b</p></article>", "a b"),
        ("<div class=menu><a href=#>m</a></div><p>" + "long text " * 20 + "</p><div class=cookie-notice>ok?</div>", ("long text " * 20).strip()),
        ("<article><p>a < b <" + "<p " * 5000, "a < b <"),
    ],
)
def test_main_text_cases(page, want):
    assert main_text.main_text(page).startswith(want) if page and page.endswith("<p ") else main_text.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>a wor<!-- x -->d<script>1</script>s here</p></article>", "a words here"),
        ("<article><p>before <span class='ad'>buy <span>now</span> cheap</span> after</p></article>", "before after"),
        ("<div class='search-algorithms'><p>" + "long text " * 20 + "</p></div>", ("long text " * 20).strip()),
        ("<article><div class='header-compression'><p>all of it</p></div></article>", "all of it"),
        ("<div id='page' class='sidebar-right'><p>" + "long text " * 20 + "</p></div>", ("long text " * 20).strip()),  # a hint that leaves nothing
        ("<main><h1>head</h1><article><p>" + "one " * 40 + "</p></article><article><p>" + "two " * 40 + "</p></article></main>", " ".join(["head", *["one"] * 40, *["two"] * 40])),
        ("<div><p>" + "one " * 40 + "</p><div class=ad>ad</div><p>short</p><div class=ad>ad</div><p>" + "two " * 40 + "</p></div><p>x</p>", " ".join([*["one"] * 40, "short", *["two"] * 40, "x"])),
        ("<article><h1><a href=#>Linked head</a></h1><p>text</p></article><section><h2>More</h2><p>teaser text outside</p></section>", "Linked head text"),
    ],
)
def test_main_text_hints(page, want):
    assert main_text.main_text(page) == want


def plain_between(got):
    """Line blocks one by one, without numpy: lengths, windows, surges and dives."""
    own = [len(t) if a else (len(t) - n if 2 * (len(t) - n) >= len(t) else 0) for t, n, a in got]
    marked = any(o for o, (_, _, a) in zip(own, got, strict=True) if a)
    weight = [o * (8 if a or not marked else 1) for o, (_, _, a) in zip(own, got, strict=True)]
    runs, k = [], 0
    while k + 2 < len(got):
        if sum(weight[k : k + 3]) == 0:
            k += 1
            continue
        e = k
        while e + 2 < len(got) and sum(weight[e : e + 3]) > 0:
            e += 1
        on = [i for i in range(k, min(e + 3, len(got))) if weight[i]]
        runs.append((on[0], on[-1] + 1, max(sum(weight[i : i + 3]) for i in range(k, e))))
        k = e
    if not runs:
        return ""
    top = max(r[2] for r in runs)
    kept = {i for i, r in enumerate(runs) if r[2] >= min(640, top) and r[2] * 8 >= top}
    art = {i for i, (a, b, _) in enumerate(runs) if any(got[x][2] for x in range(a, b))} if marked else set()
    out = []
    for i, (a, b, _) in enumerate(runs):
        if min(kept | art) <= i <= max(kept | art) and (i in kept or not marked or i in art):
            loose = sum(own[x] for x in range(a, b) if not got[x][2])
            mixed = i in art and any(not got[x][2] for x in range(a, b))
            out += [got[x][0] for x in range(a, b) if got[x][0] and (got[x][2] or not (mixed and loose < 640))]
    return " ".join(out)


def test_main_text_plain(spark):
    """The same text as a plain line-block version, on the table's pages, as they are and without the marks that name the article."""
    for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect():
        for page in (r.html, r.html.replace("article>", "div>"), re.sub("</?(article|nav|footer|b)>", "", r.html)):
            got = main_text.lines(page)
            while len(got) < 3:
                got.append(("", 0, False))
            assert main_text.main_text(page) == plain_between(got)


def test_main_text_built():
    """Pages built of known parts, with and without a marked article: how much text stays, how much boilerplate leaks."""
    rng = np.random.default_rng(14)
    kept = total = leaked = rest = 0
    for k in range(300):
        part = lambda n: words(int(n), int(rng.integers(1 << 30)))
        paragraphs = [part(rng.integers(12, 60)) if rng.random() < 0.85 else part(2) for _ in range(rng.integers(4, 15))]
        ad, note, side, foot, said = part(9), part(14), part(25), part(10), [part(rng.integers(10, 60)) for _ in range(4)]
        inner = [f"<p>{p}</p>" for p in paragraphs]
        inner.insert(len(inner) // 2, f"<div class='advert-box'><p>{ad}</p></div>")
        tag = ["article", "div", "main"][k % 3]
        menu = "".join(f"<li><a href='/{i}'>{part(2)}</a></li>" for i in range(8))
        page = f"<html><head><title>{part(5)}</title></head><body><header>{part(4)}</header><ul>{menu}</ul><div class=cookie-notice>{note}</div><{tag}>{''.join(inner)}</{tag}><aside>{side}</aside>"
        page += f"<section id=comments>{''.join(f'<p>{s}</p>' for s in said)}</section><form><label>{part(3)}</label><button>{part(1)}</button></form><div class='site-footer'>{foot}</div></body></html>"
        got = set(main_text.main_text(page).split())
        want, not_wanted = set(" ".join(paragraphs).split()), set(" ".join([ad, note, side, foot, *said]).split())
        kept, total, leaked, rest = kept + len(got & want), total + len(want), leaked + len(got & not_wanted), rest + len(not_wanted)
    assert kept >= 0.999 * total and leaked <= 0.001 * rest


def test_main_text_clash(spark):
    df = spark.createDataFrame([(1, "u", "<article>a</article>", "t", 9), (1, None, None, "t", 9)], "page_id long, url string, html string, text string, n_chars long")
    assert sorted((r.page_id, r.text, r.n_chars) for r in main_text.extract(df).collect()) == [(1, "", 0), (1, "a", 1)]
    assert main_text.extract(df.limit(0)).count() == 0


# 3: token files


def brute_tokens(rows):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(TOKENIZER), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def by_start(df):
    return [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.orderBy("start").collect()]


def test_token_files_table(spark, sf, docs):
    assert by_start(queries.op3_token_files(spark, sf)) == brute_tokens([(r.doc_id, r.text) for r in docs.collect()])


def test_token_files_odd(spark):
    rows = [*ODD, (9, "I'm 3.5 km..., <|endoftext|>. İ. A_.B ΑΣ. x")]
    path = new_path(spark, "test")
    manifest = token_files.write_tokens(documents(spark, rows), path, TOKENIZER)
    want = brute_tokens(rows)
    assert by_start(token_files.read_tokens(spark, path, manifest)) == want
    shard = manifest.orderBy("shard").first().shard
    doc_id, ids = token_files.read_document(path, shard, 0)
    assert (doc_id, len(ids)) == (want[0][0], want[0][2])
    empty = new_path(spark, "test")
    assert token_files.read_tokens(spark, empty, token_files.write_tokens(documents(spark, []), empty, TOKENIZER)).count() == 0


def test_token_files_dictionary(spark, docs):
    path = new_path(spark, "test")
    manifest = token_files.write_tokens(docs, path, TOKENIZER, dictionary_bytes=2048)
    assert len(token_files._Files(path).open("dictionary").read()) > 1000
    assert by_start(token_files.read_tokens(spark, path, manifest)) == brute_tokens([(r.doc_id, r.text) for r in docs.collect()])
    again = new_path(spark, "test")
    many = token_files.write_tokens(docs, again, TOKENIZER, shard_bytes=4096)
    assert many.count() > 5 and by_start(token_files.read_tokens(spark, again, many)) == brute_tokens([(r.doc_id, r.text) for r in docs.collect()])
    token_files._Files(path).write("dictionary", b"another")
    with pytest.raises(ValueError, match="dictionary"):
        token_files.read_document(path, manifest.first().shard, 0)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder(name, docs):
    """Pieces or whole texts: the ids are the library's own for the whole text."""
    from tokenizers import Tokenizer

    texts = [r.text for r in docs.limit(60).collect()] + ["I'm 3.5 km..., <|endoftext|>. İ. A_.B ΑΣ. x", "a\tb\u00a0c  d\r\ne", "x" * 500 + " ŒUVRE e\u0301 E\u0301.", "don't WE'LL 'sx 12,5", "", None]
    tok, encode = Tokenizer.from_file(public_tokenizers.path(name)), token_files.Encoder(public_tokenizers.path(name))
    assert encode.parted == (name == "word_bpe_49k.json")
    for _ in range(2):
        got = [np.frombuffer(b, encode.kind).tolist() for b in encode(texts, [1])]
        assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_token_files_named(spark):
    path = new_path(spark, "test")
    df = documents(spark, ODD).withColumn("doc_id", F.concat(F.lit("é"), F.col("doc_id")))
    got = token_files.read_tokens(spark, path, token_files.write_tokens(df, path, TOKENIZER), keep_ids=True).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted("None" if r[0] is None else f"é{r[0]}" for r in ODD)
    assert [r.start for r in sorted(got, key=lambda r: r.start)][0] == 0 and all(len(r.ids) == r.n_tokens for r in got)


def test_remembered():
    from quillmere.llm.common import Remembered

    rng, asked = np.random.default_rng(3), []
    known = Remembered(lambda ws: asked.append(len(ws)) or [w.upper() for w in ws], most=50, longest=6)
    for _ in range(200):
        ws = ["w%d" % min(rng.zipf(1.3), 10**7) for _ in range(40)]
        assert known(ws) == [w.upper() for w in ws]
        assert max(len(known.often), len(known.once)) <= 90
    assert sum(asked) < 200 * 40 // 2


# 4 and 7: classifiers


def labelled_rows(n):
    docs, labels = [], []
    for i in range(n):
        bad, junk = i % 4 == 0, i % 5 == 0
        docs.append((i, words(60, i) + (" vilewords%d" % (i % 7) if bad else "") + (" %%% ###" * 5 if junk else "")))
        labels.append((i, int(not junk), int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def classes(spark):
    docs, labels = labelled_rows(400)
    return documents(spark, [*docs, (None, None), (1000, ""), (1001, words(20000, 3)), (1002, "vilewords9 " + words(30, 9)), (1002, "vilewords9 " + words(30, 9))]), spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, classes):
    docs, labels = classes
    chain = toxicity.fit_chain(docs, labels, toxicity.labels_categories())
    got = toxicity.score_chain(docs, chain).collect()
    assert len(got) == docs.count() and all(0 <= r.p_toxic <= 1 for r in got)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum((r.p_toxic >= 0.5) == (r.doc_id % 4 == 0) for r in known) >= 396
    assert [r.p_toxic >= 0.5 for r in got if r.doc_id == 1002] == [True, True]  # a form that no label has
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(r.p_toxic < 0.5 for r in got)
    again = toxicity.fit_chain(docs, labels, toxicity.labels_categories())
    assert [r.p_toxic for r in sorted(toxicity.score_chain(docs, again).collect(), key=str)] == [r.p_toxic for r in sorted(got, key=str)]
    none = toxicity.fit_chain(docs, labels.limit(0), toxicity.labels_categories())
    assert toxicity.score_chain(docs.limit(0), none).count() == 0 and all(r.p_toxic < 0.5 for r in toxicity.score_chain(docs, none).collect())


def test_quality(spark, classes):
    docs, labels = classes
    net = byte_quality.fit_quality(docs, labels, F.col("quality"), F.lit(True))
    got = byte_quality.score_quality(docs, net).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    known = [r for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum((r.score >= 0.5) == (r.doc_id % 5 != 0) for r in known) >= 396
    none = byte_quality.fit_quality(docs, labels.limit(0), F.col("quality"), F.lit(True))
    assert byte_quality.score_quality(docs.limit(0), none).count() == 0


def test_quality_whole_text():
    """Junk at the very end of a long text, at any place of a chunk, is seen; tables by pairs give the plain convolution."""
    net = byte_quality.train([], np.zeros(0))
    rows, doc = byte_quality.chunks(["a" * 700, "", None, "é" * 130])
    assert doc.tolist() == [0, 0, 0, 1, 2, 3, 3]
    top, _ = byte_quality.convolve(rows, net.pairs())
    plain = np.array([[max(sum(net.filters[o][r[byte_quality.REACH + i + o], f] for o in range(byte_quality.WIDTH)) for i in range(byte_quality.CHUNK)) for f in range(byte_quality.FILTERS)] for r in rows])
    assert np.allclose(top, plain, atol=1e-4)
    assert byte_quality.repeats(byte_quality.chunks(["word " * 100])[0])[:, 0].max() == 1


@pytest.fixture(scope="module")
def marked(spark):
    """Labels of the larger table: id -> (quality, toxic)."""
    return {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect() if r.doc_id is not None}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_held_out(spark, marked):
    """Accuracy on rows whose labels were not learned from."""
    got = queries.op7_byte_quality(spark, LARGER).collect()
    assert all(r.held_out == held_out(r.doc_id) and r.predicted == int(r.score >= 0.5) for r in got)
    known = [(marked[r.doc_id][0], r.predicted) for r in got if r.held_out and r.doc_id in marked]
    assert len(known) > 80 and sum(a == b for a, b in known) >= 0.97 * len(known)


def test_toxicity_held_out(spark, marked):
    """Toxic rows found and clean ones left alone, on rows whose labels were not learned from."""
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit_chain(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1), toxicity.labels_categories())
    got = {r.doc_id: r.p_toxic >= 0.5 for r in toxicity.score_chain(docs, chain).collect()}
    known = [(marked[d][1], got[d]) for d in marked if held_out(d) and d in got]
    toxic, clean = [p for y, p in known if y], [p for y, p in known if not y]
    assert len(toxic) > 5 and sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_chain_plain(spark, classes):
    """The chain against a plain one: the same features one by one, and each model's sum written out."""
    docs, labels = classes
    chain = toxicity.fit_chain(docs, labels, toxicity.labels_categories())
    rows = docs.select("doc_id", "text").collect()
    want = []
    for r in rows:
        found = {chain.vocabulary[f] for w in re.findall(r"\w+|[^\w\s]+", (r.text or "").lower()) for f in [f"w:{w}", *(f"{k}:{w[:k]}" for k in range(3, 9) if len(w) >= k)] if f in chain.vocabulary}
        p = []
        for weights, earlier, bias in chain.models:
            x = bias + sum(weights[i] for i in found) + sum(d * np.log(q / (1 - q)) for d, q in zip(earlier, np.clip(p, 1e-4, 1 - 1e-4), strict=True))
            p.append(1 / (1 + np.exp(-x)))
        want.append((str(r.doc_id), *np.round(p, 9)))
    got = [(str(r.doc_id), round(r.p_low_quality, 9), round(r.p_toxic, 9)) for r in toxicity.score_chain(docs, chain).collect()]
    assert sorted(map(str, got)) == sorted(str((w[0], float(w[1]), float(w[2]))) for w in want)


def test_quality_plain():
    """A whole score against a plain one: every filter at every place of every chunk, then maximum and mean."""
    texts = [words(90, 3), "a b " * 100, "", "é%%%" * 70]
    net = byte_quality.train([*texts, *(words(40, k) for k in range(8))], np.array([1, 0, 0, 0, *[1] * 8], float), least_steps=20)
    got = byte_quality.predict(net, net.pairs(), texts)
    for t, p in zip(texts, got, strict=True):
        b = t.encode()
        per = []
        for c in range(max(1, -(-len(b) // byte_quality.CHUNK))):
            at = lambda i: b[i] if 0 <= i < len(b) else 0  # noqa: B023, E731
            top = [max(sum(net.filters[o][at(c * byte_quality.CHUNK + i + o), f] for o in range(byte_quality.WIDTH)) for i in range(byte_quality.CHUNK)) for f in range(byte_quality.FILTERS)]
            core = range(c * byte_quality.CHUNK, (c + 1) * byte_quality.CHUNK)
            best = [max(sum(at(i) == at(i - d) and at(i) != 0 for i in core[k : k + byte_quality.BLOCK]) for d in byte_quality.LAGS) / byte_quality.BLOCK for k in range(0, byte_quality.CHUNK, byte_quality.BLOCK)]
            per.append([*np.tanh(top), max(best), sum(best) / len(best)])
        x = np.r_[np.max(per, axis=0), np.mean(per, axis=0)]
        assert abs(p - 1 / (1 + np.exp(-(x @ net.weights + net.bias)))) < 1e-4


def test_labelled(spark):
    """Equal texts, equal ids and unequal labels: the same rows whatever their order."""
    rows = [(k, words(5, k % 20)) for k in range(100)] + [(3, words(6, 900))]
    labels = [(k, k % 2, 1) for k in range(100)] + [(k, 1 - k % 2, 0) for k in range(50)] + [(None, 1, 1), (7, None, 1)]
    got = []
    for seed in (1, 2):
        order = np.random.default_rng(seed).permutation(len(rows)), np.random.default_rng(seed + 5).permutation(len(labels))
        df, lab = documents(spark, [rows[i] for i in order[0]]).repartition(7), spark.createDataFrame([labels[i] for i in order[1]], "doc_id long, a int, b int")
        got.append(sorted(map(str, training.labelled(df, lab, ["a", "b"], 60).collect())))
    assert got[0] == got[1] and len(got[0]) <= 21


# 5: mixing


def brute_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        free = sum(weight[s] for s in names if s not in full)
        rate = (1.5 * sum(total.values()) - sum(2 * total[s] for s in full)) / free if free else 0
        new = {s for s in names if s not in full and weight[s] * rate > 2 * total[s]}
        if not new:
            break
        full |= new
    return total, {s: float(2 * total[s]) if s in full else weight[s] * rate for s in names}


def test_mix_hashes_at_edges(spark):
    """Hashes next to the edges of buckets of all levels fall on the right side of every threshold."""
    edges = sorted({h for bits in (48, 36, 24, 12) for k in (1, 2, 3, 1 << (60 - bits)) for h in ((k << bits) - 1, k << bits, (k << bits) + 1) if h < 1 << 60} | {0, (1 << 60) - 1})
    sized = spark.createDataFrame([("a", 1, h) for h in edges], "source string, size long, h long").cache()
    for left in range(1, len(edges) + 1, 5):
        src = spark.createDataFrame([("a", len(edges), float(left))], "source string, source_size long, target double")
        plan = mixing.thresholds(sized, src).first()
        assert len(edges) * plan.whole + sum(h < plan.below for h in edges) == left


@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_mix(spark, n):
    rows = [(i, words(i % 9 + 1, i), f"s{i % 5}" if i % 4 else None) for i in range(n)] + ([(3, None, "z"), (3, "a b", "s1"), (None, "c", "s1")] if n > 3 else [])
    df = documents(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    total, target = brute_mix(rows)
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == total[r.source] and r.target == pytest.approx(target[r.source], abs=1e-6) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= most[s] for s in target)
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, got))
    again = mixing.repeated(df)
    assert again.columns == df.columns and again.count() == sum(r.copies for r in got)


def test_mix_many_ties(spark):
    df = documents(spark, [(1, "a b", "x")] * 50 + [(2, "a", "y")])
    got = mixing.mix(df).collect()
    assert len({r.taken for r in got if r.doc_id == 1}) == 1


# 6: secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute_secrets(text):
    t = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found)), [sum(x[1] == k for x in found) for k in range(3)]


SECRETS = ["token: token: abcdefghij", "é𝄞 Password = 'hunter2hunter2' api_key:\"ab\" APIKEY=zzzzzzzzzz", "AKIA" + "A" * 11, "x" + "AKIA" + "Z9" * 8 + " " + "0f" * 16 + "g" + "0f" * 15, "secret=" + "0123456789abcdef" * 3, "passwd:short token==abcdefgh", "token=abcdefgh " * 700, "Zq3" * 9]


def test_secrets(spark, docs):
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(SECRETS)), *((200 + i, f"key Ab3{'x' * 30} copied", f"s{i}") for i in range(9)), (300, f"mine Ab4{'y' * 30}", "s1")]
    got = secrets.digest(secrets.scan_secrets(documents(spark, rows))).collect()
    want = [(r[0], *brute_secrets(r[1])[1], hashlib.sha256(brute_secrets(r[1])[0].encode()).hexdigest()) for r in rows]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got)
    spans = {r.doc_id: r.spans for r in got}
    assert spans[300] == f"opaque:5:{5 + 33}" and spans[200] == ""  # owner-specific stays, widely copied goes
    whole = queries.op6_secrets(spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.base_sha256 == hashlib.sha256(brute_secrets(text[r.doc_id])[0].encode()).hexdigest() for r in whole)
    assert secrets.scan_secrets(documents(spark, [])).count() == 0


# 8: repeated passages


def brute_removed(rows):
    data = [(t or "").encode() for _, t in rows]
    least = {}
    for (i, _), b in zip(rows, data, strict=True):
        for k in range(len(b) - 49 if i is not None else 0):
            least[b[k : k + 50]] = min(i, least.get(b[k : k + 50], i))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if i is not None else 0):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(left).hexdigest()))
    return sorted(map(str, out))


def removed(df, **how):
    return sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.deduplicate(df, **how).collect())


def test_suffix_dedup(spark):
    line = words(12, 5)
    rows = [*[r for r in ODD if r[0] != 5], (20, line), (21, "é" + line + "z" * 300), (22, words(30, 6) + line[10:70] + words(20, 7)), (23, "z" * 120), (24, line[:49]), (25, line[:50]), (26, "ab" * 200), (27, "ba" * 60), (28, "é" * 60), (19, "é" * 30 + line)]
    rows += [(40 + i, words(20, 100 + i) + line + words(20, 200 + i)) for i in range(30)]
    for crowd in (50_000, 20, 2):
        assert removed(documents(spark, rows), crowd=crowd) == brute_removed(rows)
    assert suffix_dedup.deduplicate(documents(spark, [])).count() == 0


def test_suffix_dedup_table(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in queries.op8_suffix_dedup(spark, sf).collect())
    assert got == brute_removed(rows)


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abcdef", bytes(range(256))])
def test_merged_transforms(letters):
    rng = np.random.default_rng(2)
    pool = [bytes(rng.choice(list(letters), n)) for n in rng.integers(50, 77, 12)]
    strings = [*dict.fromkeys([*pool, *(p[:60] + q[:10] for p, q in zip(pool, pool[1:], strict=False)), *(b"x" + p[1:] for p in pool)])]
    text = np.frombuffer(b"".join(strings), np.uint8)
    base = np.cumsum([0, *map(len, strings)])
    starts = [np.concatenate([np.arange(base[k], base[k + 1] - 49) for k in range(c, min(c + 9, len(strings)))]) for c in range(0, len(strings), 9)]
    packed, depths = suffix_dedup.symbols(text)
    shards = [suffix_dedup.transform(packed, at, depths) for at in starts]
    window = lambda p: text[p : p + 50].tobytes()
    for order, _ in shards:
        assert [window(p) for p in order] == sorted(window(p) for p in order)
    merged = suffix_dedup.merge(shards)
    got = [window(p) for p in merged]
    assert sorted(merged) == sorted(np.concatenate(starts)) and got == sorted(got)
    step = 50 - depths[0][0] if len(depths) == 1 else depths[-2][0]
    shared = lambda x, y: next((i for i in range(50) if x[i] != y[i]), 50)
    want = [n if n == 50 else n // step * step for n in (shared(x, y) for x, y in zip(got, got[1:], strict=False))]
    assert suffix_dedup.prefixes(packed, merged, depths)[1:].tolist() == want


def test_suffix_dedup_merge_decides(spark, monkeypatch):
    """Whatever goes, goes since an interval of the merged transforms says so."""
    strings = [words(12, 5).encode()[:70], words(12, 5).encode()[3:70]]
    assert suffix_dedup.least_ids(strings, np.array([7, 4]))[0].tolist() == [7] * 3 + [4] * 36
    docs = documents(spark, [(1, strings[0].decode()), (2, strings[1].decode())])
    assert sorted(r.n_removed for r in suffix_dedup.deduplicate(docs).collect()) == [0, 67]
    monkeypatch.setattr(suffix_dedup, "prefixes", lambda packed, merged, depths: np.zeros(len(merged), np.int64))
    assert suffix_dedup.least_ids(strings, np.array([7, 4]))[0].tolist() == [7] * 21 + [4] * 18


def test_suffix_dedup_pieces(spark, monkeypatch):
    """A document longer than a piece loses the same bytes as in one."""
    text = words(60, 5)
    rows = [(1, text), (2, words(9, 8) + text[30:200] + words(9, 9)), (3, text[100:])]
    data = [t.encode() for _, t in rows]
    whole = [seg for at, seg in suffix_dedup._chunked([1, 2, 3], data)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    parts = list(suffix_dedup._chunked([1, 2, 3], data))
    strings = lambda found: sorted({flat[i : i + 50] for flat, _, _, a, b, _ in found for p, q in zip(a, b, strict=True) for i in range(p, q + 1)})
    assert strings(whole) == strings([seg for _, seg in parts]) == sorted({t[i : i + 50] for t in data for i in range(len(t) - 49)})
    for at, (flat, _, _, a, _, doc) in parts:
        base = np.cumsum([0, *(n for _, _, n in at)])
        for i, d in zip(a, doc, strict=True):
            k, offset, _ = at[d]
            assert data[k][offset + i - base[d] :][:50] == flat[i : i + 50]


# 9: benchmark passages


def test_decontaminate(spark):
    item, other = words(30, 50), words(25, 51)
    parts = item.split()
    para = " ".join(p for i, p in enumerate(parts) if i % 5)  # a fifth of the words is gone
    rows = [*ODD, (20, words(100, 60) + " " + item + " " + words(100, 61)), (21, item.upper()), (22, words(300, 62)), (23, words(80, 63) + " " + para), (24, " ".join(parts[:8]) + " " + words(100, 64)), (25, words(9000, 65) + " " + other)]
    bench = spark.createDataFrame([(1, item, 0), (2, other, 0), (3, "", 0), (4, None, 0), (5, "a b", 0)], "item_id long, text string, doc_id long")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, rows), bench).collect())
    assert got == [(20, 1), (21, 1), (23, 1), (25, 2)]
    kept = decontaminate.drop_contaminated(documents(spark, rows), bench)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r[0]) for r in rows if r[0] not in (20, 21, 23, 25))
    assert decontaminate.contaminated(documents(spark, []), bench).count() == 0
    assert decontaminate.contaminated(documents(spark, rows), bench.limit(0)).count() == 0
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, rows), bench, items_at_once=1).collect()) == got


def test_decontaminate_table(spark, sf, docs):
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in norm(r.text)}
    assert want and want <= {(r.doc_id, r.item_id) for r in queries.op9_decontaminate(spark, sf).collect()}


def brute_contaminated(rows, items):
    """Every document against every item, each stretch of twice the item's length; short items side by side."""

    def common(a, b):
        table = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, table[j + 1] = table[j + 1], last + 1 if x == y else max(table[j], table[j + 1])
        return table[-1]

    found = lambda t: re.findall(r"\w+", (t or "").lower())
    out = set()
    for d, text in rows:
        t = found(text)
        for i, item, answer in items:
            w, a = found(item), found(answer)
            for s in range(max(1, len(t) - 2 * len(w) + 1) if t and len(w) >= 5 else 0):
                some = t[s : s + 2 * len(w)]
                shared = common(w, some)
                if shared >= 0.8 * len(w) - 1e-9 or shared >= 0.6 * len(w) - 1e-9 and common(a, some) >= 0.8 * len(a) - 1e-9:
                    out.add((d, i))
                    break
            if 0 < len(w) < 5 and any(t[s : s + len(w)] == w for s in range(len(t))):
                out.add((d, i))
    return out


def test_decontaminate_brute(spark):
    """Neither more nor fewer pairs than by brute force: verbatim, common, paraphrased, near the rule's edges, short and clean ones."""
    rng = np.random.default_rng(12)
    vocabulary = words(60, 91).split()
    items = [(i, " ".join(rng.choice(vocabulary, n)), None) for i, n in enumerate([5, 6, 9, 14, 14, 20, 27, 3, 1, 4])]
    items = [(i, t, " ".join(t.split()[-max(1, len(t.split()) // 4) :])) for i, t, _ in items]
    rows = []
    for k in range(70):
        t = items[k % 10][1].split()
        gone = rng.random(len(t)) < [0, 0.15, 0.25, 0.35, 0.45, 1][k % 6]
        changed = [rng.choice(vocabulary) if g else w for w, g in zip(t, gone, strict=True)]
        rows.append((k, " ".join([*words(int(rng.integers(0, 20)), 100 + k).split(), *changed, *rng.choice(vocabulary, int(rng.integers(0, 8)))])))
    bench = spark.createDataFrame(items, "item_id long, text string, answer string")
    want = brute_contaminated(rows, items)
    for at_once in (4000, 3):
        got = decontaminate.contaminated(documents(spark, rows), bench, answer="answer", items_at_once=at_once).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want) > 20
        kept = decontaminate.drop_contaminated(documents(spark, rows), bench, answer="answer", items_at_once=at_once)
        assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_decontaminate_many_items(spark):
    """Each of 1,000 items is found where a fifth of its words is replaced: no item falls out of the latent space."""
    rng = np.random.default_rng(9)
    vocabulary = words(4000, 70).split()
    texts = [rng.choice(vocabulary, 30) for _ in range(1000)]
    changed = [[w if i % 5 else rng.choice(vocabulary) for i, w in enumerate(t)] for t in texts]
    rows = [(i, " ".join([*rng.choice(vocabulary, 40), *t, *rng.choice(vocabulary, 40)])) for i, t in enumerate(changed)]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "item_id long, text string")
    got = decontaminate.contaminated(documents(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(1000)}


def test_decontaminate_hot_copies(spark):
    """Copies of a contaminated document that are most of all rows make its item's words common; all are found, as are items of common words only."""
    item, common = words(30, 80), " ".join(words(12, 81).split() * 2)
    rows = [(i, item + " " + words(5, 82)) for i in range(300)] + [(1000 + i, words(60, 90 + i) + " " + common) for i in range(100)] + [(2000, words(200, 83))]
    bench = spark.createDataFrame([(1, item), (2, common)], "item_id long, text string")
    want = {(i, 1) for i in range(300)} | {(1000 + i, 2) for i in range(100)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents(spark, rows), bench).collect()} == want
    assert [r.doc_id for r in decontaminate.drop_contaminated(documents(spark, rows), bench).collect()] == [2000]


@pytest.mark.parametrize("more", [0, 3000])
def test_decontaminate_replaced(spark, more):
    """Paraphrases that the rule accepts are found whatever the corpus's size: 38 % of the words, not the answer's, are replaced by words that no item has."""
    rng = np.random.default_rng(10)
    vocabulary, filler = words(200, 71).split(), words(300, 84).split()
    texts = [rng.choice(vocabulary, 40).tolist() for _ in range(40)]
    rows = []
    for i, t in enumerate(texts):
        gone = set(rng.choice(32, 15, replace=False).tolist())
        rows.append((i, " ".join([*rng.choice(filler, 50), *(rng.choice(filler) if k in gone else w for k, w in enumerate(t)), *rng.choice(filler, 50)])))
    rows += [(1000 + i, " ".join(rng.choice(vocabulary + filler, 200))) for i in range(more)]
    bench = spark.createDataFrame([(i, " ".join(t), " ".join(t[32:])) for i, t in enumerate(texts)], "item_id long, text string, answer string")
    got = decontaminate.contaminated(documents(spark, rows), bench, answer="answer").collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(40)} and all(0.6 <= r.shared < 0.8 and r.answer_shared >= 0.8 for r in got)


def test_decontaminate_each_stretch(spark):
    """A stretch with more of the item but no answer does not hide another one that the rule accepts."""
    t = words(40, 85).split()
    text = " ".join([words(100, 86), *t[:28], words(200, 87), *t[:17], words(15, 88), *t[32:], words(100, 89)])
    bench = spark.createDataFrame([(1, " ".join(t), " ".join(t[32:]))], "item_id long, text string, answer string")
    got = decontaminate.contaminated(documents(spark, [(1, text)]), bench, answer="answer").collect()
    assert [(r.doc_id, r.item_id, r.shared, r.answer_shared) for r in got] == [(1, 1, 0.625, 1.0)]


def test_gram():
    rng = np.random.default_rng(4)
    dense, sparse = decontaminate.Gram(40), decontaminate.Gram(40)
    sparse.dense, sparse.MOST = None, 10
    x = np.zeros((30, 40))
    for p in range(30):
        t = np.sort(rng.choice(40, rng.integers(1, 9), replace=False))
        w = rng.random(len(t)) + 0.1
        x[p, t] = w / np.linalg.norm(w)
        for g in (dense, sparse):
            g.add(np.full(len(t), p), t, w)
    test = rng.normal(size=(40, 3))
    for g in (dense, sparse):
        on, z = g.times(test)
        assert np.allclose(z, (x.T @ x @ test)[on], rtol=1e-12, atol=1e-12) and set(on) == set(np.flatnonzero(x.any(0)))


def test_lcs():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12).tolist(), rng.integers(-1, 5, 15).tolist()
        table = np.zeros((13, 16), int)
        for i in range(12):
            for j in range(15):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.lcs(a, b, decontaminate.places(a)) == table[-1, -1]


# 10: text join


def brute_join(rows):
    def shingles(t):
        w = (t or "").lower().split()
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    sets = [shingles(t) for _, t in rows]
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    near = {(i, j) for x in where.values() for i in x for j in x if i < j}
    pairs = [(i, j) for i, j in near if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    n, comp = [0] * len(rows), groups(len(rows), pairs)
    least = defaultdict(lambda: 1 << 60)
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    for i, c in enumerate(comp):
        least[c] = min(least[c], rows[i][0] if rows[i][0] is not None else 1 << 60)
    return sorted(str((r[0], n[i], None if least[comp[i]] == 1 << 60 else least[comp[i]])) for i, r in enumerate(rows))


def joined(df, **how):
    return sorted(str((r.doc_id, r.n_links, r.component_id)) for r in text_join.jaccard_join(df, **how).collect())


def test_jaccard_join(spark):
    base = words(80, 70).split()
    rows = [*[r for r in ODD if r[0] is not None], (20, " ".join(base)), (21, " ".join([*base[:79], "end"])), (22, " ".join(["start", *base[1:]])), (23, " ".join(base[:40])), (24, " ".join(base).upper()), (25, "one two"), (26, "one two"), (27, "two one")]
    rows += [(100 + i, " ".join([*base[: i % 40], f"v{i}", *base[i % 40 + 1 :]])) for i in range(80)]  # a group of near copies
    assert joined(documents(spark, rows)) == brute_join(rows)
    assert joined(documents(spark, rows), block=16, block_shingles=500) == brute_join(rows)
    assert joined(documents(spark, rows), crowd=4) == brute_join(rows)  # the group of near copies gets further trees
    assert text_join.jaccard_join(documents(spark, [])).count() == 0
    nulls = text_join.jaccard_join(documents(spark, [(None, "a b c d e f"), (5, "a b c d e f"), (None, None)])).collect()
    assert sorted(str((r.doc_id, r.n_links, r.component_id)) for r in nulls) == sorted(map(str, [(None, 1, 5), (5, 1, 5), (None, 0, None)]))


def test_jaccard_join_table(spark, sf, docs):
    want = brute_join([(r.doc_id, r.text) for r in docs.collect()])
    assert joined(docs) == want
    assert joined(docs, crowd=3) == want


def test_large_and_text_ids(spark):
    """Ids next to each other near 2^60, beside null ones, stay exact; ids of text keep their order."""
    rows = [((1 << 60) + i, words(40, i // 2)) for i in range(6)] + [(None, words(40, 9)), (None, None)]
    df = documents(spark, rows)
    want = sorted(str((i, None if i is None else (1 << 60) + (i - (1 << 60)) // 2 * 2)) for i, _ in rows)
    assert sorted(str((r.doc_id, r.component_id)) for r in text_join.jaccard_join(df).collect()) == want
    assert sorted(str(r.doc_id) for r in text_join.one_of_each(df).collect()) == sorted(str(i) for i, _ in rows if i is None or i % 2 == 0)
    gone = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicate(df).collect() if r.doc_id is not None}
    assert {i for i, n in gone.items() if n} == {i for i, _ in rows if i is not None and i % 2}
    text = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert sorted(str((r.doc_id, r.component_id)) for r in text_join.jaccard_join(text).collect()) == sorted(str((None if i is None else f"d{i}", None if i is None else f"d{(1 << 60) + (i - (1 << 60)) // 2 * 2}")) for i, _ in rows)
    assert sorted(map(str, (r.doc_id for r in mixing.mix(text).collect()))) == sorted("None" if i is None else f"d{i}" for i, _ in rows)
    assert sorted(map(str, (r.doc_id for r in secrets.scan_secrets(df).collect()))) == sorted(str(i) for i, _ in rows)


def test_one_of_each(spark):
    df = documents(spark, [(1, words(30, 1)), (2, words(30, 1)), (3, words(30, 2)), (3, words(30, 2)), (4, None), (5, "")])
    got = text_join.one_of_each(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5]


def test_prefix_depth():
    for recall in (0.9, 0.999, 0.99998):
        d = text_join.prefix_depth(0.8, recall)
        assert 1 - (1 - 0.8**d) ** text_join.TREES >= recall and (d == text_join.DEPTH or 1 - (1 - 0.8 ** (d + 1)) ** text_join.TREES < recall)


def test_intersections():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 200, rng.integers(1, 120)).astype(np.uint64)) for _ in range(25)]
    got = text_join.intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert i == j or got[i, j] == len(np.intersect1d(a, b))
