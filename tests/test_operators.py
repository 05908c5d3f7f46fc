"""Literal cases and brute-force twins of what SQL does not express."""

import hashlib
import hmac
import io
import json
import uuid
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmere.functions import ids, more, text
from quillmere.operators import chunking, metrics, packets, retrieval, runs
from quillmere.operators import records as ops
from quillmere.sources import readers
from quillmere.streaming import events as streams


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0]


def test_normalise(spark):
    assert one(spark, text.normalize(F.col("t")), t="ВОДИТЕЛЬ-ЭКСПЕДИТОРА") == "водител экспедитор"
    assert one(spark, text.content_tokens(F.col("t")), t="Как оформить возврат брака из магазина?") == ["оформит", "возврат", "брак", "магазин"]
    assert one(spark, text.content_tokens(F.col("t")), t="2") == ["2"]


def test_relaxed_sets(spark):
    assert one(spark, text.relaxed_sets(F.split("t", " ")), t="регулируетс ценоизменен") == [["ценоизменен"], ["регулируетс"]]
    many = one(spark, text.relaxed_sets(F.split("t", " ")), t=" ".join(f"термин{i}" for i in range(20)))
    assert len(many) <= 24 and ["термин18", "термин19"] in many
    assert one(spark, text.relaxed_sets(F.split("t", " ")), t="один") == []
    forty = one(spark, text.relaxed_sets(F.split("t", " ")), t=" ".join(f"т{i}" for i in range(40)))
    assert len(forty) == 24 and forty[0] == ["т0", "т1"] and forty[-1] == ["т38", "т39"]


def test_uuid5(spark):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    for name in ("", "a", "пример", "x" * 1000):
        assert one(spark, ids.uuid5(space, F.col("t")), t=name) == str(uuid.uuid5(uuid.UUID(space), name))


def test_citations(spark):
    check = lambda a: tuple(one(spark, text.citation_check(F.col("t"), F.array(F.lit("[S1] text"))), t=a))
    assert check("Said [S1].") == (True, [])
    assert check("Said [S2].") == (False, ["S2"])
    assert check("# Head\n\nSaid.") == (False, [])
    assert check("**Terms:**\nSaid [S1].") == (True, [])
    assert check("No indexed evidence was enough to answer.") == (True, [])


def test_chunks_of_words():
    words = " ".join(f"word{i}" for i in range(900))
    got = chunking.split(words, 400, 50)
    assert len(got) == 3 and all(chunking.count(c) <= 400 for _, c in got)
    assert all(words[a : a + len(c)] == c for a, c in got)
    assert {w for _, c in got for w in c.split()} == set(words.split())


@pytest.mark.parametrize("sample", ["", " \n ", "a", "a. b; c: d - e\n\nf" * 50, "x" * 3000, "один два. " * 300])
def test_chunks_cover(sample):
    got = chunking.split(sample, 40, 5)
    assert all(sample[a : a + len(c)] == c and chunking.count(c) <= 40 for a, c in got)
    covered = set()
    for a, c in got:
        covered |= set(range(a, a + len(c)))
    assert all(sample[i].isspace() for i in set(range(len(sample))) - covered)


def test_row_windows():
    table = "\n".join(["name | n", *(f"row{i} | {i}" for i in range(2, 40))])
    got = chunking.row_windows(table, 30)
    assert all(t.startswith("name | n") for t, _, _ in got)
    assert [r for _, a, b in got for r in range(a, b + 1)] == list(range(2, 40))


def frame(rows):
    return pd.DataFrame(rows, columns=["query_id", "source", "rank", "document_key", "content_key"])


def test_merge(spark):
    rows = [(1, "vector", 0, "a", "x"), (1, "vector", 1, "b", "y"), (1, "keyword", 0, "c", "x"), (1, "keyword", 1, "b", "z"), (1, "keyword", 2, "d", " "), (1, "keyword", 3, "e", " "), (1, "keyword", 4, "c", "w")]
    got = retrieval.merge_candidates(spark.createDataFrame(frame(rows))).orderBy("merge_rank").collect()
    assert [(r.document_key, r.vector_rank, r.keyword_rank, list(r.dropped)) for r in got] == [("a", 0, 0, ["c", "c"]), ("b", 1, 1, ["b"]), ("d", None, 2, []), ("e", None, 3, [])]


def test_fusion(spark):
    cols = "query_id long, merge_rank int, document_key string, vector_rank long, keyword_rank long"
    rows = [(1, i, f"v{i}", i, None) for i in range(3)] + [(1, 3 + i, f"k{i}", None, i) for i in range(3)] + [(1, 6, "n", None, None)]
    got = retrieval.fuse(spark.createDataFrame(rows, cols)).orderBy("fusion_rank").collect()
    assert [r.document_key for r in got] == ["v0", "k0", "v1", "k1", "v2", "k2", "n"]
    assert got[-1].rrf_score == 0 and got[0].rrf_score == pytest.approx(1 / 61)
    rows = [(1, 0, "vector", 0, None), (1, 1, "both", 10, 10), (1, 2, "keyword", None, 0)]
    assert [r.document_key for r in retrieval.fuse(spark.createDataFrame(rows, cols)).orderBy("fusion_rank").collect()] == ["both", "vector", "keyword"]


def test_backfill(spark):
    make = lambda keys: spark.createDataFrame([(1, k, i) for i, k in enumerate(keys)], "query_id long, document_key string, rank int")
    got = retrieval.backfill(make("ab"), make("bcde"), 4).orderBy("final_rank").collect()
    assert [r.document_key for r in got] == ["a", "b", "c", "d"]


def test_mmr_brute(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    top = retrieval.cosine_topk(v, v.where("vec_id in (0, 20)"), 30)
    got = retrieval.mmr(top, v, 30).toPandas()
    e = {r.vec_id: np.array(r.embedding, float) / np.linalg.norm(r.embedding) for r in v.collect()}
    for q, x in top.toPandas().sort_values("vector_rank").groupby("query_id"):
        left, out = list(zip(x["vec_id"], x["cosine"], strict=True)), []
        while left:
            score = [0.4 * c - 0.6 * max((e[i] @ e[o] for o in out), default=0) for i, c in left]
            out.append(left.pop(int(np.argmax(score)))[0])
        assert got[got.query_id == q].sort_values("mmr_rank")["vec_id"].tolist() == out


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 0), (1, "g", 1), (1, "b", 2)], "query_id long, id string, rank int")
    gold = spark.createDataFrame([(1, "g"), (1, "h"), (2, "z")], "query_id long, id string")
    got = {r.query_id: r for r in metrics.id_metrics(ranked, gold, 3).collect()}
    assert (got[1].recall, got[1].mrr) == (0.5, 0.5) and got[1].ndcg == pytest.approx(0.3868528072)
    assert not got[2].hit and got[2].ndcg == 0
    scored = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "query_id long, rank int, score int")
    assert metrics.own_ideal_ndcg(scored, 2).first().ndcg == pytest.approx(0.6309297536)


def test_calibration(spark):
    x = spark.createDataFrame([(True, 0.9), (False, 0.2), (False, 0.7)], "human boolean, score double")
    r = metrics.calibration(x).first()
    assert (r.accuracy, r.kappa, r.separation) == (pytest.approx(2 / 3), pytest.approx(0.4), pytest.approx(0.45))
    assert metrics.calibration(x.limit(0)).first().kappa is None


def docx() -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "<w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Terms</w:t></w:r></w:p><w:p><w:r><w:t>Return in </w:t></w:r><w:r><w:t>three days</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='{w}'><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def xlsx() -> bytes:
    s = "xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {s}><sheets><sheet name='Prices'/></sheets></workbook>")
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>item</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData><row><c t='s'><v>0</v></c><c><v>5</v></c></row><row><c/></row><row><c t='inlineStr'><is><t>x</t></is></c></row></sheetData></worksheet>")
    return out.getvalue()


RTF = b"{\\rtf1{\\fonttbl x}\\'cf\\u1086?\\par end}"


def test_mixed_corpus(spark, tmp_path):
    (tmp_path / "Dept").mkdir()
    files = {"Dept/a.docx": docx(), "Dept/b.xlsx": xlsx(), "c.rtf": RTF, "d.png": b"x", "e.rar": b"x", "f.docx": b"broken", ".hidden/g.txt": b"no", "~$a.docx": b"no", "h.txt": b"  "}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    x = readers.scan_files(spark, f"file://{tmp_path}")
    assert sorted(r.relative_path for r in x.collect()) == ["Dept/a.docx", "Dept/b.xlsx", "c.rtf", "d.png", "e.rar", "f.docx", "h.txt"]
    got = readers.extract(x, ocr=lambda data: ("scanned words", "flat_text")).toPandas()
    by = {k: v for k, v in got.groupby("relative_path")}
    assert by["Dept/a.docx"].sort_values("ordinal")[["source_type", "section", "text"]].values.tolist() == [["body", "Terms", "Terms"], ["body", "Terms", "Return in three days"], ["table", "Terms", "a | b"]]
    assert by["Dept/b.xlsx"]["text"].tolist() == ["item | 5\nx"] and by["c.rtf"]["text"].tolist() == ["По\nend"]
    assert by["d.png"]["text"].tolist() == ["scanned words"]
    assert {k: by[k]["status"].iloc[0] for k in ("e.rar", "f.docx", "h.txt")} == {"e.rar": "manifest_only", "f.docx": "failed", "h.txt": "no_text"}


def test_json_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é"), (2, None)], "b long, a string")
    readers.write_jsonl(rows, f"{tmp_path}/x")
    lines = sorted(r.value for r in spark.read.text(f"{tmp_path}/x").collect())
    assert json.loads(lines[0]) == {"a": "é", "b": 1} and list(json.loads(lines[0])) == ["a", "b"]
    assert sorted(map(tuple, readers.read_jsonl(spark, f"{tmp_path}/x", "a string, b long").collect()), key=lambda r: r[1]) == [("é", 1), (None, 2)]


def test_catalog(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"relative_path": "a", "status": "draft"}, {"relative_path": "a", "status": "active", "authoritative_rank": 2}, {"relative_path": " "}]')
    (tmp_path / "map.json").write_text('{"b": {"status": "archived"}}')
    (tmp_path / "bad.json").write_text('"x"')
    assert [tuple(r)[:3] for r in readers.load_catalog(spark, f"{tmp_path}/list.json").collect()] == [("a", "active", 2)]
    assert readers.load_catalog(spark, f"{tmp_path}/map.json").first().status == "archived"
    with pytest.raises(Exception, match="list or a mapping"):
        readers.load_catalog(spark, f"{tmp_path}/bad.json").collect()


def test_claims(spark):
    rows = [("k", 0, 1), ("k", 29, 2), ("k", 31, 3), ("k", 60, 4), ("k", 62, 5), ("j", 5, 6)]
    x = spark.createDataFrame(rows, "key string, m int, event_id long").select("key", F.timestamp_seconds(F.col("m") * 60).alias("claimed_at"), "event_id")
    assert sorted(tuple(r) for r in ops.first_claims(x).collect()) == [("j", 6), ("k", 1), ("k", 3), ("k", 5)]


def test_claims_at_the_edge(spark):
    rows = [("k", 0, 1), ("k", 30, 2), ("k", 30, 3), (None, 1, 4), (None, 40, 5), (None, 71, 6)]
    x = spark.createDataFrame(rows, "key string, m int, event_id long").select("key", F.timestamp_seconds(F.col("m") * 60).alias("claimed_at"), "event_id")
    assert {tuple(r) for r in ops.first_claims(x).collect()} == {("k", 1), (None, 4), (None, 5), (None, 6)}


def test_event_stream(spark, sf, tmp_path):
    src = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", F.when(F.col("event_id") % 2 == 0, "eval.completed").otherwise("nonsense").alias("event"), F.create_map(F.lit("status"), F.lit("ok")).alias("fields"))
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run finds nothing new
        streams.write_events(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    n = src.count()
    good, bad = spark.read.parquet(f"{tmp_path}/out/events"), spark.read.parquet(f"{tmp_path}/out/quarantine")
    assert good.count() + bad.count() == n and good.select("stream").distinct().collect()[0][0] == "evals"
    assert bad.select("rejected").distinct().collect()[0][0] == "unsupported event"


def test_text_forms(spark):
    x = spark.createDataFrame([("Ｆｕｌｌ  ＷＩＤＴＨ ß",), ("Plain  Text",), (None,)], "t string").select(more.match_text(F.col("t")).alias("x"))
    assert [r.x for r in x.collect()] == ["full width ss", "plain text", None]


def test_pseudonyms(spark):
    got = one(spark, more.pseudonym(F.col("t"), "key"), t=" A@b.c ")
    assert got == hmac.new(b"key", b"a@b.c", hashlib.sha256).hexdigest()[:16]


def test_sorted_json(spark):
    x = spark.createDataFrame([('q"é\n', 3, None)], "b string, a long, c string").select(more.sorted_json({k: F.col(k) for k in "bac"}).alias("x"))
    assert x.first().x == json.dumps({"a": 3, "b": 'q"é\n', "c": None}, ensure_ascii=False)


def test_promotion(spark):
    for name, n in (("chunks_a", 3), ("chunks_b", 4), ("terms_b", 2)):
        spark.range(n).createOrReplaceTempView(f"v_{name}")
        spark.sql(f"CREATE OR REPLACE TEMP VIEW {name} AS SELECT * FROM v_{name}")
    none = spark.createDataFrame([], "code string, subject string")
    with pytest.raises(ValueError, match="gates failed"):
        runs.promote(spark, {"live": "chunks_b"}, spark.createDataFrame([("x", "y")], "code string, subject string"), {})
    with pytest.raises(ValueError, match="rows"):
        runs.promote(spark, {"live": "chunks_b"}, none, {"live": 5})
    assert runs.shadow_name("chunks", "run_1") == "chunks__shadow__run_1"
    with pytest.raises(ValueError, match="run id"):
        runs.shadow_name("chunks", "../x")


def test_alias_moves_back(spark, tmp_path):
    for name, n in (("old_t", 2), ("new_t", 5)):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{tmp_path}/{name}' AS SELECT id FROM range({n})")
    none = spark.createDataFrame([], "code string, subject string")
    assert runs.promote(spark, {"live_alias": "old_t"}, none, {"live_alias": 2}) == {"live_alias": None}
    with pytest.raises(Exception):  # noqa: B017  the second table does not exist
        runs.promote(spark, {"live_alias": "new_t", "other_alias": "absent_t"}, none, {"live_alias": 5})
    assert runs.active(spark, "live_alias") == "old_t" and spark.table("live_alias").count() == 2
    for sql in ("DROP VIEW IF EXISTS live_alias", "DROP TABLE IF EXISTS quillmere_aliases", "DROP TABLE IF EXISTS old_t", "DROP TABLE IF EXISTS new_t"):
        spark.sql(sql)


def test_annotated(spark):
    x = spark.createDataFrame([(1, "a", 3.0, None), (1, "b", 5.0, None), (1, "c", 1.0, 7)], "query_id long, id string, score double, rank int")
    assert {r.id: r.rank for r in packets.annotated(x, F.desc("score"), "rank").collect()} == {"b": 0, "a": 1, "c": 7}


def test_run_traces(spark):
    x = spark.createDataFrame([("t1", None, 1, "r"), ("t2", None, 9, None), ("t1", "p", 2, None)], "trace_id string, parent string, time long, run_id string")
    assert sorted(r.time for r in packets.run_traces(x, "r").collect()) == [1, 2]
    assert [r.time for r in packets.run_traces(x, "other").collect()] == [9]


def test_gold_short_items(spark, tmp_path):
    """Items of fewer than six words, or with a cut last word, are found as the SQL's contains finds them."""
    from quillmere.plans import evaluation

    long = "a b c d " + "x" * 90
    spark.createDataFrame([(1, "one two"), (2, long), (3, "f g h i j k l")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(10, "say one  two three"), (11, long), (12, "e f g h i j k l m"), (13, "two one")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.query_id, r.id) for r in evaluation.gold(spark, str(tmp_path)).collect()) == [(1, 10), (2, 11), (3, 12)]


def test_metric_names():
    from quillmere.operators import audit

    assert audit.metric_names(" ") == ["faithfulness", "answer_relevancy"]
    assert audit.metric_names("Response-Relevancy, id_based_context_recall") == ["answer_relevancy", "id_context_recall"]
    assert audit.metric_names("off", allow_none=True) == []
    with pytest.raises(ValueError, match="unsupported metrics: bleu"):
        audit.metric_names("bleu,faithfulness")


def test_collection_identity(spark, tmp_path):
    from quillmere.operators import embedding

    docs = spark.createDataFrame([(1, "one two two"), (2, None), (3, "three"), (3, "three")], "chunk_id long, embedding_text string")
    model = embedding.default_provider(8)
    rows = embedding.index_vectors(docs, model)
    assert sorted((r.chunk_id, r.error) for r in rows.collect() if r.error) == [(2, "no vector"), (3, "repeated id 3"), (3, "repeated id 3")]
    good, path = rows.where("error is null"), str(tmp_path / "c")
    embedding.write_collection(good, path, model.identity)
    embedding.write_collection(good, path, model.identity)
    assert spark.read.parquet(f"{path}/vectors").count() == 2 and embedding.read_identity(spark, path) == model.identity
    with pytest.raises(ValueError, match="configuration names"):
        embedding.write_collection(good, path, embedding.default_provider(16).identity)
    embedding.write_collection(good, path, embedding.default_provider(16).identity, reset=True)
    assert embedding.read_identity(spark, path).embedding_dimensions == 16


def test_read_lines(spark, tmp_path):
    from quillmere.sources import readers

    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": \n{"id": 4}\n')
    rows, errors = readers.read_lines(spark, str(tmp_path / "a.jsonl"), "id long")
    assert sorted(map(tuple, rows.collect())) == [(1, 1), (4, 4)] and [(r.line, r.message) for r in errors.collect()] == [(3, "not valid JSON")]
    rows, errors = readers.read_lines(spark, str(tmp_path / "none.jsonl"), "id long")
    assert rows.count() == 0 and errors.first().message == "required artifact missing"


def test_settings():
    from quillmere.sources import settings

    env = settings.parse_env("# c\nexport A='x y'\nB= \nC=7\nD=seven\nE=on\n")
    assert (settings.text(env, "A"), settings.text(env, "B", "d"), settings.whole(env, "C"), settings.whole(env, "D", 3), settings.whole(env, "C", least=9), settings.flag(env, "E"), settings.flag(env, "B", True)) == ("x y", "d", 7, 3, 9, True, True)


def test_missing_scores_count_nothing(spark):
    row = spark.createDataFrame([("b", "a", "p", 0)], "q string, t string, p string, r int")
    got = row.select(retrieval.fallback_score(F.col("q"), F.col("t"), F.col("p"), {"vector_rank": F.col("r")})).first()[0]
    assert got == pytest.approx(1.3)


def test_stem_long_word(spark):
    from quillmere.functions import text

    word = "слово" + "ами" * 40
    assert spark.createDataFrame([(word,)], "w string").select(text.stem(F.col("w"))).first()[0] == "слов"
