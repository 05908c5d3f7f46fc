"""Claims in streams, ingestion runs, provider calls with memo and judges, payloads of any shape."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmere.functions import payload as pay
from quillmere.operators import audit, ingest, judging, ocr, providers
from quillmere.operators.records import first_claims
from quillmere.streaming.claims import claims, keyed_state

CLAIM = "key long, claimed_at timestamp, event_id long"
START = datetime(2024, 1, 1)


@pytest.mark.parametrize("batches", [1, 5])
def test_streamed_claims(spark, tmp_path, batches):
    """Any split into batches gives the winners of the batch form, late and repeated claims included; no state is left."""
    rng = random.Random(batches)
    rows = [(rng.randrange(6), START + timedelta(minutes=rng.randrange(2000)), i) for i in range(300)]
    sent = sorted(rows + rng.sample(rows, 60), key=lambda r: r[1] + timedelta(minutes=rng.randrange(170)))
    with keyed_state(spark):
        for k in range(batches):
            part = sent[k * len(sent) // batches : (k + 1) * len(sent) // batches] + ([(0, START + timedelta(days=30), None)] if k == batches - 1 else [])
            spark.createDataFrame(part, CLAIM).write.mode("append").parquet(f"{tmp_path}/in")
            stream = claims(spark.readStream.schema(CLAIM).parquet(f"{tmp_path}/in"))
            save = lambda x, n: x.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
            q = stream.writeStream.outputMode("append").foreachBatch(save).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    got = [(r.key, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted((r.key, r.event_id) for r in first_claims(spark.createDataFrame(rows, CLAIM)).collect())
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


FILE = "file_id string, relative_path string, file_hash string, size_bytes long, source_type string, text string"


def corpus(spark, texts):
    return spark.createDataFrame([(k, f"a/{k}.txt", str(hash(t)), len(t), "text", t) for k, t in texts.items()], FILE)


def published(spark, root):
    """All that readers see: manifest without the runs' names, chunks, vectors, postings."""
    out = [sorted(map(tuple, ingest.manifest(spark, root).drop("segment").collect()))]
    return out + [sorted(map(str, ingest.active(spark, root, n).drop("segment").collect())) for n in ("chunks", "vectors", "postings")]


def test_ingestion_equals_a_rebuild(spark, tmp_path):
    one = {"a": "first text. more words here", "b": "second text", "c": "", "d": "goes away", "e": "same"}
    two = {"a": "first text. more words here", "b": "second text, revised", "c": "no longer empty", "e": "same", "f": "same"}
    assert ingest.run_ingestion(corpus(spark, one), f"{tmp_path}/x", "r1")["new"] == 5
    done = ingest.run_ingestion(corpus(spark, two), f"{tmp_path}/x", "r2")
    assert (done["new"], done["changed"], done["kept"], done["removed"], done["wrote"]) == (1, 2, 2, 1, True)
    ingest.run_ingestion(corpus(spark, two), f"{tmp_path}/y", "all")
    assert published(spark, f"{tmp_path}/x") == published(spark, f"{tmp_path}/y")
    written = lambda: sorted(str(p) for p in (tmp_path / "x").rglob("*"))
    before = written()
    again = ingest.run_ingestion(corpus(spark, two), f"{tmp_path}/x", "r3")
    assert not again["wrote"] and again["run"] == "r2" and written() == before
    read = spark.read.parquet(f"{tmp_path}/x/chunks/run=r2").select("file_id").distinct().collect()
    assert {r.file_id for r in read} == {"b", "c", "f"}  # kept files were not read again
    assert {r.file_id: r.duplicate_action for r in ingest.ledger(spark, f"{tmp_path}/x").collect()} == {"a": "unique", "b": "unique", "c": "unique", "e": "duplicate_group_member", "f": "duplicate_group_member"}
    ingest.compact(spark, f"{tmp_path}/x", "whole")
    assert ingest.manifest(spark, f"{tmp_path}/x").select("segment").distinct().collect()[0][0] == "whole"
    assert published(spark, f"{tmp_path}/x") == published(spark, f"{tmp_path}/y")
    assert ingest.run_ingestion(corpus(spark, two), f"{tmp_path}/x", "r4", recipe="200:0")["changed"] == 5


@pytest.mark.parametrize("step", ["chunks", "vectors", "postings", "manifest", "publish"])
def test_a_broken_run_is_unseen(spark, tmp_path, step):
    one, two = {"a": "first", "b": "second"}, {"a": "first", "b": "changed", "c": "new"}
    ingest.run_ingestion(corpus(spark, one), str(tmp_path), "r1")
    before = published(spark, str(tmp_path))

    def stop(at):
        if at == step:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        ingest.run_ingestion(corpus(spark, two), str(tmp_path), "r2", on_step=stop)
    assert ingest.active_run(spark, str(tmp_path)) == "r1" and published(spark, str(tmp_path)) == before
    assert ingest.run_ingestion(corpus(spark, two), str(tmp_path), "r2")["wrote"]
    ingest.run_ingestion(corpus(spark, two), f"{tmp_path}/fresh", "r1")
    assert published(spark, str(tmp_path)) == published(spark, f"{tmp_path}/fresh")


def test_ingestion_refuses(spark, tmp_path):
    x = corpus(spark, {"a": "one"})
    with pytest.raises(ValueError, match="several files"):
        ingest.run_ingestion(x.union(x), str(tmp_path), "r1")
    with pytest.raises(ValueError, match="not a run id"):
        ingest.run_ingestion(x, str(tmp_path), "../r1")
    with pytest.raises(ValueError, match="nothing is published"):
        ingest.active(spark, str(tmp_path), "chunks")
    ingest.run_ingestion(x, str(tmp_path), "r1")
    with pytest.raises(ValueError, match="published already"):
        ingest.run_ingestion(x, str(tmp_path), "r1")
    folder = ingest._Folder(spark, f"{tmp_path}/pointers")
    with pytest.raises(Exception, match="FileAlreadyExists"):  # of two writers of one pointer one fails
        folder.create(folder.names()[-1], "{}")


def test_calls_are_bounded_ordered_and_fail_as_rows(spark, tmp_path):
    def start():
        import threading

        now, most, lock = 0, 0, threading.Lock()

        def call(n):
            nonlocal now, most
            with lock:
                now += 1
                most = max(most, now)
            time.sleep(0.02)
            with lock:
                now -= 1
            if n % 5 == 0:
                raise RuntimeError(f"no {n}")
            if n % 7 == 0:
                time.sleep(1.2)
            return most

        return call

    rows = spark.range(1, 41).coalesce(1)
    got = providers.called(rows, ["id"], "most", "int", start, in_flight=8, retries=1, seconds=0.6, pause=0.001).collect()
    assert [r.id for r in got] == list(range(1, 41))
    for r in got:
        if r.id % 5 == 0:
            assert (r.most, r.error, r.attempts) == (None, f"RuntimeError: no {r.id}", 2)
        elif r.id % 7 == 0:
            assert (r.most, r.error) == (None, "deadline")
        else:
            assert 1 <= r.most <= 8 and r.error is None and r.attempts == 1


def test_a_dead_provider_does_not_hold_a_task(spark):
    def start():
        return lambda n: time.sleep(60)

    began = time.time()
    got = providers.called(spark.range(200).coalesce(1), ["id"], "x", "int", start, in_flight=4, seconds=0.3).collect()
    assert time.time() - began < 20 and {r.error for r in got} == {"deadline", "unresponsive"} and len(got) == 200


def test_retries_help(spark):
    def start():
        seen = set()

        def call(n):
            if n not in seen:
                seen.add(n)
                raise OSError("first time")
            return n * 2

        return call

    assert [tuple(r)[1:] for r in providers.called(spark.range(3).coalesce(1), ["id"], "x", "long", start, pause=0.001).collect()] == [(0, None, 2), (2, None, 2), (4, None, 2)]


IMAGE = "id int, file_hash string, image_id string, recipe string, image string, source_type string, file_name string, layout_route string"


def test_ocr_asks_once_for_each_image(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def start():
        def read(image):
            calls.add(1)
            if image == "broken":
                raise ValueError("bad image")
            return image

        return read

    rows = [(1, "h1", "p1", "r", "plain text", "pdf_page", "a.png", "page"), (2, "h1", "p1", "r", "plain text", "pdf_page", "a.png", "page"), (3, "h2", "p1", "r", "| a | b |\n| c | d |", "pdf_page", "a.png", "page"), (4, "h3", "p1", "r", "", "pdf_page", "a.png", None), (5, "h4", "p1", "r", "broken", "pdf_page", "a.png", ""), (6, "h5", "p1", "r", "few words", "embedded_image", "a.png", "page"), (7, "h6", "p1", "r", "There is no visible text", "pdf_page", "a.png", "page"), (8, None, None, None, "own bytes", "pdf_page", "flowchart.png", "rotated_page")]
    images = spark.createDataFrame(rows, IMAGE)
    read = lambda run, client=start: {r.id: (r.text, r.layout_route, r.cached, r.warning) for r in ocr.read_images(images, client, "dashscope:m", f"{tmp_path}/memo", run, retries=0).collect()}
    got = read("r1")
    assert calls.value == 7 and got[1] == got[2] == ("plain text", "page", False, None)
    assert got[3][1] == "table" and got[8][:2] == ("own bytes", "rotated_diagram")
    assert got[4][3] == "OCR returned empty text" and got[5][3] == "OCR failed: ValueError: bad image"
    assert got[6][3] == "OCR output rejected: decorative_or_too_short:2_tokens" and got[7][3] == "OCR output rejected: canned_no_text_response"
    again = read("r2")
    assert calls.value == 9  # the empty and the broken one
    assert {k: v[2] for k, v in again.items()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True, 8: True}
    none = read("r3", None)
    assert calls.value == 9 and none[1][0] == "plain text" and none[5][3] == "OCR client not configured"
    other = ocr.read_images(images.withColumn("recipe", F.lit("s")), start, "dashscope:m", f"{tmp_path}/memo", "r4", retries=0)
    assert other.where("cached").count() == 0 and calls.value == 16
    assert ocr.read_images(images.limit(0), start, "m", f"{tmp_path}/none", "r1").count() == 0


def test_judges(spark):
    rows = spark.createDataFrame([("a", "what is red", "red is red", ["red is", " "], "red"), ("b", " ", "x", ["x"], "x"), ("c", "q", "?!", ["c"], None), ("d", "slow", "slow", ["slow"], "slow"), ("e", "nan", "nan", [], "nan")], "id string, user_input string, response string, retrieved_contexts array<string>, reference string")

    def start():
        judge = judging.overlap_judge()

        def ask(metric, question, answer, contexts, reference):
            if question == "slow":
                time.sleep(1.5)
            return float("nan") if question == "nan" else judge(metric, question, answer, contexts, reference)

        return ask

    got = {(r.id, r.metric): (r.score, r.label, r.reason) for r in judging.judged(rows, list(judging.NEEDS), start, retries=0, seconds=0.5).collect()}
    assert len(got) == 20
    assert got["a", "faithfulness"] == (1.0, "scored", None) and got["a", "answer_relevancy"][0] == pytest.approx(2 / 3)
    assert got["b", "faithfulness"] == (None, "skipped", "missing_response_or_contexts") and got["b", "factual_correctness"][0] == 1.0
    assert got["c", "faithfulness"] == (None, "failed", "ValueError: nothing to judge") and got["c", "context_recall"][1] == "skipped"
    assert got["d", "faithfulness"] == (None, "failed", "deadline")
    assert got["e", "answer_relevancy"] == (None, "scored", None) and got["e", "faithfulness"][1] == "skipped"
    with pytest.raises(ValueError, match="unsupported"):
        judging.judged(rows, ["nonsense"])


def test_payloads(spark):
    rows = [(1, '{"a": 1}'), (2, "not json"), (3, None), (4, "[1, 2]"), (5, '"text"'), (6, ""), (7, "{}"), (8, '{"a": {"b": [1, {"c": null}]}}'), (9, '{"a": 1')]
    x = spark.createDataFrame(rows, "id int, t string").select("id", pay.payload(F.col("t")).alias("v"))
    assert {r.id: json.loads(r.j) for r in x.select("id", F.to_json("v").alias("j")).collect()} == {1: {"a": 1}, 8: {"a": {"b": [1, {"c": None}]}}} | {k: {} for k in (2, 3, 4, 5, 6, 7, 9)}
    assert [r[0] for r in x.orderBy("id").select(pay.field(F.col("v"), "$.a", "int")).collect()] == [1] + [None] * 8


def plain_nodes(value, path=""):
    for k, v in value.items():
        at = f"{path}.{k}" if path else k
        if v is not None:
            yield at, v
        if isinstance(v, dict):
            yield from plain_nodes(v, at)


def test_span_attributes_at_any_depth(spark):
    deep = {"a": {"b": {"c": {"d": {"e": [1, {"f": 2}]}}}}, "n": None, "s": "x", "t": True, "retrieval.documents": [{"document.id": "1"}]}
    rows = [(1, json.dumps(deep), None, None, None), (2, "bad {", '{"k": 1}', "plain", 2.5), (3, " ", '{"k": {"m": 1}}', '{"k": {"z": {"y": 1}}}', float("nan")), (4, None, None, None, None)]
    spans = spark.createDataFrame(rows, "id int, attributes string, span_attributes string, `attributes.over` string, `attributes.n` double")
    got = {r.id: {k: json.loads(v) for k, v in r.attributes.items()} for r in pay.span_attributes(spans, "id").collect()}
    assert got[1] == dict(plain_nodes(deep))
    assert got[2] == {"over": "plain", "n": 2.5}
    assert got[3] == {"k": {"m": 1}, "k.m": 1, "over": {"k": {"z": {"y": 1}}}, "over.k": {"z": {"y": 1}}, "over.k.z": {"y": 1}, "over.k.z.y": 1}
    assert got[4] == {}


def test_packet_report(spark, tmp_path):
    kind = "id string, gold_status string, expected_behavior string, lane string, question string, current_reference_answer string, current_reference_context_ids array<string>, review_notes array<string>, evidence array<struct<chunk_id:string,citation_id:string,relative_path:string,text:string>>"
    rows = [("p1", "resolved", "cite_answer", None, "Why?", "Because", ["c1", "c2"], [], [("c1", "t1", "a.txt", " one\n two ")]), ("p2", None, "x", "l", None, "", None, ["n"], None), ("p3", "s", "b", "l", "q", "a", [], None, [("c", None, "p", "word " * 120)])]
    x = spark.createDataFrame(rows, kind)
    got = {r.id: r.p for r in x.select("id", audit.packet_report().alias("p")).collect()}
    assert got["p1"] == "## p1\n\n- status: `resolved`\n- behavior: `cite_answer`\n- lane: `None`\n- question: Why?\n- current answer: Because\n- reference_context_ids: `c1, c2`\n\n### Review Notes\n- none\n\n### Evidence\n- `c1`\n  - citation: `t1`\n  - source: `a.txt`\n  - text: one two\n"
    assert "- reference_context_ids: ``\n\n### Review Notes\n- n\n\n### Evidence\n- none\n" in got["p2"]
    assert got["p3"].endswith("  - text: " + ("word " * 120)[:499].rstrip() + "...\n")
    audit.write_packets(x, f"{tmp_path}/md")
    assert sorted(line.value for line in spark.read.text(f"{tmp_path}/md").where("value LIKE '## %'").collect()) == ["## p1", "## p2", "## p3"]
