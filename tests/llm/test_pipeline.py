"""The stages in order, each against what its operator says about the same documents."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillmere.llm import decontaminate, mixing, text_join, toxicity


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    """What each stage returns, written and read again."""
    out, docs = {}, spark.read.parquet(f"{sf}/documents.parquet")
    out["start"] = docs
    for name, apply in corpus_pipeline.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        apply(spark, docs, sf).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages(spark, sf, kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "token_files"]
    assert all(kept[n].columns == kept["start"].columns for n in names[:-1])
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    scores = toxicity.score_chain(kept["start"], toxicity.fit_chain(kept["start"], labels, toxicity.labels_categories()))
    assert ids(kept["toxicity"]) == ids(scores.where("p_toxic < 0.5"))
    assert ids(kept["ngram_jaccard"]) == ids(text_join.jaccard_join(kept["toxicity"]).where("kept"))
    held = {r.doc_id for r in decontaminate.contaminated(kept["ngram_jaccard"], bench).collect()}
    assert ids(kept["decontamination"]) == [i for i in ids(kept["ngram_jaccard"]) if i not in held]
    copies = mixing.mix(kept["decontamination"]).where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    assert ids(kept["mixing"]) == ids(copies) == ids(kept["token_files"])


def test_run(spark, sf, kept):
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, kept["token_files"].collect()))


BIG = 1 << 60
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, h long, c0 string, copies long, key string, size long, fit string"


def words(n, seed):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """The documents with odd rows and clashing columns beside them."""
    where = tmp_path_factory.mktemp("odd")
    rows = [(BIG + 1, None), (BIG + 2, ""), (BIG + 3, " \n\t"), (BIG + 4, words(20_000, 1)), (BIG + 5, words(60, 2)), (BIG + 5, words(60, 2)), (BIG + 6, words(60, 2)), (None, words(60, 2)), (None, words(60, 3)), (None, None), (BIG + 7, words(60, 4)), (BIG + 7, words(60, 5)), (BIG + 8, "\x00́é" * 40)]
    extra = spark.createDataFrame([(i, t, None, None if i is None else "odd", 1, "r", 1, "c", 9, "k", 3, "f") for i, t in rows], CLASHING)
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(extra, allowMissingColumns=True)
    docs.write.parquet(f"{where}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{where}/{t}.parquet")
    return str(where), rows


def test_odd_rows_pass_all_stages(spark, odd, tmp_path):
    where, rows = odd
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns, left = docs.columns, {}
    for name, apply in corpus_pipeline.STAGES[:-1]:
        apply(spark, docs, where).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        left[name] = sorted(((r.doc_id, r.text) for r in docs.where(f"doc_id IS NULL OR doc_id >= {BIG}").select("doc_id", "text").collect()), key=str)
    assert left["toxicity"] == sorted(rows, key=str)
    alone = [r for r in rows if r[1] != words(60, 2)]
    assert left["ngram_jaccard"] == sorted([*alone, (BIG + 5, words(60, 2))], key=str) == left["decontamination"]
    sized = mixing.mix(spark.read.parquet(f"{tmp_path}/decontamination"))
    copies = {(r.doc_id, r.size): r.copies for r in sized.collect()}
    want = [r for r in left["decontamination"] for _ in range(copies[r[0], len((r[1] or "").split())])]
    assert left["mixing"] == want
    got = corpus_pipeline.STAGES[-1][1](spark, docs, where).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_empty_tables_pass_all_stages(spark, odd, tmp_path):
    where, _ = odd
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{where}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert corpus_pipeline.without_toxic(spark, docs, str(tmp_path)).count() == docs.count()
    assert corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).count() == docs.count()
