"""From raw documents to token files: the stages in order, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns documents' columns; the last one returns what the token files hold. Columns of
docs that are not named here pass through, whatever their names; ids may be null, repeat, and be as large as a long is. An empty
table passes all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmere.llm import decontaminate, mixing, text_join, token_files, toxicity
from quillmere.llm.common import new_path, stage, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier chain finds toxic.

    Null and empty texts have no features and are judged by the base rate, so they stay where most documents are clean. Equal
    texts fare alike, whatever their ids; whole texts are judged, however long. Without labels nothing is rejected.
    """
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"), toxicity.labels_categories())
    return toxicity.drop_toxic(docs, chain)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the least id, ids before null, then of the least hash of its text.

    Rows that repeat its id and text are left once. Null, empty and blank texts link with nothing and all stay.
    """
    return text_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a passage of the benchmark.

    Null and empty texts hold none and stay, as all do where the benchmark is empty or its texts are null. Rows that repeat an
    id are judged each by its own text.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings sources to their target weights: a document appears as often as it is taken.

    A null source is a source of its own, the last one. Null and empty texts have size 0 and are taken as often as their id's
    hash says. Rows that repeat an id share its hash and are taken alike, as are all rows without an id.
    """
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns what they hold: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts hold the end id alone. Rows that repeat an id stand side by side, by text; null ids come first.
    """
    path = new_path(spark, "pipeline-tokens")
    manifest = token_files.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path, manifest)


STAGES = [("toxicity", without_toxic), ("ngram_jaccard", without_near_copies), ("decontamination", without_benchmark), ("mixing", mixed), ("token_files", tokens)]

#: Classifiers, hashing and tokenizers have no SQL twin; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
