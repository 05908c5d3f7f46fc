"""A persisted keyword index in blocks: built once, and searched without reading blocks that can't reach a question's results.

    root/postings/bucket=<n>   (field, term, slot, n, most, docs): a block holds a term's documents of one slot in one field
    root/fields                (field, n, avgdl)
    root/terms                 (field, term, df)

A slot is a set of documents of about the same length and of bounded number, so no block grows with a term's frequency and a
block's documents have weights that are near each other. most is the greatest weight that a
block's documents have, without idf. Terms are dealt to buckets by hash and sorted within files: a search lists only its terms'
buckets, and row groups of other terms are skipped by their statistics. Block heads and block contents are columns of their
own, so the first pass over heads does not read postings.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quillmere.functions.text import content_tokens, relaxed_sets
from quillmere.operators.ranks import staged
from quillmere.operators.retrieval import B, K1, statistics, term_counts

#: Documents in a slot, on average, and the folders that terms are dealt to.
SLOT, BUCKETS = 256, 16
#: Tokens of the texts whose postings one task writes, on average: about 50 MB of them.
TOKENS_AT_ONCE = 1 << 20
#: Scores are compared with bounds that were summed in another order.
SLACK = 1e-6


def _weight(tf: Column, length: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avgdl))


def build(docs: DataFrame, root: str, slot: int = SLOT, buckets: int = BUCKETS, at_once: int = TOKENS_AT_ONCE) -> None:
    """Write the index of tokenized documents (field, doc_id, length, ts); an index that is there is replaced.

    Each bucket has as many files as its share of all tokens needs, a term's blocks in one of them, so no task's input grows with
    the texts but for that of a term which all documents hold.
    """
    spark = docs.sparkSession
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}")
    put(statistics(docs), "fields")
    fields = spark.read.parquet(f"{root}/fields")
    band = F.floor(4 * F.log2(F.col("total").cast("double"))).cast("int")
    bands = docs.groupBy(band.alias("band")).agg(F.approx_count_distinct("doc_id").alias("n"), F.sum("length").alias("tokens")).collect()  # four a doubling
    sizes, files = {r.band: r.n for r in bands}, max(1, -(-sum(r.tokens for r in bands) // (buckets * at_once)))
    within = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for b, n in sizes.items() for x in (b, max(1, -(-n // slot)))]), band), F.lit(1)) if sizes else F.lit(1)
    place = band.cast("long") * (1 << 40) + F.pmod(F.xxhash64("doc_id"), within)
    each = term_counts(docs.withColumn("slot", place), ("slot",)).join(F.broadcast(fields.select("field", "avgdl")), "field")  # a row for each field
    weight = _weight(F.col("tf"), F.col("length"), F.col("avgdl"))
    blocks = each.groupBy("field", "term", "slot").agg(F.count("*").cast("int").alias("n"), F.max(weight).alias("most"), F.collect_list(F.struct("doc_id", "tf", "length")).alias("docs"))
    dealt = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    file = (F.col("bucket") * files + F.pmod(F.xxhash64("term", F.lit("file")), F.lit(files))).cast("int")
    dealt.repartitionById(buckets * files, file).sortWithinPartitions("bucket", "term", "field").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
    spark.range(1).select(F.lit(buckets).alias("buckets"), F.lit(dealt.schema.json()).alias("postings")).write.mode("overwrite").parquet(f"{root}/shape")
    put(_postings(spark, root)[0].groupBy("field", "term").agg(F.sum("n").cast("long").alias("df")), "terms")


def _postings(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """All postings and the number of buckets."""
    shape = spark.read.parquet(f"{root}/shape").first()
    return spark.read.schema(StructType.fromJson(json.loads(shape.postings))).parquet(f"{root}/postings"), shape.buckets


def _wanted(spark: SparkSession, root: str, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the terms of sets (query_id, o, n, token), with idf and the sets' rows; and the same without the postings' contents."""
    postings, buckets = _postings(spark, root)
    fields, terms = spark.read.parquet(f"{root}/fields"), spark.read.parquet(f"{root}/terms")
    tokens = sets.select(F.col("token").alias("term")).distinct()
    idf = F.log(1 + (F.col("fn") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = terms.join(tokens, "term").join(F.broadcast(fields.select("field", F.col("n").alias("fn"), "avgdl")), "field")
    known = staged(known.select("field", "term", "avgdl", idf.alias("idf"), F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket")), "index-terms")
    some = [r.bucket for r in known.select("bucket").distinct().collect()]  # folders
    postings = postings.where(F.col("bucket").isin(some) if some else F.lit(False))
    joined = lambda p: p.join(known.drop("bucket"), ["field", "term"])
    return joined(postings), joined(postings.drop("docs"))


def _scores(blocks: DataFrame, sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, o, doc_id, score) of all documents of the chosen (query_id, o, slot) that hold every token of their set."""
    need = chosen.join(sets, ["query_id", "o"])
    hits = blocks.join(need, (F.col("term") == F.col("token")) & (blocks.slot == need.slot)).select("query_id", "o", "need", "token", "avgdl", "idf", F.explode("docs").alias("d"))
    each = hits.groupBy("query_id", "o", "need", "token", "d.doc_id").agg(F.max(F.col("idf") * _weight(F.col("d.tf"), F.col("d.length"), F.col("avgdl"))).alias("w"))
    return each.groupBy("query_id", "o", "need", "doc_id").agg(F.sum("w").alias("score"), F.count("*").alias("m")).where("m = need").select("query_id", "o", "doc_id", F.round("score", 9).alias("score"))


def search(spark: SparkSession, root: str, queries: DataFrame, limit: int = 30, first: int = 8) -> tuple[DataFrame, DataFrame]:
    """(hits, effort): what keyword_search gives for (query_id, question), and how many blocks each question had and read.

    For each token set the slots that hold all its tokens are bounded by the sums of their blocks' greatest weights. Slots are
    read in the order of their bounds: as many as hold `limit` times `first` documents at least, then all others whose bound
    reaches the limit-th score found. Ties at that score are read, so the rows are those of a search over everything.
    """
    q = queries.select("query_id", F.array_distinct(content_tokens(F.col("question"))).alias("ts")).where(F.size("ts") > 0)
    asked = q.select("query_id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("o"), F.col("ts").alias("s"))), F.transform(relaxed_sets(F.col("ts")), lambda s, i: F.struct((i + 1).alias("o"), s.alias("s"))))).alias("x"))
    sets = staged(asked.select("query_id", "x.o", F.size("x.s").alias("need"), F.explode("x.s").alias("token")), "index-sets")
    full, heads = _wanted(spark, root, sets)
    bound = heads.join(sets, F.col("term") == F.col("token")).groupBy("query_id", "o", "need", "token", "slot").agg(F.max(F.col("idf") * F.col("most")).alias("w"), F.sum("n").alias("held"), F.count("*").alias("blocks"))
    slots = bound.groupBy("query_id", "o", "need", "slot").agg(F.sum("w").alias("bound"), F.min("held").alias("held"), F.sum("blocks").alias("blocks"), F.count("*").alias("m"))
    order = Window.partitionBy("query_id", "o").orderBy(F.desc("bound"), "slot")
    slots = staged(slots.where("m = need").withColumn("before", F.sum("held").over(order) - F.col("held")), "index-slots")
    early = slots.where(F.col("before") < limit * first)
    found = staged(_scores(full, sets, early.select("query_id", "o", "slot")), "index-found")
    place = F.row_number().over(Window.partitionBy("query_id", "o").orderBy(F.desc("score"), "doc_id"))
    least = found.withColumn("p", place).where(F.col("p") == limit).select("query_id", "o", F.col("score").alias("least"))
    late = staged(slots.where(F.col("before") >= limit * first).join(least, ["query_id", "o"], "left").where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select("query_id", "o", "slot", "blocks"), "index-late")
    every = found.unionByName(_scores(full, sets, late.select("query_id", "o", "slot")))
    best = every.groupBy("query_id", "doc_id").agg(F.min(F.struct("o", (-F.col("score")).alias("s"))).alias("b"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("b", "doc_id")) - 1
    top = best.withColumn("keyword_rank", rank).where(F.col("keyword_rank") < limit)
    strict = F.min("b.o").over(Window.partitionBy("query_id")) == 0
    hits = top.withColumn("strict", strict).where("b.o = 0 or not strict").select("query_id", "doc_id", (-F.col("b.s")).alias("keyword_score"), "keyword_rank", F.when(F.col("strict"), "strict").otherwise("relaxed").alias("match_mode"))
    read = early.select("query_id", "blocks").unionByName(late.select("query_id", "blocks")).groupBy("query_id").agg(F.sum("blocks").alias("read"))
    effort = slots.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(read, "query_id", "left").fillna(0, ["read"])
    return hits, effort
