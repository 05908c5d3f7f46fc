"""Versions of a corpus as hash trees: one root says whether two corpora are equal, descending says where they differ."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators.ranks import staged

#: A range of ids with no more files than this is a leaf; a larger one has a child for each next hexadecimal digit.
LEAF = 64
TREE = "prefix string, n long, hash string, leaf boolean"


def hash_tree(files: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(prefix, n, hash, leaf): the nodes of a tree over hexadecimal file_ids; the root has the empty prefix.

    A leaf's hash is that of its sorted lines file_id:file_hash, an inner node's that of its children's lines prefix:n:hash.
    The tree depends on the files alone. It is built from below in rounds, in which a group has at most 16 children and each
    of them at most `leaf` files; ids are hashes, so the deepest groups, of about one file, grow no further. No files give a root of nothing.
    """
    rows = files.select("file_id", F.concat_ws(":", "file_id", "file_hash").alias("line"))
    depth = max(1, math.ceil(math.log(max(2, rows.count()), 16)))
    deepest = rows.groupBy(F.substring("file_id", 1, depth).alias("prefix")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("line")).alias("lines"))
    own = F.sha2(F.array_join("lines", "\n"), 256)
    level = staged(deepest.select("prefix", "n", F.when(F.col("n") > leaf, own).alias("hash"), "lines"), "tree")
    nodes = None
    digest = lambda s: F.coalesce(s["hash"], F.sha2(F.array_join(s["lines"], "\n"), 256))
    for size in range(depth - 1, -1, -1):
        kids = F.array_sort(F.collect_list(F.struct("prefix", "n", "hash", "lines")))
        up = level.groupBy(F.substring("prefix", 1, size).alias("up")).agg(F.sum("n").alias("total"), kids.alias("kids"))
        inner = F.col("total") > leaf
        said = F.array_join(F.transform("kids", lambda s: F.concat_ws(":", s["prefix"], s["n"].cast("string"), digest(s))), "\n")
        none = F.array().cast("array<string>")
        up = staged(up.select("up", "total", F.when(inner, F.sha2(said, 256)).alias("hash"), F.when(inner, none).otherwise(F.flatten(F.transform("kids", lambda s: s["lines"]))).alias("lines"), F.when(inner, F.transform("kids", lambda s: F.struct(s["prefix"].alias("prefix"), s["n"].alias("n"), digest(s).alias("hash"), (s["n"] <= leaf).alias("leaf")))).alias("kids")), "tree")
        below = up.select(F.explode("kids").alias("kid")).select("kid.*")
        nodes = below if nodes is None else nodes.unionByName(below)
        level = up.select(F.col("up").alias("prefix"), F.col("total").alias("n"), "hash", "lines")
    root = level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("hash"), F.sha2(F.array_join(F.flatten(F.collect_list("lines")), "\n"), 256)).alias("hash"))  # one row at most
    return nodes.unionByName(root.select(F.lit("").alias("prefix"), "n", "hash", (F.col("n") <= leaf).alias("leaf")))


def changed_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(prefix, n_old, n_new): the smallest ranges that both trees tell apart and that differ; n is null where a tree has no such range.

    Only children of differing nodes are looked at, level by level, so what is read depends on what has changed. Equal trees give no rows.
    """
    a = staged(old.withColumn("size", F.length("prefix")), "tree")
    b = staged(new.withColumn("size", F.length("prefix")), "tree")
    out, size, above = None, 0, None
    while True:
        x, y = (t.where(F.col("size") == size) for t in (a, b))
        if above is not None:
            x, y = (t.withColumn("up", F.substring("prefix", 1, size - 1)).join(above, "up", "left_semi") for t in (x, y))
        both = x.select("prefix", F.col("n").alias("n_old"), F.col("hash").alias("h_old"), F.col("leaf").alias("l_old")).join(y.select("prefix", F.col("n").alias("n_new"), F.col("hash").alias("h_new"), F.col("leaf").alias("l_new")), "prefix", "full")
        differ = staged(both.where(~F.col("h_old").eqNullSafe(F.col("h_new"))), "tree")
        ends = F.coalesce("l_old", F.lit(True)) | F.coalesce("l_new", F.lit(True))
        here = differ.where(ends).select("prefix", "n_old", "n_new")
        out = here if out is None else out.unionByName(here)
        above = differ.where(~ends).select(F.col("prefix").alias("up"))
        if above.isEmpty():
            return out
        size += 1
