"""Secret scans with corpus-wide ownership, in built-in functions only.

Three base kinds always stay. A fourth, opaque (long tokens that mix upper case, lower case and digits), is added where its
value looks live: few owners and few repositories hold it. Values that many owners hold are copied examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.llm.common import stage

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[A-Z0-9+/_=-]*[a-z])(?=[a-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "opaque")
BLOCK = 256


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)


def _spans(kind: int, pieces: Column, found: Column, value: Column) -> Column:
    """array<(start, kind, end, hash)> from what lies between matches, the matches and their values; sums go by blocks, so many matches stay cheap."""
    n = F.size(found)
    both = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(pieces, i))).cast("long"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(both, b * BLOCK + 1, F.lit(BLOCK))))

    def one(m: Column, i: Column) -> Column:
        b = F.floor(i / BLOCK).cast("int")
        start = _sum(F.slice(blocks, F.lit(1), b)) + _sum(F.slice(both, b * BLOCK + 1, i - b * BLOCK)) + F.length(F.get(pieces, i))
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(m)).alias("end"), F.sha2(F.get(value, i), 256).alias("hash"), F.length(F.get(value, i)).alias("n"))

    return F.when(n > 0, F.transform(found, one))


def _scan(text: Column) -> list[Column]:
    """For each kind its spans, found only where a cheap test allows a match."""
    low = F.lower(text)
    word = F.lit(False)
    for w in ("passw", "secret", "token", "apikey", "api_key"):
        word |= F.contains(low, F.lit(w))
    may = (word, F.contains(text, F.lit("AKIA")), text.rlike("[0-9a-f]{32}"), text.rlike("[0-9]") & text.rlike("[A-Za-z0-9+/_=-]{24}"))
    out = []
    for kind, (test, pattern, group) in enumerate(zip(may, (ASSIGN, ACCESS, HEX, OPAQUE), (1, 0, 0, 0), strict=True)):
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        out.append(F.when(test, F.struct(F.split(text, pattern, -1).alias("pieces"), found.alias("found"), value.alias("value"))).alias(f"m{kind}"))
    return out


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: tuple[str, ...] = ("source", "lang"), owner: tuple[str, ...] = ("source",), live_owners: int = 1, live_repositories: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, spans (array of start, kind, end, hash, live), and n_live, n_shared.

    live: at most live_owners owners and live_repositories repositories hold the value. Null texts count as empty; a null in
    an owner or repository column is a name of its own; repeated rows are each listed. Offsets are code points, end exclusive.
    """
    name = lambda cols: F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols])
    raw = docs.select(F.col(doc_id).alias("doc_id"), name(repository).alias("repo"), name(owner).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    raw = raw.select("doc_id", "repo", "owner", *_scan(F.col("t")))
    spans = [F.coalesce(_spans(k, F.col(f"m{k}.pieces"), F.col(f"m{k}.found"), F.col(f"m{k}.value")), F.array()) for k in range(4)]
    spans[0] = F.filter(spans[0], lambda s: s["n"] >= 8)
    rows = stage(raw.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repo", "owner", F.concat(*spans[:3]).alias("base"), spans[3].alias("extra")), "secret-spans")
    inside = lambda s: F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("extra", F.filter("extra", lambda s: ~inside(s)))
    each = rows.where("size(base) + size(extra) > 0").select("row", "repo", "owner", F.explode(F.concat("base", "extra")).alias("s")).select("row", "repo", "owner", "s", F.col("s.hash").alias("hash"))
    held = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    held = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    live = (F.col("owners") <= live_owners) & (F.col("repos") <= live_repositories)
    marked = each.join(held.select("hash", live.alias("live")), "hash").groupBy("row").agg(F.collect_list(F.struct("s.start", "s.kind", "s.end", "s.hash", "live")).alias("marked"))
    got = F.coalesce(F.filter("marked", lambda s: (s["kind"] < 3) | s["live"]), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,hash:string,live:boolean>>"))
    out = rows.select("row", "doc_id").join(marked, "row", "left").select("doc_id", F.array_sort(got).alias("spans"), "marked")
    count = lambda cond: F.coalesce(F.size(F.filter("marked", cond)), F.lit(0)).cast("long")
    return out.select("doc_id", "spans", F.when(F.col("marked").isNull(), 0).otherwise(count(lambda s: s["live"])).alias("n_live"), F.when(F.col("marked").isNull(), 0).otherwise(count(lambda s: ~s["live"])).alias("n_shared"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract from scan_secrets' spans."""
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), "n_live", "n_shared")
