"""Search-text functions: stemming, tokens, relaxed token sets, citation markers. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings taken off a token, longest alternatives first, and query words without content.
ENDINGS = "(иями|ями|ами|ого|его|ому|ему|ыми|ими|ов|ев|ей|ый|ий|ой|ая|яя|ое|ее|ам|ям|ах|ях|ом|ем|а|я|ы|и|у|ю|е|о|ь)$"
STOPWORDS = [
    "а", "без", "в", "во", "где", "для", "до", "есть", "если", "имеет", "из", "или", "и", "как", "каки", "каку", "каков", "когда", "кто", "к", "ко", "ли",
    "на", "не", "но", "об", "о", "от", "по", "почему", "при", "про", "найт", "с", "со", "что",
]
REFUSALS = ("No indexed evidence was enough to answer.",)
MAX_SETS, MAX_DROP = 24, 8
WORD = r"[\p{L}\p{N}_]+"


def stem(token: Column) -> Column:
    """Endings go one after the other while more than four characters are left, so as many as the token has letters beyond four at most."""
    low = F.replace(F.lower(token), F.lit("ё"), F.lit("е"))
    cut = lambda t: F.when(F.length(t) > 4, F.regexp_replace(t, ENDINGS, "")).otherwise(t)
    again = lambda a: F.when(a["t"] == a["was"], a).otherwise(F.struct(cut(a["t"]).alias("t"), a["t"].alias("was")))  # noqa: E731  nothing more is tried once nothing goes
    whole = F.struct(low.alias("t"), F.lit("").alias("was"))
    return F.when((F.length(low) > 4) & low.rlike(r"\p{IsCyrillic}"), F.aggregate(F.sequence(F.lit(5), F.length(low)), whole, lambda a, _: again(a), lambda a: a["t"])).otherwise(low)


def tokens(text: Column) -> Column:
    """Lower-cased words, stemmed; texts without Cyrillic letters have nothing to stem."""
    low = F.replace(F.lower(text), F.lit("-"), F.lit(" "))
    found = F.regexp_extract_all(low, F.lit(WORD), F.lit(0))
    return F.when(low.rlike(r"\p{IsCyrillic}"), F.transform(found, stem)).otherwise(found)


def normalize(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def content_tokens(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: ~t.isin(STOPWORDS) & ((F.length(t) > 2) | t.rlike(r"^\p{Nd}+$")))


def query_tokens(text: Column) -> Column:
    """Content tokens, or all tokens where none has content."""
    return F.when(F.size(content_tokens(text)) > 0, content_tokens(text)).otherwise(tokens(text))


def plain_tokens(text: Column) -> Column:
    return F.filter(F.split(F.replace(F.lower(text), F.lit("-"), F.lit(" ")), r"\s+"), lambda t: t != "")


def token_count(text: Column) -> Column:
    """Words and single signs; blank text has none."""
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)))


def relaxed_sets(toks: Column) -> Column:
    """Token sets to try after all tokens together found nothing, in order: see SURVEY R5 and R6."""
    n = F.size(toks)
    pair = lambda i: F.slice(toks, i + 1, 2)
    two = F.transform(F.array_sort(F.transform(toks, lambda t, i: F.struct((-F.length(t)).alias("l"), (-i).alias("i"), t.alias("t")))), lambda s: F.array(s["t"]))
    drop = F.when(n <= MAX_DROP, F.transform(F.sequence(F.lit(0), n - 1), lambda d: F.filter(toks, lambda _, i: i != d))).otherwise(F.array().cast("array<array<string>>"))
    budget = F.lit(MAX_SETS) - F.size(drop)
    head = F.floor(budget / 2).cast("int")
    where = F.sequence(F.lit(0), n - 2)
    picked = F.filter(where, lambda i: (n - 1 <= budget) | (i < head) | (i >= n - 1 - (budget - head)))
    many = F.slice(F.array_distinct(F.concat(drop, F.transform(picked, pair))), 1, MAX_SETS)
    return F.when(n < 2, F.array().cast("array<array<string>>")).when(n == 2, two).otherwise(many)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_key(text: Column) -> Column:
    return F.lower(collapse(text))


def single_line(text: Column, limit: int) -> Column:
    """White space as single blanks; a longer text ends with an ellipsis behind its first limit - 1 characters."""
    one = collapse(text)
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, limit - 1)), F.lit("...")))


def preview(text: Column, limit: int) -> Column:
    one = collapse(text)
    return F.when(F.length(one) > limit, F.concat(F.rtrim(F.substring(one, 1, limit)), F.lit("..."))).otherwise(one)


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("section")).otherwise(s)


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", F.trim(text))


def clean_list(xs: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(xs, F.trim), lambda x: x.isNotNull() & (x != "")))


def coverage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def plural(n: Column, one: str, few: str, many: str) -> Column:
    """The Slavic plural form for a count."""
    tens, unit = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.when((unit == 1) & (tens != 11), one).when(unit.between(2, 4) & ~tens.between(12, 14), few).otherwise(many)


def markers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[[^\]]+\]"), F.lit(0))


def marker_of(citation: Column) -> Column:
    return F.when(F.contains(citation, F.lit("]")), F.concat(F.substring_index(citation, "]", 1), F.lit("]"))).otherwise(citation)


def unknown_marker(marker: Column, known: Column) -> Column:
    label = F.trim(F.substring(F.trim(marker), F.lit(2), F.length(F.trim(marker)) - 2))
    return ~F.array_contains(known, marker) & label.rlike(r"^[A-Za-z0-9_.:/#-]+$")


def structural_heading(line: Column) -> Column:
    return F.trim(line).rlike(r"^#{1,6}\s+\S.*$") | F.trim(line).rlike(r"^(\*\*|__).*:\s*\1$")


def citation_check(answer: Column, citations: Column, refusal: str = REFUSALS[0]) -> Column:
    """struct(valid, invalid): every line but headings needs a known marker; a refusal needs none; markers that look like ids must be known."""
    known = F.transform(citations, marker_of)
    bad = F.transform(F.filter(markers(answer), lambda m: unknown_marker(m, known)), lambda m: F.regexp_replace(m, r"^[\[\]]+|[\[\]]+$", ""))
    lines = F.filter(F.split(answer, r"\r\n|[\n\r]"), lambda x: (F.trim(x) != "") & ~structural_heading(x))
    cited = F.forall(lines, lambda x: F.arrays_overlap(markers(x), known)) & (F.size(lines) > 0)
    refused = F.trim(answer) == refusal
    return F.struct(F.when(refused, True).when(F.size(bad) > 0, False).when(F.size(citations) == 0, False).otherwise(cited).alias("valid"), F.when(refused, F.array().cast("array<string>")).otherwise(bad).alias("invalid"))
