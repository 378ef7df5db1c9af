"""Text measures and helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json_text import let
from .normalize import WS, ZERO_WIDTH, name_key, trim

#: A line that carries its own separator and a value.
PAIR = rf"(?::|=|{WS}{{2,}}|{WS}[-–—]{WS}){WS}*\S"
_INLINE = rf"{WS}*[,;|•]{WS}*(?=[^,;|•:=]{{2,40}}{WS}*[:=]{WS}*\S)"
MOST_LINES = 400


def fixed3(x: Column) -> Column:
    """Three decimals of the binary value."""
    return F.call_function("format_number", x, F.lit("0.000")).cast("double")


def confidence(score: Column) -> Column:
    """A saturating score: x / (x + 2)."""
    return F.when(score <= 0, 0.0).otherwise(fixed3(score / (score + 2)))


def key_similarity(x: Column, y: Column) -> Column:
    """0 to 1, for keys that name_key() made: the larger of the edit similarity and 0.95 times the share of common words."""
    words = lambda c: F.array_distinct(F.split(c, " "))
    edit = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))
    common = F.size(F.array_intersect(words(x), words(y))) / F.least(F.size(words(x)), F.size(words(y)))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(edit, common * 0.95))))


def name_similarity(a: Column, b: Column) -> Column:
    return key_similarity(name_key(F.coalesce(a, F.lit(""))), name_key(F.coalesce(b, F.lit(""))))


def trigrams(c: Column) -> Column:
    """The distinct trigrams of a text's words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    of_word = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(words, of_word)))


def trigram_similarity(a: Column, b: Column) -> Column:
    return shared_trigrams(trigrams(a), trigrams(b))


def shared_trigrams(x: Column, y: Column) -> Column:
    """The share of common ones among all distinct trigrams of two texts."""
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(0.0)


def tokens(c: Column) -> Column:
    """Lower-cased words of a text."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def matches_all(document: Column, query: Column) -> Column:
    """Whether a text has all the words of the query, which has one at least."""
    return (F.size(tokens(query)) > 0) & (F.size(F.array_except(tokens(query), tokens(document))) == 0)


#: A word's weight, and the limit of the sum of 1 / i ** 2.
WORD_WEIGHT, SQUARES = 0.1, 1.64493406685


def word_rank(words: Column, asked: Column) -> Column:
    """Rank of a text's words for a query's distinct words, as text-search databases give it to words of the least weight.

    One word: its occurrences, damped by squares of their number. Several: 1 less the product, over all pairs of
    occurrences of two of them, of 1 less a weight that falls with their distance; 1e-20 where there is no pair.
    """
    at = F.flatten(F.transform(asked, lambda w, i: F.transform(F.filter(F.transform(words, lambda d, p: F.when(d == w, p)), lambda p: p.isNotNull()), lambda p: F.struct(i.alias("word"), p.alias("place")))))
    count = F.size(F.filter(words, lambda d: d == F.get(asked, F.lit(0))))
    single = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), count)), F.lit(0.0), lambda s, i: s + WORD_WEIGHT / (i * i)) / SQUARES
    gap = lambda x, y: F.abs(x["place"] - y["place"])
    near = lambda n: F.when(n > 100, 1e-30).otherwise(1 / (1.005 + 0.05 * F.exp(n / 1.5 - 2)))
    rest = lambda x, y: 1 - WORD_WEIGHT * F.sqrt(near(gap(x, y)))
    earlier = lambda x, all_: F.filter(all_, lambda y: y["word"] < x["word"])
    product = lambda all_: F.aggregate(all_, F.lit(1.0), lambda s, x: s * F.aggregate(earlier(x, all_), F.lit(1.0), lambda t, y: t * rest(x, y)))
    several = let(at, lambda all_: F.when(F.exists(all_, lambda x: F.size(earlier(x, all_)) > 0), 1 - product(all_)).otherwise(1e-20))
    return F.when(F.size(asked) == 0, 0.0).when(F.size(asked) == 1, F.when(count > 0, single).otherwise(0.0)).otherwise(several)


def text_rank(document: Column, query: Column) -> Column:
    """word_rank of a document for a query."""
    return word_rank(tokens(document), F.array_distinct(tokens(query)))


def normalize_label(c: Column) -> Column:
    s = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2"))
    s = F.regexp_replace(F.regexp_replace(s, r"[_\-./\\]+", " "), r'[*:?()\[\]{}"”“]', " ")
    return trim(F.regexp_replace(F.regexp_replace(s, "['’`]", ""), f"{WS}+", " "))


def url_pattern(glob: str) -> str:
    """The regular expression of a URL glob: * stays within a path segment, ** does not; case is ignored."""
    wild = {"**": ".*", "*": "[^/]*"}
    return "(?i)^" + "".join(wild.get(p) or re.sub(r"([.+?^${}()|\[\]\\])", r"\\\1", p) for p in re.split(r"(\*\*|\*)", glob)) + "$"


def pasted_lines(c: Column, most: int | None = MOST_LINES) -> Column:
    """Lines of pasted text, run-on pairs split at separators that a label follows; `most` at most."""
    own = lambda parts: F.filter(F.transform(parts, trim), lambda x: x != "")
    # a run of blank lines is one cut, not thousands of lines to trim and drop
    raw = own(F.split(F.regexp_replace(F.regexp_replace(c, ZERO_WIDTH, ""), r"\r\n?", "\n"), rf"\n{WS}*+"))
    rows = own(F.flatten(F.transform(raw, lambda x: F.split(x, _INLINE))))
    return rows if most is None else F.slice(rows, 1, most)


def mime_type(content: Column) -> Column:
    """The kind of a file by its first bytes."""
    h = F.hex(F.substring(content, 1, 12))
    return F.when(h.startswith("25504446"), "application/pdf").when(h.startswith("FFD8FF"), "image/jpeg").when(h.startswith("89504E470D0A1A0A"), "image/png").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "image/webp")


def storage_org(path: Column) -> Column:
    """The organisation's id that begins a storage path."""
    head = F.split_part(path, F.lit("/"), F.lit(1))
    return F.when(head.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lower(head))


def form_signature(c: Column) -> Column:
    """FNV-1a (32 bits) of a text's UTF-16 code units, in base 36."""
    units = F.encode(c, "UTF-16BE")
    unit = lambda i: F.conv(F.hex(F.substring(units, i * 2 + 1, F.lit(2))), 16, 10).cast("long")
    count = (F.octet_length(units) / 2).cast("int")
    steps = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    value = F.aggregate(steps, F.lit(2166136261).cast("long"), lambda h, i: F.pmod(h.bitwiseXOR(unit(i)) * 16777619, F.lit(1 << 32).cast("long")))
    return F.lower(F.conv(value.cast("string"), 10, 36))
