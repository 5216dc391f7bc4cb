"""Column functions over text and vectors, all of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"([\x{4e00}-\x{9fff}]|[a-z]+|[0-9]+)"
YEAR = r"(?<![\p{L}\p{N}_])(20[0-9]{2})(?![\p{L}\p{N}_])"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is worked out once for a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def tokens(c: Column) -> Column:
    """Single Han characters, runs of Latin letters, runs of digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(1))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def content_hash(c: Column) -> Column:
    return F.sha1(F.lower(squeeze(c)))


def has_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def has_year(c: Column) -> Column:
    return c.rlike(YEAR)


def windows(c: Column, size: int, overlap: int) -> Column:
    """Overlapping pieces of ``size`` characters; the last one ends with the text; none of an empty text."""
    if overlap >= size:
        raise ValueError("the overlap must be below the size")
    step, n = size - overlap, F.length(c)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(c, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def count_of(text: Column, part: Column) -> Column:
    """Occurrences of a non-empty part that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)


def code_point_sum(c: Column) -> Column:
    return F.aggregate(F.split(F.coalesce(c, F.lit("")), ""), F.lit(0).cast("long"), lambda a, x: a + F.ascii(x))


def hash_embedding(seed: Column, size: int = 32) -> Column:
    """The offline embedding of a text by the sum of its code points: one of 97 unit vectors."""
    return unit(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.pmod(seed + i * 13, F.lit(97)) / F.lit(97.0)))


def url_quote(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
