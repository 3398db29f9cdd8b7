"""Book numbers: cleaning, check digits, conversion; palette and text lines of generated covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let


def strip_isbn(value: Column) -> Column:
    """Digits and X only, in capitals; null as empty."""
    return F.upper(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), "[^0-9Xx]", ""))


def _digit(text: Column, i: int) -> Column:
    return F.substring(text, i, 1).try_cast("int")


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def is_isbn10(value: Column) -> Column:
    """Ten characters, X only as the last, and the sum of place times value divisible by 11."""

    def check(s: Column) -> Column:
        last = F.when(F.substring(s, 10, 1) == "X", 10).otherwise(_digit(s, 10))
        return F.when(s.rlike("^[0-9]{9}[0-9X]$"), _sum([i * _digit(s, i) for i in range(1, 10)] + [10 * last]) % 11 == 0).otherwise(False)

    return let(strip_isbn(value), check)


def _check13(s: Column, n: int) -> Column:
    return _sum([(1 if i % 2 else 3) * _digit(s, i) for i in range(1, n + 1)])


def is_isbn13(value: Column) -> Column:
    """Thirteen digits whose sum, by weights 1 and 3 in turn, is divisible by 10."""
    return let(strip_isbn(value), lambda s: F.when(s.rlike("^[0-9]{13}$"), _check13(s, 13) % 10 == 0).otherwise(False))


def isbn10_to_13(value: Column) -> Column:
    """The 978 form of a valid ISBN-10, else empty."""
    base = F.concat(F.lit("978"), F.substring(strip_isbn(value), 1, 9))
    whole = lambda b: F.concat(b, ((10 - _check13(b, 12) % 10) % 10).cast("string"))
    return F.when(is_isbn10(value), let(base, whole)).otherwise("")


def isbn13_to_10(value: Column) -> Column:
    """The ISBN-10 of a valid 978 number, else empty; 979 has none."""

    def whole(core: Column) -> Column:
        return let(_sum([i * _digit(core, i) for i in range(1, 10)]) % 11, lambda check: F.concat(core, F.when(check == 10, "X").otherwise(check.cast("string"))))

    s = strip_isbn(value)
    return F.when(is_isbn13(value) & s.startswith("978"), let(F.substring(s, 4, 9), whole)).otherwise("")


def best_isbn13(value: Column) -> Column:
    """A valid ISBN-13 as it is, a valid ISBN-10 converted, else empty."""
    return F.when(is_isbn13(value), strip_isbn(value)).when(is_isbn10(value), isbn10_to_13(value)).otherwise("")


def edition_isbns(thirteens: Column, tens: Column) -> Column:
    """struct(isbn13, isbn10, extras) of two lists of raw numbers: the first valid 13, else the first valid 10 converted; the
    first valid 10, else what the 13 gives; the other 13s, without repeats."""
    all13 = F.filter(F.transform(F.coalesce(thirteens, F.array().cast("array<string>")), best_isbn13), lambda x: x != "")
    valid10 = F.transform(F.filter(F.coalesce(tens, F.array().cast("array<string>")), is_isbn10), strip_isbn)
    every = F.array_distinct(F.concat(all13, F.transform(valid10, isbn10_to_13)))
    first13, first10 = F.coalesce(F.get(every, F.lit(0)), F.lit("")), F.get(valid10, F.lit(0))
    return F.struct(first13.alias("isbn13"), F.coalesce(first10, isbn13_to_10(first13)).alias("isbn10"), F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0))).alias("extras"))


def palette_index(title: Column, colours: int = 12) -> Column:
    """The colour of a generated cover: the first byte of the SHA-256 of the trimmed small-letter title, mod the colours."""
    return F.conv(F.substring(F.sha2(F.lower(F.trim(F.coalesce(title, F.lit("")))), 256), 1, 2), 16, 10).cast("int") % colours


def cover_lines(title: Column, authors: Column, series: Column, number: Column) -> Column:
    """struct(title, author, series) as a generated cover prints them."""
    empty = F.lit("")
    who, what, n = (F.trim(F.coalesce(c, empty)) for c in (authors, series, number))
    return F.struct(
        F.trim(F.coalesce(title, empty)).alias("title"),
        F.when(who != "", F.concat(F.lit("by "), who)).otherwise("").alias("author"),
        F.when(what == "", "").when(n == "", what).otherwise(F.concat(what, F.lit(" #"), n)).alias("series"),
    )


def mime_of_hex(head: Column) -> Column:
    """The image type of a file's first bytes, given in hexadecimal capitals."""
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("474946383"), "image/gif").when(head.rlike("^52494646.{8}57454250"), "image/webp").otherwise("")
