"""Partial dates: year, month and day as text, each only where it is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let

# Names of months and their numbers.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
}
YEAR = "(1[0-9]{3}|20[0-9]{2})"
VAGUE = r"(?i)\?|\bca?\.?\s*\d|\bcirca\b|\bc\d|\babout\b|\bapprox"


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def _parts(year: Column, month: Column, day: Column) -> Column:
    return F.struct(year.alias("year"), month.alias("month"), day.alias("day"))


def split_date(value: Column) -> Column:
    """struct(year, month, day) of "YYYY[-MM[-DD]]", anything from T on dropped; without a year of four digits all are empty."""
    parts = F.split(F.split_part(_text(value), F.lit("T"), F.lit(1)), "-")
    at = lambda i, shape: F.when(F.coalesce(F.get(parts, F.lit(i)), F.lit("")).rlike(shape), F.get(parts, F.lit(i))).otherwise("")
    year, month, day = at(0, "^[0-9]{4}$"), at(1, "^(0?[1-9]|1[0-2])$"), at(2, "^(0?[1-9]|[12][0-9]|3[01])$")
    month = F.when(year == "", "").otherwise(month)
    return _parts(year, month, F.when(month == "", "").otherwise(day))


def format_date(year: Column, month: Column, day: Column) -> Column:
    """As precise as given: YYYY, YYYY-MM or YYYY-MM-DD; empty without a year."""
    y, m, d = _text(year), _text(month), _text(day)
    return F.when(y == "", "").when(m == "", y).when(d == "", F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))).otherwise(F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")))


def first_year(value: Column) -> Column:
    """The first year 1000 to 2099 with no digit around it that is no decade ("1990s"), as a number; null if none."""
    return F.regexp_extract(_text(value), rf"(?<![0-9]){YEAR}(?![0-9])(?!s\b)", 1).try_cast("int")


def catalogue_date(value: Column) -> Column:
    """struct(year, month, day) of numbers from "YYYY-MM-DD" with 00 for unknown parts; years beyond 1400 to 2100 are none, and
    a day needs a month."""
    number = lambda i: F.regexp_extract(_text(value), "^([0-9]{4})-([0-9]{2})-([0-9]{2})", i).try_cast("int")
    year = F.when(number(1).between(1400, 2100), number(1))
    month = F.when(year.isNotNull() & number(2).between(1, 12), number(2))
    return _parts(year, month, F.when(year.isNotNull() & (number(2) != 0) & number(3).between(1, 31), number(3)))


def days_in_month(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31).otherwise(0)


def publish_date(value: Column) -> Column:
    """struct(year, month, day) of a free-text date, as digits without padding. Month and day only from a form with one
    meaning: 1998-03-04, 1998-03, March 4, 1998, 4 March 1998, March 1998, 1998 March 4. A vague mark (?, c, ca, circa, about)
    or any other form gives the first plausible year alone."""
    return let(F.trim(F.regexp_replace(F.translate(_text(value), "–", "-"), r"\s+", " ")), _publish_date)


def _publish_date(text: Column) -> Column:
    clean = F.rtrim(F.regexp_replace(text, r"^[\[\]() ]+|[\[\]() ]+$", ""))
    return let(F.struct(text.alias("text"), F.regexp_replace(clean, r"[.-]+$", "").alias("clean")), lambda x: _exact_or_year(x["text"], x["clean"]))


def _exact_or_year(text: Column, clean: Column) -> Column:
    names = "|".join(sorted(MONTHS, key=len, reverse=True))
    table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    got = lambda shape, i: F.regexp_extract(clean, "(?i)" + shape, i)
    number = lambda shape, i: got(shape, i).try_cast("int")
    named = lambda shape, i: F.try_element_at(table, F.lower(got(shape, i)))
    forms = []  # condition, year, month, day
    iso, iso_month = rf"^{YEAR}[-/.](\d{{1,2}})[-/.](\d{{1,2}})$", rf"^{YEAR}[-/.](\d{{1,2}})$"
    forms.append((iso, number(iso, 1), number(iso, 2), number(iso, 3)))
    forms.append((iso_month, number(iso_month, 1), number(iso_month, 2), None))
    shape = rf"^({names})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+{YEAR}$"
    forms.append((shape, number(shape, 3), named(shape, 1), number(shape, 2)))
    shape = rf"^(\d{{1,2}})(?:st|nd|rd|th)?\s+({names})\.?,?\s+{YEAR}$"
    forms.append((shape, number(shape, 3), named(shape, 2), number(shape, 1)))
    shape = rf"^({names})\.?,?\s+{YEAR}$"
    forms.append((shape, number(shape, 2), named(shape, 1), None))
    shape = rf"^{YEAR}\s+({names})\.?,?\s+(\d{{1,2}})$"
    forms.append((shape, number(shape, 1), named(shape, 2), number(shape, 3)))
    shape = rf"^{YEAR}\s+({names})\.?$"
    forms.append((shape, number(shape, 1), named(shape, 2), None))
    found = None
    for shape, year, month, day in forms:
        ok = clean.rlike("(?i)" + shape) & month.between(1, 12) & (F.lit(True) if day is None else day.between(1, days_in_month(year, month)))
        row = _parts(year.cast("string"), month.cast("string"), F.lit("") if day is None else day.cast("string"))
        found = F.when(ok, row) if found is None else found.when(ok, row)
    year = F.coalesce(first_year(text).cast("string"), F.lit(""))
    return F.coalesce(F.when(~text.rlike(VAGUE), found), _parts(year, F.lit(""), F.lit("")))


def series_number(number: Column, part: Column) -> Column:
    """ "5" and "1" as "5.1"; empty without a number."""
    n, p = _text(number), _text(part)
    return F.when(n == "", "").when(p == "", n).otherwise(F.concat(n, F.lit("."), p))


# Number words of volumes.
NUMBER_WORDS = {w: i + 1 for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}


def volume_number(token: Column) -> Column:
    """1 to 999 from digits, a Roman numeral or a number word; else null."""
    text = F.lower(_text(token))
    roman = F.aggregate(
        F.transform(F.split(text, ""), lambda c: F.try_element_at(F.create_map(*[F.lit(x) for p in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in p]), c)),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")),
        lambda acc, x: F.struct((acc["total"] + F.coalesce(x, F.lit(0)) - F.when(acc["last"] < x, 2 * acc["last"]).otherwise(0)).alias("total"), F.coalesce(x, F.lit(0)).alias("last")),
        lambda acc: acc["total"],
    )
    word = F.try_element_at(F.create_map(*[F.lit(x) for p in NUMBER_WORDS.items() for x in p]), text)
    n = F.when(text.rlike("^[0-9]{1,3}$"), text.try_cast("int")).when(word.isNotNull(), word).when(text.rlike("^(?=.)m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"), roman)
    return F.when(n.between(1, 999), n)


def zero_pad(number: Column, width: int) -> Column:
    """The whole part padded to ``width`` digits ("5.5" to "05.5"); what is no number stays."""
    text = _text(number)
    whole = F.regexp_extract(text, r"^([0-9]+)(\.[0-9]+)?$", 1)
    return F.when(whole == "", text).otherwise(F.concat(F.lpad(whole, F.greatest(F.length(whole), F.lit(width)), F.lit("0")), F.regexp_extract(text, r"^([0-9]+)(\.[0-9]+)?$", 2)))


def year_closeness(a: Column, b: Column) -> Column:
    """1 for equal years down to 0 for a gap of ten and more; 0.5 where one is unknown."""
    gap = F.abs(a.try_cast("int") - b.try_cast("int"))
    return F.when(gap.isNull(), 0.5).otherwise(1 - F.least(gap, F.lit(10)) / 10)


def page_count(value: Column) -> Column:
    """The digits a page statement ends with, if 1 to 19999."""
    n = F.regexp_extract(_text(value), r"([0-9]{1,9})\s*$", 1).try_cast("int")
    return F.when(n.between(1, 19999), n)
