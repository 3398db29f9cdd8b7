"""Names of people: splitting, initials, sort forms, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import text_of, words_key

INITIAL = r"(?<!\pL)([A-Z])\.(?=\pL)"


def space_initials(value: Column) -> Column:
    """J.R.R.X as J. R. R. X."""
    return F.regexp_replace(text_of(value), INITIAL, "$1. ")


def split_names(value: Column) -> Column:
    """Names parted by ; or & or the word and."""
    return F.filter(F.transform(F.split(text_of(value), r";|&|\band\b"), lambda x: F.trim(x)), lambda x: x != "")


def _entries(value: Column) -> Column:
    return F.filter(F.transform(F.split(text_of(value), ";"), lambda x: F.trim(x)), lambda x: x != "")


def to_sort(value: Column) -> Column:
    """ "Jane Q. Doe; Bo" as "Doe, Jane Q.; Bo": each name is split at its last space."""
    one = lambda n: F.when(n.contains(" "), F.concat(F.regexp_extract(n, "^(.*) ([^ ]*)$", 2), F.lit(", "), F.regexp_extract(n, "^(.*) ([^ ]*)$", 1))).otherwise(n)
    return space_initials(F.array_join(F.transform(_entries(value), one), "; "))


def from_sort(value: Column) -> Column:
    """The way back: each entry is split at its first comma."""

    def one(n: Column) -> Column:
        last, first = F.trim(F.regexp_extract(n, "^([^,]*),(.*)$", 1)), F.trim(F.regexp_extract(n, "^([^,]*),(.*)$", 2))
        return F.when(~n.contains(","), n).when(first == "", last).otherwise(F.concat(first, F.lit(" "), last))

    return space_initials(F.array_join(F.transform(_entries(value), one), "; "))


def surname(name: Column) -> Column:
    """The first word of a comma form, else the last one, folded; empty without words."""
    name = text_of(name)
    words = F.split(words_key(F.split_part(name, F.lit(","), F.lit(1))), " ")
    return F.when(name.contains(","), F.get(words, F.lit(0))).otherwise(F.element_at(words, -1))


def author_key(name: Column) -> Column:
    """The same for "Tolkien, J.R.R.", "J. R. R. Tolkien" and "JRR Tolkien": runs of up to three capitals are taken apart, and the
    folded words are sorted."""
    apart = F.regexp_replace(text_of(name), r"(?<![\pL])([A-Z])([A-Z])([A-Z])?(?![\pL])", "$1 $2 $3")
    return F.trim(F.array_join(F.array_sort(F.split(words_key(apart), " ")), " "))


def first_author_key(authors: Column, sorts: Column) -> Column:
    """author_key of the first author that isn't blank, else of the first sort form."""
    first = lambda names: F.get(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), F.lit(0))
    return author_key(F.coalesce(first(authors), first(sorts)))


def clean_series(series: Column, authors: Column) -> Column:
    """The series without a bracket at its end whose words are all the author's."""
    text = F.trim(text_of(series))
    shape = r"^(.*\S)\s*\(([^()]+)\)$"
    inner = F.filter(F.split(words_key(F.regexp_extract(text, shape, 2)), " "), lambda w: w != "")
    own = (F.size(inner) > 0) & (F.size(F.array_except(inner, F.split(words_key(authors), " "))) == 0)
    return F.when(text.rlike(shape) & own, F.trim(F.regexp_extract(text, shape, 1))).otherwise(text)
