"""The pattern language of names: %field% places in text, with [optional groups], rendered and parsed as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import collapse, text_of

# The shapes of fields that are no free text.
SHAPES = {"year": r"\d{4}", "month": r"\d{1,2}|[A-Za-z]{3,9}\.?", "day": r"\d{1,2}", "series_index": r"\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?", "isbn": r"[\dXx-]{10,17}", "language": r"[A-Za-z]{2,3}"}
ALIASES = {"author": "authors", "number": "series_index", "series_number": "series_index", "index": "series_index", "lang": "language", "pub_year": "year", "date": "year"}


@dataclass(frozen=True)
class Piece:
    """Literal text, a field, or an optional group of pieces."""

    text: str = ""
    field: str = ""
    group: tuple[Piece, ...] = ()


def pieces(pattern: str) -> list[Piece]:
    """A pattern's parts. A [ without its ] and a % without its pair are text."""
    out: list[Piece] = []
    for token in re.findall(r"%[A-Za-z_]+%|\[[^\[\]]*%[A-Za-z_]+%[^\[\]]*\]|[^%\[]+|[%\[]", pattern):
        if token[0] == "%" and len(token) > 2:
            name = token[1:-1].lower()
            out.append(Piece(field=ALIASES.get(name, name)))
        elif token[0] == "[" and len(token) > 1:
            out.append(Piece(group=tuple(pieces(token[1:-1]))))
        else:
            out.append(Piece(text=token))
    return out


def fields_of(pattern: str) -> list[str]:
    found = [p.field for x in pieces(pattern) for p in (x.group or (x,)) if p.field]
    return list(dict.fromkeys(found))


def render(pattern: str, values: dict[str, Column]) -> Column:
    """The pattern with each field's text. A group goes when all its fields are empty; what an empty field leaves between
    separators is closed up: repeated separators become one, and none stays at either end."""
    value = {k: collapse(v) for k, v in values.items()}

    def one(parts: list[Piece] | tuple[Piece, ...]) -> Column:
        cols = []
        for p in parts:
            if p.group:
                filled = [value[q.field] != "" for q in p.group if q.field in value]
                some = filled[0] if filled else F.lit(False)
                for f in filled[1:]:
                    some = some | f
                cols.append(F.when(some, one(p.group)).otherwise(""))
            elif p.field:
                cols.append(value.get(p.field, F.lit("")))
            else:
                cols.append(F.lit(p.text))
        return F.concat(*cols) if cols else F.lit("")

    out = F.regexp_replace(one(pieces(pattern)), r"\(\s*\)|\[\s*\]", "")
    out = F.regexp_replace(out, r"(\s+[-–_,]\s*)(?:[-–_,]\s*)+", "$1")
    return collapse(F.regexp_replace(F.regexp_replace(out, r"^[\s\-–_,]+", ""), r"[\s\-–_,]+$", ""))


def to_regex(pattern: str, loose: bool = False) -> tuple[str, dict[str, int]]:
    """(a Java regex, field to group number). Shaped fields take their shape, others as little as fits; white space in the
    text matches any run, with ``loose`` also none. The second place of a field must repeat the first."""
    number: dict[str, int] = {}
    space = r"\s*" if loose else r"\s+"

    def one(parts) -> str:
        out = ""
        for p in parts:
            if p.group:
                out += f"(?:{one(p.group)})?"
            elif p.field:
                if p.field in number:
                    out += f"\\{number[p.field]}"
                else:
                    number[p.field] = len(number) + 1
                    out += f"({SHAPES.get(p.field, '.+?')})"
            else:
                out += "".join(space if x.isspace() else re.escape(x) for x in re.findall(r"\s+|\S", p.text))
        return out

    return f"(?s)^\\s*{one(pieces(pattern))}\\s*$", number


def parse(pattern: str, text: Column) -> Column:
    """map(field, value) of what the pattern finds in the text; null where it doesn't match. The strict reading goes first, then
    one that lets spaces be missing."""
    text = text_of(text)

    def read(loose: bool) -> tuple[Column, Column]:
        regex, number = to_regex(pattern, loose)
        pairs = [F.struct(F.lit(f).alias("k"), tidy(f, F.regexp_extract(text, regex, i)).alias("v")) for f, i in number.items()]
        every = F.filter(F.array(*pairs), lambda p: p["v"] != "") if pairs else F.array().cast("array<struct<k:string,v:string>>")
        return text.rlike(regex), F.map_from_entries(every)

    strict, found = read(False)
    loose, maybe = read(True)
    return F.when(strict, found).when(loose, maybe)


def tidy(field: str, value: Column) -> Column:
    """A parsed value as the field is stored: numbers without leading zeros, "1." as "1", authors joined by "; ", months as
    numbers."""
    from quire.functions.dates import MONTHS

    value = collapse(value)
    if field in ("series_index", "day"):
        return F.regexp_replace(F.regexp_replace(value, r"\.$", ""), r"(^|-)0+(?=\d)", "$1")
    if field == "month":
        table = F.create_map(*[F.lit(x) for k, v in MONTHS.items() for x in (k, str(v))])
        return F.coalesce(F.try_element_at(table, F.regexp_replace(F.lower(value), r"\.$", "")), F.regexp_replace(value, r"^0+(?=\d)", ""))
    if field == "authors":
        return F.array_join(F.filter(F.transform(F.split(value, r"\s*(?:;|&)\s*"), lambda x: F.trim(x)), lambda x: x != ""), "; ")
    if field == "isbn":
        return F.upper(F.regexp_replace(value, "[^0-9Xx]", ""))
    return value


def best_pattern(names: DataFrame, column: str, tried: list[str]) -> DataFrame:
    """(pattern, matches): the pattern that most names match, the earliest of equal ones. All are counted in one reading."""
    counts = names.agg(*[F.count_if(F.col(column).rlike(to_regex(p)[0])).alias(f"n{i}") for i, p in enumerate(tried)])
    each = F.array(*[F.struct(F.col(f"n{i}").alias("matches"), F.lit(-i).alias("place"), F.lit(p).alias("pattern")) for i, p in enumerate(tried)])
    return counts.select(F.array_max(each).alias("b")).select("b.pattern", "b.matches")
