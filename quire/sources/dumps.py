"""Dumps of the two catalogues: tab-separated lines with JSON, and a MySQL text dump."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import collapse
from quire.shared import Scratch

#: Lists are read as variants, as entries of one list may have different shapes.
EDITION = "title string, subtitle string, isbn_13 variant, isbn_10 variant, authors variant, languages variant, publishers variant, publish_date string, number_of_pages int, covers variant, subjects variant, works variant"
AUTHOR = "name string, personal_name string"
WORK = "authors variant"
SHAPES = {"edition": EDITION, "author": AUTHOR, "work": WORK}
#: A dump is refused if more than this share of the first lines looked at is no JSON.
MOST_BAD, LOOKED_AT = 0.2, 1000

# Tables and columns of dump B that are read.
DUMP_B = {
    "languages": ("lang_id", "lang_code"), "authors": ("author_id", "author_canonical"), "series": ("series_id", "series_title", "series_parent"),
    "titles": ("title_id", "title_title", "series_id", "title_seriesnum", "title_seriesnum_2", "title_copyright", "title_ttype", "title_parent", "title_language"), "canonical_author": ("title_id", "author_id", "ca_status"),
    "publishers": ("publisher_id", "publisher_name"), "pubs": ("pub_id", "pub_title", "pub_year", "publisher_id", "pub_pages", "pub_ptype", "pub_ctype", "pub_isbn"), "pub_content": ("pub_id", "title_id"), "pub_authors": ("pub_id", "author_id"),
}
NUMBERS_B = ("series_parent", "title_parent", "title_language", "ca_status")
#: Lines of table definitions that a dump may have, and the share of a table's rows that may have too few or too many values.
MOST_DEFINITIONS, MOST_ODD = 100_000, 0.01


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value and ``ordinal``, which rises with a line's place in the dump: its file, the part of it that a task reads, and the place there."""
    return spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("place")).alias("ordinal"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    lines = _lines(spark, path).select(F.split("value", "\t", 5).alias("c"), "ordinal")
    return lines.select(F.regexp_extract(F.get("c", F.lit(0)), r"^\s*/type/(\w+)\s*$", 1).alias("kind"), F.regexp_extract(F.get("c", F.lit(1)), "([^/]*)$", 1).alias("key"), "ordinal", F.get("c", F.lit(4)).alias("json"))


def read_dump_a(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of one kind (edition, author, work): key, ordinal (in the dump's order) and the JSON's fields. Lines of other kinds go
    before any JSON is read; a field of the wrong type is null."""
    return _records(spark, path).where(F.col("kind") == kind).select("key", "ordinal", "json", F.from_json("json", SHAPES[kind]).alias("r"))


def split_dump_a(spark: SparkSession, path: str, kinds: tuple[str, ...] = tuple(SHAPES)) -> dict[str, DataFrame]:
    """read_dump_a of several kinds that lie in the same files: the dump is read once and written by kind to the shared folder."""
    scratch = Scratch(spark, "dump-a")
    rows = scratch.write(_records(spark, path).where(F.col("kind").isin(*kinds)), "records", by="kind")
    return {kind: rows.where(F.col("kind") == kind).select("key", "ordinal", "json", F.from_json("json", SHAPES[kind]).alias("r")) for kind in kinds}


def refuse_bad_dump(rows: DataFrame) -> None:
    """Raise if of the first records more than a fifth, and at least ten looked at, hold no JSON object."""
    seen = rows.select("json").limit(LOOKED_AT).agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("json").isNull() | ~F.trim("json").startswith("{")).alias("bad")).first()
    if seen.n >= 10 and seen.bad > MOST_BAD * seen.n:
        raise ValueError(f"{seen.bad} of {seen.n} records are no JSON objects; has the format changed?")


def _entries(column: str, value: str) -> Column:
    """A variant's list as an array, each entry by an expression over ``e``; entries without a value go. What is no list is an empty one."""
    return F.filter(F.coalesce(F.expr(f"transform(try_variant_get({column}, '$', 'array<variant>'), e -> {value})"), F.array().cast("array<string>")), lambda x: x.isNotNull())


_STRING = "if(schema_of_variant(e) = 'STRING', try_variant_get(e, '$', 'string'), null)"


def _strings(column: str) -> Column:
    return _entries(column, _STRING)


def _keys(column: str, *paths: str) -> Column:
    """The last parts of a key list's paths, each once. An entry may be an object with the path at one of ``paths``, or, as old
    records have it, a bare string; any mixture of these gives all keys."""
    found = ", ".join(f"try_variant_get(e, '$.{p}', 'string')" for p in paths)
    last = lambda x: F.regexp_extract(x, "([^/]*)$", 1)
    return F.array_distinct(F.filter(F.transform(_entries(column, f"coalesce({found}, {_STRING})"), last), lambda x: x != ""))


def editions_a(rows: DataFrame) -> DataFrame:
    """Edition records in the shape catalogue_a takes."""
    from quire.operators.languages import language_code

    covers = F.expr("transform(try_variant_get(r.covers, '$', 'array<variant>'), e -> if(schema_of_variant(e) = 'BIGINT', try_variant_get(e, '$', 'int'), null))")
    codes = F.transform(_keys("r.languages", "key"), lambda c: F.coalesce(F.nullif(language_code(c), F.lit("")), c))
    return rows.where("r is not null").select(
        "ordinal", "key", collapse(F.col("r.title")).alias("title"), collapse(F.col("r.subtitle")).alias("subtitle"), _strings("r.isbn_13").alias("isbn_13"), _strings("r.isbn_10").alias("isbn_10"), _keys("r.authors", "key").alias("author_keys"), F.array_distinct(F.filter(codes, lambda c: ~c.isin("und", "mul", "zxx"))).alias("languages"),
        _strings("r.publishers").alias("publishers"), "r.publish_date", F.col("r.number_of_pages").alias("pages"), F.filter(F.coalesce(covers, F.array().cast("array<int>")), lambda x: x.isNotNull()).alias("cover_ids"), _strings("r.subjects").alias("subjects"), F.get(_keys("r.works", "key"), F.lit(0)).alias("work_key"),
    )


def authors_a(rows: DataFrame) -> DataFrame:
    name = F.when(collapse(F.col("r.name")) != "", collapse(F.col("r.name"))).otherwise(collapse(F.col("r.personal_name")))
    return rows.groupBy("key").agg(F.max_by(name, "ordinal").alias("name")).select(F.col("key").alias("author_key"), "name")


def works_a(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.max_by(_keys("r.authors", "author.key", "author", "key"), "ordinal").alias("author_keys")).select(F.col("key").alias("work_key"), "author_keys")


#: A row of an INSERT line, and a value of a row: a string, or anything else up to the next comma.
_ROW = re.compile(r"\(((?:'(?:[^'\\]|\\.|'')*'|[^'()])*)\)", re.S)
_VALUE = re.compile(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|([^,']*))\s*(?:,|$)", re.S)
_ESCAPED = re.compile(r"\\(.)|''", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "Z": "\x1a"}


def insert_rows(line: str) -> Iterator[list[str | None]]:
    """The value lists of a MySQL INSERT line, NULL as None, strings without quotes and escapes. A row that a cut line does not
    end is left out."""
    at = line.find("VALUES")
    if at < 0:
        return
    plain = lambda text: _ESCAPED.sub(lambda m: "'" if m[1] is None else _ESCAPES.get(m[1], m[1]), text) if "\\" in text or "''" in text else text
    for row in _ROW.finditer(line, at + 6):
        values, place = [], 0
        while place <= len(row[1]):
            found = _VALUE.match(row[1], place)
            if found is None:
                break
            string, other = found.groups()
            values.append(plain(string) if string is not None else None if other.strip().upper() == "NULL" else other.strip())
            if found.end() == place or not found[0].endswith(","):
                break
            place = found.end()
        yield values


def definitions(lines: DataFrame) -> dict[str, list[str]]:
    """The columns of each table of a dump, in order, by its CREATE TABLE lines. They are few, whatever the dump's size; a dump with
    more than MOST_DEFINITIONS of such lines raises."""
    rows = lines.where(F.col("value").rlike(r"^(CREATE TABLE|\s+`|\))")).limit(MOST_DEFINITIONS + 1).collect()
    if len(rows) > MOST_DEFINITIONS:
        raise ValueError(f"the dump has more than {MOST_DEFINITIONS} lines of definitions")
    out: dict[str, list[str]] = {}
    now: list[str] | None = None
    for row in sorted(rows, key=lambda r: tuple(r.ordinal)):
        if begin := re.match(r"CREATE TABLE (?:IF NOT EXISTS )?`([^`]+)`", row.value):
            now = out.setdefault(begin[1], [])
        elif row.value.startswith(")"):
            now = None
        elif now is not None and (column := re.match(r"\s+`([^`]+)`", row.value)):
            now.append(column[1])
    return out


def read_dump_b(spark: SparkSession, path: str, tables: tuple[str, ...] = tuple(DUMP_B), most_odd: float = MOST_ODD) -> dict[str, DataFrame]:
    """The named columns of the wanted tables, and ``ordinal``, which rises with a row's place in the dump. Columns are found by name in
    the table's definition; a table without a definition, or without a column that is wanted, raises. Rows with fewer or
    more values than the table has columns are left out, and counted: if they are more than a share ``most_odd`` of a table's rows,
    that raises too. Ids are numbers, all else is text.

    The dump is read once: lines of other tables are dropped before any is taken apart, the values of the others are written by
    table to the shared folder. A dump has one INSERT a line."""
    lines = _lines(spark, path)
    found = definitions(lines)
    for table in tables:
        if table not in found:
            raise ValueError(f"the dump has no table {table}")
        lacks = set(DUMP_B[table]) - set(found[table])
        if lacks:
            raise ValueError(f"the dump's table {table} lacks {', '.join(sorted(lacks))}")
    places = {t: [found[t].index(n) for n in DUMP_B[t]] for t in tables}
    widths = {t: len(found[t]) for t in tables}
    table_of = F.regexp_extract("value", r"^INSERT INTO `([^`]+)`", 1)
    inserts = lines.select("value", "ordinal", table_of.alias("table")).where(F.col("table").isin(*tables)).select("value", "table", "ordinal.*")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, table, *at in zip(*(c.to_pylist() for c in batch.columns)):
                width, place = widths[table], places[table]
                rows = [[r[k] for k in place] if len(r) == width else None for r in insert_rows(line)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([table] * n, pa.string()), *(pa.array([x] * n, kind) for x, kind in zip(at, (pa.string(), pa.int64(), pa.int64()))), pa.array(range(n), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["table", "file", "part", "place", "row", "values"])

    seen = Observation()
    rows = inserts.mapInArrow(read, "table string, file string, part long, place long, row int, values array<string>")
    counts = [F.count_if((F.col("table") == t) & odd).alias(f"{t}_{k}") for t in tables for k, odd in (("odd", F.col("values").isNull()), ("rows", F.lit(True)))]
    rows = Scratch(spark, "dump-b").write(rows.observe(seen, *counts), "rows", by="table")
    for t in tables:
        odd, all_rows = seen.get[f"{t}_odd"], seen.get[f"{t}_rows"]
        if odd > most_odd * all_rows:
            raise ValueError(f"{odd} of {all_rows} rows of the dump's table {t} have more or fewer values than its {widths[t]} columns")
    return {t: _table_b(rows.where((F.col("table") == t) & F.col("values").isNotNull()), t) for t in tables}


def _table_b(rows: DataFrame, table: str) -> DataFrame:
    value = lambda k, n: F.get("values", F.lit(k)).try_cast("bigint") if n.endswith("_id") or n in NUMBERS_B else F.get("values", F.lit(k))
    return rows.select(*[value(k, n).alias(n) for k, n in enumerate(DUMP_B[table])], F.struct("file", "part", "place", "row").alias("ordinal"))


def dump_date(path: Column, modified: Column | None = None) -> Column:
    """The day in a dump's file name (2025-12-27, 2025_12_27 or 20251227), else that of its time."""
    found = F.regexp_extract_all(F.element_at(F.split(path, "/"), -1), F.lit(r"(?<!\d)((?:19|20)\d{2}[-_]?(?:0[1-9]|1[0-2])[-_]?(?:0[1-9]|[12]\d|3[01]))(?!\d)"), 1)
    day = F.regexp_replace(F.get(found, F.lit(0)), r"^(\d{4})[-_]?(\d{2})[-_]?(\d{2})$", "$1-$2-$3")
    return F.coalesce(day, F.date_format(modified, "yyyy-MM-dd") if modified is not None else F.lit(""))


def refuse_small_dump(tables: dict[str, DataFrame], least: int = 100_000) -> None:
    """Raise unless publications and titles have enough rows."""
    for name in ("pubs", "titles"):
        if tables[name].count() < least:
            raise ValueError(f"{name} has fewer than {least} rows; is the dump whole?")


def provenance(source: str, recipe: str, files: list[str], counts: dict[str, int], spark: SparkSession) -> DataFrame:
    """(key, value) rows that a catalogue keeps about itself, with a line of description."""
    text = f"{source}: " + ", ".join(f"{n} {k}" for k, n in sorted(counts.items()))
    rows = [("source", source), ("recipe", recipe), ("files", "; ".join(files)), *((f"rows_{k}", str(v)) for k, v in sorted(counts.items())), ("description", text)]
    return spark.createDataFrame(rows, "key string, value string")
