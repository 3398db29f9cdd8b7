"""What surrounds a table of books: which fields are shown and taken, files that came and went, covers, saving and reading back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quire.functions.identifiers import is_isbn10, is_isbn13, strip_isbn
from quire.functions.text import collapse, is_unknown_language, text_of

# The fields of a book and other spellings of their names; those that are shown without being asked for; those
# that hold several values.
FIELDS = ("title", "isbn", "authors", "author_sort", "series", "series_index", "collection", "genres", "publisher", "year", "month", "day", "ddc", "language", "description")
ALIASES = {
    "author": "authors", "authors_str": "authors", "author(s)": "authors", "author_sort_str": "author_sort", "authorsort": "author_sort", "series_number": "series_index", "series_no": "series_index",
    "series #": "series_index", "series#": "series_index", "genre": "genres", "tags": "genres", "tag": "genres", "tags_str": "genres", "pub_year": "year", "pub_month": "month", "pub_day": "day", "lang": "language",
}
SHOWN = ("title", "authors", "series", "series_index", "year")
SEVERAL = ("authors", "author_sort", "genres")
LEAST_HEIGHT = 1000


def field_name(asked: str) -> str:
    """A field by any spelling: case, spaces, hyphens and underscores make no difference."""
    plain = lambda x: "".join(c for c in x.lower() if c not in " -_")
    table = {plain(f): f for f in FIELDS} | {plain(a): f for a, f in ALIASES.items()}
    if plain(asked) not in table:
        raise ValueError(f"no field {asked!r}; there are {', '.join(FIELDS)}")
    return table[plain(asked)]


def choose_fields(books: DataFrame, key: str, asked: list[str] | None = None, every: bool = False) -> DataFrame:
    """(key, fields): a map of the fields asked for (or five, or all) that have a value."""
    names = list(FIELDS) if every else [field_name(a) for a in asked] if asked else list(SHOWN)
    names = [n for n in dict.fromkeys(names) if n in books.columns]
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), text_of(F.col(n)))])
    return books.select(key, F.map_filter(pairs, lambda _, v: F.trim(v) != "").alias("fields"))


def quick_filter(books: DataFrame, typed: str, *columns: str) -> DataFrame:
    """Books one of whose columns holds what was typed, whatever the case. Nothing typed: all of them."""
    return books.where(F.lower(F.concat_ws(" ", *columns)).contains(typed.strip().lower())) if typed.strip() else books


def check_value(field: Column, value: Column) -> Column:
    """struct(value, problem): the value as it would be stored, or what is wrong with it. An empty value clears the field."""
    text = F.trim(text_of(value))
    digits = text.rlike("^[0-9]+$")
    number = text.try_cast("bigint")
    isbn = strip_isbn(text)
    problem = (
        F.when(text == "", "")
        .when((field == "isbn") & ~(is_isbn13(isbn) | is_isbn10(isbn)), "not a valid ISBN")
        .when((field == "series_index") & ~text.rlike(r"^[0-9]+(\.[0-9]+)?$"), "not a number")
        .when((field == "series_index") & (text.try_cast("double") > 99999), "too large")
        .when(field.isin("year", "month", "day") & ~digits, "not a whole number")
        .when((field == "year") & ((F.length(text) != 4) | (number < 1)), "not a year of four digits")
        .when((field == "month") & ~number.between(1, 12), "not 1 to 12")
        .when((field == "day") & ~number.between(1, 31), "not 1 to 31")
        .when((field == "language") & ~text.rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})?$"), "not a language code")
        .otherwise("")
    )
    stored = F.when(problem != "", F.lit(None)).when((field == "isbn") & (text != ""), isbn).otherwise(text)
    return F.struct(stored.alias("value"), problem.alias("problem"))


def stored_form(field: str, value: Column) -> Column:
    """A value as a book gives it back: trimmed, and lists with one "; " between their parts."""
    text = F.trim(text_of(value))
    return F.array_join(F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != ""), "; ") if field in SEVERAL else text


def set_fields(books: DataFrame, key: str, changes: dict[str, str]) -> DataFrame:
    """(key, field, old, new) of what setting the fields changes."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), stored_form(f, F.col(f)).alias("old"), stored_form(f, F.lit(v)).alias("new")) for f, v in changes.items()])
    return books.select(key, F.explode(rows).alias("r")).select(key, "r.*").where("old <> new")


def read_back(changes: DataFrame, again: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, not_stored): after saving, the books of ``changes`` (key, field, new) read again: changed, or failed with the fields
    that the archive could not hold (a series number without a series, a month without a year), or failed if it can't be read."""
    now = again.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), stored_form(f, F.col(f)).alias("now")) for f in fields])).alias("r")).select(key, "r.*")
    rows = changes.join(now, [key, "field"], "left")
    rows = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.when(~F.col("new").eqNullSafe(F.col("now")), F.col("field")))).alias("not_stored"))
    return rows.select(key, F.when(F.size("not_stored") > 0, "failed").otherwise("changed").alias("status"), "not_stored")


def new_and_removed(loaded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, change): files in the folders of loaded ones that are new, and loaded ones that have vanished. Both: path."""
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    there = found.select("path").join(loaded.select(folder.alias("folder")).distinct(), folder == F.col("folder"), "left_semi")
    new = there.join(loaded.select("path"), "path", "left_anti").select("path", F.lit("new").alias("change"))
    return new.unionByName(loaded.select("path").join(found.select("path"), "path", "left_anti").select("path", F.lit("removed").alias("change")))


def status_counts(books: DataFrame, changed: Column, error: Column) -> DataFrame:
    """One row: books loaded, with changes that are not saved, and that failed to load."""
    return books.agg(F.count("*").alias("loaded"), F.count_if(changed).alias("unsaved"), F.count_if(text_of(error) != "").alias("failed"))


def cover_hash(content: Column) -> Column:
    """SHA-256 of a cover's bytes; null without a cover."""
    return F.sha2(content, 256)


#: Frames of a JPEG that hold its size: all kinds of coding, but not tables (C4), extensions (C8) and conditioning (CC).
FRAMES = {0xC0 + k for k in range(16)} - {0xC4, 0xC8, 0xCC}
#: Markers that stand alone, without a length: temporary, restarts, start.
ALONE = {0x01, *range(0xD0, 0xD9)}


def jpeg_frame(data: bytes) -> tuple[int, int] | None:
    """(width, height) of a JPEG's own frame. Segments are walked by their lengths, so pictures within a segment, as thumbnails are, don't
    count, and neither does where in the file the frame stands. None if the file ends, or its pixels begin, before a frame."""
    at, end = 2, len(data)
    while at + 4 <= end:
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:  # a filling byte
            at += 1
        elif marker in ALONE:
            at += 2
        elif marker in (0xD9, 0xDA):
            return None
        elif marker in FRAMES:
            return (int.from_bytes(data[at + 7 : at + 9]), int.from_bytes(data[at + 5 : at + 7])) if at + 9 <= end else None
        else:
            at += 2 + max(2, int.from_bytes(data[at + 2 : at + 4]))
    return None


@F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
def _jpeg_size(content: pd.Series) -> pd.DataFrame:
    found = [jpeg_frame(c) if c is not None else None for c in content]
    return pd.DataFrame({"width": pd.array([f and f[0] for f in found], "Int32"), "height": pd.array([f and f[1] for f in found], "Int32")})


def image_size(content: Column) -> Column:
    """struct(width, height) of a PNG, GIF or JPEG; null for anything else, and for a JPEG without a frame. PNG and GIF have it in their first
    bytes; a JPEG's segments are walked, whatever is in them (only JPEGs are handed to Python)."""
    code = F.hex(F.substring(content, 1, 24))
    number = lambda at, n: F.conv(F.substring(code, at * 2 + 1, n * 2), 16, 10).cast("int")
    swapped = lambda at: number(at, 1) + 256 * number(at + 1, 1)
    size = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    frame = _jpeg_size(F.when(code.startswith("FFD8"), content))
    return F.when(code.startswith("89504E470D0A1A0A"), size(number(16, 4), number(20, 4))).when(code.startswith("47494638"), size(swapped(6), swapped(8))).when(code.startswith("FFD8") & frame["width"].isNotNull(), frame)


def with_junk_covers(books: DataFrame, flagged: DataFrame) -> DataFrame:
    """Books whose cover's hash is flagged (column cover_hash of both): every book with the same cover."""
    return books.join(flagged.select("cover_hash"), "cover_hash", "left_semi").select(*books.columns)


def cover_quality(has_cover: Column, height: Column) -> Column:
    """struct(rank, text): missing (0), unreadable (1), low resolution (2), fine (3)."""
    rank = F.when(~has_cover, 0).when(height.isNull(), 1).when(height < LEAST_HEIGHT, 2).otherwise(3)
    return F.struct(rank.alias("rank"), F.element_at(F.array(*map(F.lit, ("no cover", "unreadable", "low resolution", "fine"))), rank + 1).alias("text"))


def by_cover(books: DataFrame, has_cover: str, height: str, key: str) -> DataFrame:
    """The worst covers first: missing, unreadable, then by height."""
    quality = cover_quality(F.col(has_cover), F.col(height))
    return books.withColumn("cover", quality["text"]).orderBy(F.least(quality["rank"], F.lit(2)), F.coalesce(height, F.lit(0)), key)


def better_covers(books: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """(key, cover, height): the tallest candidate of each book that is taller than its cover (column height, null without one)."""
    best = candidates.groupBy(key).agg(F.max(F.struct("height", "cover")).alias("b"))
    return books.select(key, F.col("height").alias("now")).join(best, key).where(F.col("now").isNull() | (F.col("b.height") > F.col("now"))).select(key, "b.cover", "b.height")


def to_save(books: DataFrame, changed: Column, save_error: Column) -> DataFrame:
    """Books with changes whose last saving did not fail."""
    return books.where(changed & (text_of(save_error) == ""))


def fill_language(books: DataFrame, code: str, column: str = "language") -> DataFrame:
    """Books with a language in place of a blank or unknown one."""
    return books.withColumn(column, F.when(is_unknown_language(F.col(column)), code).otherwise(F.col(column)))


def replay(actions: Column, depth: int = 50) -> Column:
    """struct(now, undo, redo) after a list of actions (struct of kind and value) in order: edit sets a value and clears what could be done
    again, undo and redo move through the values; at most ``depth`` steps back."""
    none = F.array().cast("array<string>")
    rest = lambda xs: F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(1)))
    state = lambda now, undo, redo: F.struct(now.alias("now"), undo.alias("undo"), redo.alias("redo"))

    def step(s: Column, a: Column) -> Column:
        front = lambda x, xs: F.concat(F.array(x), xs)
        return (
            F.when(a["kind"] == "edit", state(a["value"], F.slice(front(s["now"], s["undo"]), 1, depth), none))
            .when((a["kind"] == "undo") & (F.size(s["undo"]) > 0), state(s["undo"][0], rest(s["undo"]), front(s["now"], s["redo"])))
            .when((a["kind"] == "redo") & (F.size(s["redo"]) > 0), state(s["redo"][0], F.slice(front(s["now"], s["undo"]), 1, depth), rest(s["redo"])))
            .otherwise(s)
        )

    return F.aggregate(actions, state(F.lit("").cast("string"), none, none), step)


def compressible_images(manifest: DataFrame, entries: DataFrame, encrypted: DataFrame) -> DataFrame:
    """(book_id, path, size): JPEG items that the archive holds and that are not encrypted. encrypted: book_id, path."""
    items = manifest.where("lower(media_type) in ('image/jpeg', 'image/jpg') and not remote").select("book_id", "path").distinct()
    return items.join(entries.select("book_id", F.col("name").alias("path"), "size"), ["book_id", "path"]).join(encrypted.select("book_id", "path"), ["book_id", "path"], "left_anti")


def headers_report(books: DataFrame, found: DataFrame, paragraphs: DataFrame, examples: int = 6) -> DataFrame:
    """(book_id, status, headers, removed, confidence, examples): what page_furniture found in each book. books: book_id, load_error."""
    rows = found.join(paragraphs.select("book_id", "place", collapse(F.col("text")).alias("text")), ["book_id", "place"])
    first = F.slice(F.transform(F.sort_array(F.collect_set(F.when(F.col("kind").isin("left", "right"), F.struct("place", "text")))), lambda x: x["text"]), 1, examples)  # a book's own headers
    sums = rows.groupBy("book_id").agg(F.count_if(F.col("kind").isin("left", "right")).alias("headers"), F.count("*").alias("removed"), F.max("confidence").alias("confidence"), first.alias("examples"))
    status = F.when(text_of(F.col("load_error")) != "", "failed").when(F.col("removed") > 0, "found").otherwise("clean")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return books.join(sums, "book_id", "left").select("book_id", status.alias("status"), zero("headers"), zero("removed"), "confidence", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def json_report(results: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row, ``report``: a line of JSON for each result is in ``results.write.json``; this is the summary that goes with it: how many
    results there are by status, and how many warnings. results: status."""
    counts = results.groupBy("status").agg(F.count("*").alias("n"))  # a few statuses
    listed = counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("by_status"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))
    warned = warnings.agg(F.count("*").alias("warnings")) if warnings is not None else results.limit(0).agg(F.count("*").alias("warnings"))
    return listed.join(warned, F.lit(True)).select(F.to_json(F.struct("files", "by_status", "warnings")).alias("report"), F.when(F.coalesce(F.try_element_at("by_status", F.lit("failed")), F.lit(0)) > 0, 3).otherwise(0).alias("exit_code"))


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """(value, n): how often each value occurs, white space and case apart."""
    return rows.groupBy(F.lower(collapse(F.col(column))).alias("value")).agg(F.count("*").alias("n"))


def selection_summary(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(group, shown, choices): the one value that a selection has, or <multiple>, and what there is to choose from (a few values)."""
    some = rows.groupBy(group).agg(F.sort_array(F.collect_set(column)).alias("v"))
    return some.select(group, F.when(F.size("v") == 1, F.get("v", F.lit(0))).otherwise("<multiple>").alias("shown"), F.array_join("v", "; ").alias("choices"))


def numeric_top(rows: DataFrame, column: str, key: str, most: int) -> DataFrame:
    """A report of the first ``most`` rows by a text column that counts as a number, the largest first; what is no number comes last."""
    return rows.orderBy(F.col(column).cast("string").try_cast("double").desc_nulls_last(), key).limit(most)


def timing_totals(events: DataFrame, kind: str, value: str) -> DataFrame:
    """(kind, total, n, mean): sums are exact decimals, the same in any order."""
    sums = events.groupBy(kind).agg(F.sum(F.col(value).cast("decimal(30,12)")).cast("double").alias("total"), F.count("*").alias("n"))
    return sums.withColumn("mean", F.col("total") / F.col("n"))
