"""Mining text: genres, running page headers, tables of contents. Facts of title pages are in title_pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import caps_share, collapse, plain_key, text_of, unescaped

# Classes of the Dewey decimal system and their genres, the first that fits counts; 800s go by the third digit.
DDC_GENRES = [
    (4.0, 6.999, "Technology"), (150.0, 159.999, "Psychology"), (100.0, 199.999, "Philosophy"), (200.0, 289.999, "Religion & Spirituality"), (290.0, 299.999, "Mythology"), (320.0, 329.999, "Politics"), (332.0, 332.999, "Finance"),
    (330.0, 339.999, "Economics"), (340.0, 349.999, "Law"), (364.1, 364.199, "True Crime"), (370.0, 379.999, "Education"), (300.0, 399.999, "Social Science"), (400.0, 499.999, "Language Learning"), (510.0, 519.999, "Mathematics"),
    (500.0, 599.999, "Science"), (613.0, 613.999, "Health & Wellness"), (610.0, 619.999, "Medicine"), (635.0, 635.999, "Gardening"), (641.0, 641.999, "Cooking"), (649.0, 649.999, "Parenting"), (650.0, 659.999, "Business"),
    (600.0, 699.999, "Technology"), (745.0, 746.999, "Crafts & Hobbies"), (770.0, 779.999, "Photography"), (780.0, 789.999, "Music"), (791.4, 791.499, "Film & Media"), (796.0, 799.999, "Sports & Recreation"),
    (700.0, 769.999, "Art & Design"), (910.0, 919.999, "Travel"), (920.0, 929.999, "Biography"), (930.0, 999.999, "History"), (900.0, 909.999, "History"),
]
LITERATURE = {"1": "Poetry", "2": "Drama", "3": "Fiction", "4": "Essays", "6": "Letters & Diaries", "7": "Humor"}


def ddc_genre(ddc: Column) -> Column:
    """The genre of a class number, empty if it has none."""
    text = F.regexp_extract(text_of(ddc), r"^\s*(\d{3}(?:\.\d+)?)", 1)
    number = text.try_cast("double")
    out = F.when(text == "", "").when(text.startswith("8"), F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LITERATURE.items() for x in p]), F.substring(text, 3, 1)), F.lit("")))
    for low, high, genre in DDC_GENRES:
        out = out.when(number.between(low, high), genre)
    return out.otherwise("")


def genre_pattern(name: str) -> str:
    """A regex for a genre's name: any separators, & or and, an optional plural."""
    words = [r"(?:&|and)" if w in ("&", "and") else re.escape(w.lower()) for w in re.findall(r"[^\W_]+|&", name)]
    return r"(?iU)\b" + r"[\s/_-]*".join(words) + r"(?:s|es)?\b"


def genre_hits(texts: DataFrame, id_col: str, text_col: str, genres: list[str], source: str) -> DataFrame:
    """(id, genre, source, snippet) for each genre that a text names, once; a genre all of whose hits lie within hits of longer names
    that hold it is none: those are taken out before it is looked for (… in the snippet). The vocabulary is a list of the caller's,
    so it is unrolled into the projection."""
    found = []
    for g in genres:
        pattern = genre_pattern(g)
        longer = [o for o in genres if len(o) > len(g) and re.search(pattern.replace("(?iU)", "(?i)"), o)]
        text = F.regexp_replace("t", "|".join(genre_pattern(o) for o in sorted(longer, key=len, reverse=True)), "…") if longer else F.col("t")
        at, hit = F.regexp_instr(text, F.lit(pattern)), F.regexp_extract(text, pattern, 0)
        snippet = F.substring(text, F.greatest(F.lit(1), at - 40), F.length(hit) + 80)
        found.append(F.when(text.rlike(pattern), F.struct(F.lit(g).alias("genre"), snippet.alias("snippet"))))
    rows = texts.select(id_col, text_of(F.col(text_col)).alias("t")).select(id_col, F.explode(F.array_compact(F.array(*found))).alias("h"))
    return rows.select(id_col, "h.genre", F.lit(source).alias("source"), "h.snippet")


SOURCES = ("folder", "filename", "description", "content", "ddc")


def rank_genres(hits: DataFrame, id_col: str) -> DataFrame:
    """Genres of each id, those from more sources first, then by best source, then by name."""
    order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    found = hits.groupBy(id_col, "genre").agg(F.count_distinct("source").alias("sources"), F.min(order).alias("best"))
    place = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("sources"), "best", F.lower("genre")))
    return found.select(id_col, "genre", F.col("sources").cast("long").alias("sources"), place.cast("long").alias("place"))


# The limits that prove running headers.
LEAST_REPEATS, LEAST_HEADERS, RISING, MOST_STEP = 3, 6, 0.85, 60


def paragraph_spans(documents: DataFrame, keys: list[str], html_col: str) -> DataFrame:
    """(keys, place, start, length, text) of every paragraph element of a document, in order: where it stands in the markup (from 1), so that one that is
    removed can be cut out there, and its text without tags, with entities read. Paragraphs within one another end with the first end tag."""
    html, element = text_of(F.col(html_col)), r"(?is)<p\b[^>]*>.*?</p\s*>"
    parts = F.arrays_zip(F.split(html, element).alias("before"), F.regexp_extract_all(html, F.lit(element), 0).alias("element"))
    rows = documents.select(*keys, F.posexplode(parts).alias("place", "x")).where("x.element is not null")
    upto = F.sum(F.length("x.before") + F.length("x.element")).over(Window.partitionBy(*keys).orderBy("place"))
    inner = F.regexp_extract("x.element", r"(?is)^<p\b[^>]*>(.*)</p\s*>$", 1)
    plain = collapse(F.replace(unescaped(F.regexp_replace(inner, "<[^>]*>", "")), F.lit("\u00a0"), F.lit(" ")))
    return rows.select(*keys, F.col("place").cast("long").alias("place"), (upto - F.length("x.element") + 1).alias("start"), F.length("x.element").cast("long").alias("length"), plain.alias("text"))


def header_candidates(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs that may be page headers. paragraphs: book_id, place, text. Adds kind (number, left, right, title), number,
    heading; others go."""
    left, right = r"^(\d{1,4})\s+(\D.{2,70})$", r"^(\D.{2,70}?)\s+(\d{1,4})$"
    like = lambda t: (F.length(t).between(1, 70)) & (F.size(F.split(t, " ")) <= 10) & (~t.rlike(r"[.!?]\s+\S") | (caps_share(t) >= 0.8))
    # step by step, so that each is worked out once; what is longer than a number and 70 letters is no header
    rows = paragraphs.select("book_id", "place", collapse(F.col("text")).alias("text")).where(F.length("text") <= 80)
    rows = rows.select("*", F.regexp_extract("text", left, 2).alias("lt"), F.regexp_extract("text", right, 1).alias("rt"))
    text, lt, rt, kind = F.col("text"), F.col("lt"), F.col("rt"), F.col("kind")
    rows = rows.withColumn("kind", F.when(text.rlike(r"^\[?\d{1,4}\]?$"), "number").when((lt != "") & like(lt), "left").when((rt != "") & like(rt), "right").when(like(text) & ~text.rlike("[.,;]$"), "title")).where("kind is not null")
    number = F.when(kind == "number", F.regexp_extract(text, r"(\d{1,4})", 1)).when(kind == "left", F.regexp_extract(text, left, 1)).when(kind == "right", F.regexp_extract(text, right, 2)).try_cast("int")
    raw = F.when(kind == "left", lt).when(kind == "right", rt).when(kind == "title", text).otherwise("")
    rows = rows.select("book_id", "place", "text", "kind", number.alias("number"), raw.alias("raw"))
    return rows.select("book_id", "place", "text", "kind", "number", plain_key(F.col("raw")).alias("heading"), "raw")


def proved_headers(candidates: DataFrame) -> DataFrame:
    """Numbered candidates whose heading comes three times and more in a book that has six and more such, if 85 % of the steps
    from one number to the next rise by 1 to 60."""
    numbered = candidates.where("kind in ('left', 'right') and heading <> ''")
    often = numbered.withColumn("n", F.count("*").over(Window.partitionBy("book_id", "heading"))).where(F.col("n") >= LEAST_REPEATS)
    step = F.col("number") - F.lag("number").over(Window.partitionBy("book_id").orderBy("place"))
    steps = often.withColumn("step", step)
    books = steps.groupBy("book_id").agg(F.count("*").alias("headers"), F.count("step").alias("steps"), F.count_if(F.col("step").between(1, MOST_STEP)).alias("rising"))
    ok = books.where((F.col("headers") >= LEAST_HEADERS) & (F.col("rising") >= RISING * F.col("steps"))).select("book_id", "headers")
    return often.join(ok, "book_id").drop("n")


def page_furniture(paragraphs: DataFrame) -> DataFrame:
    """(book_id, place, kind, confidence) of all paragraphs to remove: proved headers; numbered ones whose number lies between
    those of the proved ones before and after and that are printed in capitals; bare numbers in sequence; lone titles as
    printed in a proved header."""
    book, found = Window.partitionBy("book_id"), header_candidates(paragraphs)
    # the rule of proved_headers by windows of one reading, which all lie within the rows of a book
    numbered = F.col("kind").isin("left", "right") & (F.col("heading") != "")
    often = F.when(numbered & (F.count(F.when(numbered, 1)).over(Window.partitionBy("book_id", "heading")) >= LEAST_REPEATS), F.col("number"))
    marks = found.withColumn("often", often)
    nearest = lambda order: F.last("often", ignorenulls=True).over(book.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("before", nearest(F.asc("place"))).withColumn("after", nearest(F.desc("place")))
    step = F.when(F.col("often").isNotNull(), F.col("number") - F.col("before"))
    marks = marks.withColumns({"headers": F.count("often").over(book), "steps": F.count(step).over(book), "rising": F.count_if(step.between(1, MOST_STEP)).over(book)})
    marks = marks.where((F.col("headers") >= LEAST_HEADERS) & (F.col("rising") >= RISING * F.col("steps"))).withColumn("proved", F.col("often").isNotNull())
    marks = marks.withColumn("printed", F.max("proved").over(Window.partitionBy("book_id", "raw")))
    fits = (F.col("before") < F.col("number")) & F.when(F.col("after").isNull(), F.col("number") - F.col("before") <= MOST_STEP).otherwise(F.col("number") < F.col("after"))
    ok = (
        F.col("proved")
        | F.coalesce(F.col("kind").isin("left", "right") & fits & (caps_share(F.col("raw")) >= 0.8), F.lit(False))
        | F.coalesce((F.col("kind") == "number") & F.col("number").between(F.col("before"), F.col("after")), F.lit(False))
        | F.coalesce((F.col("kind") == "title") & F.col("printed") & F.col("before").isNotNull(), F.lit(False))
    )
    return marks.where(ok).select("book_id", "place", "kind", F.when(F.col("headers") >= 20, 0.95).otherwise(0.85).alias("confidence"))


def join_cut_sentences(paragraphs: DataFrame, removed: DataFrame) -> DataFrame:
    """(book_id, place, text): the paragraphs that stay. One that begins small after a removed place joins the one before it if
    that ends no sentence; a hyphen at the cut goes. Empty paragraphs beside a removed one go too."""
    rows = paragraphs.select("book_id", "place", "text").join(removed.select("book_id", "place", F.lit(1).alias("gone")), ["book_id", "place"], "left")
    order = Window.partitionBy("book_id").orderBy("place")
    blank = collapse(F.col("text")) == ""
    beside = F.coalesce(F.lag("gone").over(order), F.lead("gone").over(order))
    rows = rows.withColumn("out", F.coalesce("gone", F.when(blank & (beside == 1), 1), F.lit(0)))
    rows = rows.withColumn("cuts", F.sum("out").over(order)).where("out = 0")
    kept = rows.withColumn("last", F.lag("text").over(order)).withColumn("last_cuts", F.lag("cuts").over(order))
    joins = (F.col("cuts") > F.col("last_cuts")) & ~F.rtrim("last").rlike("[.!?:…\"'”’»)\\]]$") & F.ltrim("text").rlike(r"^\p{Ll}")
    kept = kept.withColumn("group", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(order))
    whole = kept.groupBy("book_id", "group").agg(F.min("place").alias("place"), F.sort_array(F.collect_list(F.struct("place", F.trim("text").alias("t")))).alias("ts"))
    text = F.aggregate("ts", F.lit(""), lambda acc, x: F.when(acc == "", x["t"]).when(acc.rlike(r"\pL-$"), F.concat(F.regexp_replace(acc, "-$", ""), x["t"])).otherwise(F.concat(acc, F.lit(" "), x["t"])))
    return whole.select("book_id", "place", text.alias("text"))


# The limits of a generated table of contents.
REPEAT_SHARE, REPEAT_DOCS, REPEAT_FROM, COLLAPSE_ABOVE, MOST_SECTIONS = 0.30, 3, 6, 300, 40
FILE_LIKE = r"(?i)\.(x?html?|xml)$|^(untitled|unknown|document|index|page\s*\d*)$"


#: What headings read of entities, in turn.
HEADING_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def headings(docs: DataFrame, html_col: str, *keys: str, entities=HEADING_ENTITIES, most: int | None = 200, blank: bool = False) -> DataFrame:
    """(keys, place, level, text, anchor) of the h1 to h3 of each document, in order, as plain text: of at most ``most`` letters, with
    these entities read; blank ones only if they are asked for."""
    found = F.regexp_extract_all(text_of(F.col(html_col)), F.lit(r"(?is)(<h[1-3]\b[^>]*>.*?</h[1-3]\s*>)"), 1)
    rows = docs.select(*keys, F.posexplode(found).alias("place", "h"))
    plain = F.regexp_replace(F.col("h"), r"<[^>]*>", "")
    for entity, c in entities:
        plain = F.replace(plain, F.lit(entity), F.lit(c))
    text = collapse(plain) if most is None else F.substring(collapse(plain), 1, most)
    rows = rows.select(*keys, F.col("place").cast("long").alias("place"), F.substring("h", 3, 1).cast("long").alias("level"), text.alias("text"), F.regexp_extract("h", r"""(?is)^<h[1-3]\b[^>]*\bid\s*=\s*["']([^"']+)["']""", 1).alias("anchor"))
    return rows if blank else rows.where("text <> ''")


def running_headings(found: DataFrame, book: str, doc: str, docs_per_book: DataFrame) -> DataFrame:
    """(book, key, docs): headings that stand in at least 30 % of a book's documents, at least three, if it has six. docs_per_book: book, docs."""
    counts = found.groupBy(book, F.lower("text").alias("key")).agg(F.count_distinct(doc).alias("in_docs"))
    least = F.greatest(F.lit(REPEAT_DOCS), F.ceil(F.col("docs") * F.lit(REPEAT_SHARE).cast("decimal(3,2)")))
    return counts.join(docs_per_book, book).where((F.col("docs") >= REPEAT_FROM) & (F.col("in_docs") >= least)).select(book, "key", "in_docs")


def nest(levels: Column) -> Column:
    """Depths, from 1, of a list of heading levels in order: each lies one below the nearest one before it with a smaller level
    that is still open."""
    start = F.struct(F.array().cast("array<bigint>").alias("open"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        still = F.filter(acc["open"], lambda x: x < level)
        return F.struct(F.concat(still, F.array(level)).alias("open"), F.concat(acc["out"], F.array(F.size(still).cast("bigint") + 1)).alias("out"))

    return F.aggregate(levels, start, step, lambda acc: acc["out"])


def contents(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """A table of contents: book_id, place, title, path, anchor, depth. docs: book_id, ordinal (from 1), path, title, book_title, and html or, in its
    place, ``found``: headings() of it by book_id, ordinal and path.

    Headings count but running ones; the second and later ones of a document need an anchor; a document without any gives its
    title, if it says something. Above 300 entries only each document's first stays. A book without entries gets at most about 40
    "Section n"."""
    found = headings(docs, "html", "book_id", "ordinal", "path") if found is None else found
    sizes = docs.groupBy("book_id").agg(F.count("*").alias("docs"))
    found = found.withColumn("key", F.lower("text")).join(running_headings(found, "book_id", "ordinal", sizes).select("book_id", "key"), ["book_id", "key"], "left_anti")
    own = Window.partitionBy("book_id", "ordinal").orderBy("place")
    found = found.withColumn("nth", F.row_number().over(own)).where("nth = 1 or anchor <> ''")
    entries = found.select("book_id", "ordinal", F.col("place"), F.col("text").alias("title"), "path", "anchor", "level")
    titles = docs.select("book_id", "ordinal", F.lit(0).cast("long").alias("place"), collapse(F.col("title")).alias("title"), "path", F.lit("").alias("anchor"), F.lit(1).cast("long").alias("level"), F.lower(collapse(F.col("book_title"))).alias("bt"))
    many = titles.groupBy("book_id", F.lower("title").alias("lt")).agg(F.count("*").alias("n")).join(sizes, "book_id").where((F.col("docs") >= REPEAT_FROM) & (F.col("n") >= F.greatest(F.lit(REPEAT_DOCS), F.ceil(F.col("docs") * F.lit(REPEAT_SHARE).cast("decimal(3,2)"))))).select("book_id", "lt")
    titles = titles.where((F.col("title") != "") & (F.lower("title") != F.col("bt")) & ~F.col("title").rlike(FILE_LIKE)).withColumn("lt", F.lower("title")).join(many, ["book_id", "lt"], "left_anti")
    entries = entries.unionByName(titles.join(entries.select("book_id", "ordinal").distinct(), ["book_id", "ordinal"], "left_anti").drop("bt", "lt"))
    step = F.greatest(F.lit(1), F.ceil(F.col("docs") / MOST_SECTIONS))
    sections = docs.select("book_id", "ordinal", "path").join(sizes, "book_id").where((F.col("ordinal") - 1) % step == 0).join(entries.select("book_id").distinct(), "book_id", "left_anti")
    sections = sections.select("book_id", "ordinal", F.lit(0).cast("long").alias("place"), F.concat(F.lit("Section "), F.col("ordinal").cast("string")).alias("title"), "path", F.lit("").alias("anchor"), F.lit(1).cast("long").alias("level"))
    every = entries.unionByName(sections)
    first = F.row_number().over(Window.partitionBy("book_id", "ordinal").orderBy("place"))
    every = every.withColumn("total", F.count("*").over(Window.partitionBy("book_id"))).withColumn("first", first).where((F.col("total") <= COLLAPSE_ABOVE) | (F.col("first") == 1))
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "place", "title", "path", "anchor", "level")))  # at most 300 and one per document
    books = every.groupBy("book_id").agg(listed.alias("es"))
    rows = books.select("book_id", F.posexplode(F.arrays_zip("es", nest(F.transform("es", lambda e: e["level"])).alias("depths"))).alias("n", "z"))
    return rows.select("book_id", F.col("n").cast("long").alias("place"), "z.es.title", "z.es.path", "z.es.anchor", F.col("z.depths").alias("depth"))


def _link(entry_path: Column, anchor: Column, folder: Column) -> Column:
    """The percent-encoded link from a folder of the archive to an entry: up from where the two paths part, then down."""
    to, start = F.split(entry_path, "/"), F.filter(F.split(folder, "/"), lambda x: x != "")
    alike = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(start) - 1, F.lit(0))), F.lit(0), lambda n, i: F.when((n == i) & (F.get(start, i) == F.get(to, i)), n + 1).otherwise(n))
    relative = F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(start) - alike), F.slice(to, alike + 1, F.greatest(F.size(to) - alike, F.lit(1)))), "/")
    coded = lambda x, safe: F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("%2F"), F.lit(safe))
    return F.when(anchor == "", coded(relative, "/")).otherwise(F.concat(coded(relative, "/"), F.lit("#"), coded(anchor, "%2F")))


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def free_path(folder: Column, stem: str, extension: str, taken: Column) -> Column:
    """folder/stem.extension, or stem-2, stem-3 ... if that is taken; taken: an array of paths, in which case makes no difference."""
    names = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda n: F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.lit(stem), F.when(n == 1, "").otherwise(F.concat(F.lit("-"), n.cast("string"))), F.lit(extension)))
    small = F.transform(taken, lambda x: F.lower(x))
    return F.get(F.filter(names, lambda x: ~F.array_contains(small, F.lower(x))), F.lit(0))


def render_contents(entries: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, kind, path, document): the contents of each book as an XHTML list (kind nav, for version 3) and as an NCX. entries: what contents()
    gives; books: book_id, version, opf_path, title, language, identifier, taken (all paths of the archive and the manifest).

    The nested list is written by windows: an entry's own tags, and before it those that the step from the last depth to
    its own opens or closes; the texts of a book are then joined in order."""
    folder = F.regexp_extract("opf_path", "^(.*)/[^/]*$", 1)
    order = Window.partitionBy("book_id").orderBy("place")
    rows = entries.join(books.select("book_id", folder.alias("folder")), "book_id").withColumn("before", F.coalesce(F.lag("depth").over(order), F.lit(0).cast("long")))
    up = (F.col("before") - F.col("depth")).cast("int")
    link, title, n = _escaped(_link(F.col("path"), F.col("anchor"), F.col("folder"))), _escaped(F.col("title")), F.row_number().over(order).cast("string")
    between = lambda opens, closes, ends: F.when(up < 0, opens).otherwise(F.concat(F.lit(closes), F.repeat(F.lit(ends), F.greatest(up, F.lit(0)))))
    item = F.concat(between("<ol>", "</li>", "</ol></li>"), F.lit('<li><a href="'), link, F.lit('">'), title, F.lit("</a>"))
    point = F.concat(between("", "</navPoint>", "</navPoint>"), F.lit('<navPoint id="navpoint-'), n, F.lit('" playOrder="'), n, F.lit('"><navLabel><text>'), title, F.lit('</text></navLabel><content src="'), link, F.lit('"/>'))
    rows = rows.select("book_id", "place", "depth", item.alias("item"), point.alias("point"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", c))), lambda x: x[c]), "")  # noqa: E731 - a book's own entries
    whole = rows.groupBy("book_id").agg(joined("item").alias("items"), joined("point").alias("points"), F.max_by("depth", "place").cast("int").alias("last"), F.max("depth").cast("string").alias("deepest"))
    b = books.join(whole, "book_id").withColumn("folder", folder)
    lang = F.when(text_of(F.col("language")) != "", F.concat(F.lit(' xml:lang="'), _escaped(F.col("language")), F.lit('" lang="'), _escaped(F.col("language")), F.lit('"'))).otherwise("")
    nav = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"'), lang,
        F.lit('>\n<head><meta charset="utf-8"/><title>Table of Contents</title></head>\n<body>\n<nav epub:type="toc" id="toc"><h1>Table of Contents</h1>'), F.col("items"), F.repeat(F.lit("</li></ol>"), F.col("last")), F.lit("</nav>\n</body>\n</html>\n"),
    )
    name = F.when(collapse(F.col("title")) == "", "Table of Contents").otherwise(_escaped(collapse(F.col("title"))))
    ncx = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n<head><meta name="dtb:uid" content="'), _escaped(text_of(F.col("identifier"))), F.lit('"/><meta name="dtb:depth" content="'), F.col("deepest"),
        F.lit('"/><meta name="dtb:totalPageCount" content="0"/><meta name="dtb:maxPageNumber" content="0"/></head>\n<docTitle><text>'), name, F.lit("</text></docTitle>\n<navMap>"), F.col("points"), F.repeat(F.lit("</navPoint>"), F.col("last")), F.lit("</navMap>\n</ncx>\n"),
    )
    kinds = F.array(F.struct(F.lit("nav").alias("kind"), free_path(F.col("folder"), "nav", ".xhtml", F.col("taken")).alias("path"), nav.alias("document")), F.struct(F.lit("ncx").alias("kind"), free_path(F.col("folder"), "toc", ".ncx", F.col("taken")).alias("path"), ncx.alias("document")))
    return b.select("book_id", "version", F.explode(kinds).alias("k")).where((F.col("k.kind") == "ncx") | F.col("version").startswith("3")).select("book_id", "k.kind", "k.path", "k.document")


def first_headings(found: DataFrame, doc: str) -> DataFrame:
    """(doc, heading): each document's first heading."""
    return found.groupBy(doc).agg(F.min_by("text", "place").alias("heading"))


def evenly(rows: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """Every ceil(n / most)-th row of each group of n, from the first on."""
    w = Window.partitionBy(group)
    numbered = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    return numbered.where(F.col("_i") % F.ceil(F.col("_n") / most) == 0).drop("_i", "_n")
