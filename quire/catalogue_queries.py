"""Queries of whole catalogues: dumps made of the driver's tables, read, built and compared with SQL over those tables; archives read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import names, text
from quire.functions.identifiers import isbn13_to_10
from quire.operators import catalog, paths, validation
from quire.registry import load, query, spread
from quire.shared import shared_dir
from quire.shelf_queries import _book_plan
from quire.sources import archives, book_source, dumps

_ISBN = "'978' || lpad(CAST(p_partkey * 104729 % 1000000000 AS VARCHAR), 9, '0')"
_CHECK = "CAST((10 - (" + " + ".join(f"CAST(substr(b, {i}, 1) AS INTEGER) * {1 if i % 2 else 3}" for i in range(1, 13)) + ") % 10) % 10 AS VARCHAR)"


def _isbn(key: Column) -> Column:
    body = F.concat(F.lit("978"), F.lpad((key * 104729 % 1000000000).cast("string"), 9, "0"))
    total = F.lit(0)
    for i in range(1, 13):
        total = total + F.substring(body, i, 1).cast("int") * (1 if i % 2 else 3)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _rows(df: DataFrame, table: str, values: list[Column], per_line: int = 500) -> DataFrame:
    """INSERT lines of a MySQL dump: strings in quotes, null as NULL."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    one = F.concat(F.lit("("), F.concat_ws(",", *[F.coalesce(quoted(v) if kind == "string" else v.cast("string"), F.lit("NULL")) for v, (_, kind) in zip(values, df.select(*values).dtypes)]), F.lit(")"))
    lines = df.select(F.floor(F.monotonically_increasing_id() / per_line).alias("g"), one.alias("v")).groupBy("g").agg(F.array_join(F.collect_list("v"), ",").alias("v"))
    return lines.select(F.concat(F.lit(f"INSERT INTO `{table}` VALUES "), F.col("v"), F.lit(";")).alias("value"))


def _dump(spark, sf_dir) -> str:
    """A dump of catalogue B: parts as titles and as publications, suppliers as authors, nations as series, regions as publishers."""
    part, supplier, nation, region = (load(spark, sf_dir, t) for t in ("part", "supplier", "nation", "region"))
    n = supplier.count()
    key, size = F.col("p_partkey"), F.col("p_size")
    variant = key % 3 == 0
    kind = F.when(key % 5 == 0, "MAGAZINE").otherwise("NOVEL")
    day = F.concat((1900 + size).cast("string"), F.lit("-"), F.lpad((key % 13).cast("string"), 2, "0"), F.lit("-"), F.lpad((key % 4).cast("string"), 2, "0"))
    null, author = F.lit(None).cast("bigint"), key % n + 1
    tables = {
        "languages": (spark.range(2), [F.when(F.col("id") == 0, "eng").otherwise("ger"), F.when(F.col("id") == 0, 17).otherwise(22)], "lang_code lang_id"),
        "authors": (supplier, [F.col("s_suppkey"), F.concat(F.lit("O'"), F.col("s_name")), F.lit("x, (y)")], "author_id author_canonical author_note"),
        "series": (nation, [F.col("n_name"), F.col("n_nationkey") + 1, F.when(F.col("n_nationkey") % 2 == 1, 1)], "series_title series_id series_parent"),
        "titles": (part, [key, F.col("p_name"), F.when(variant, null).otherwise(key % 25 + 1), F.when(~variant, size.cast("string")), F.when(key % 2 == 0, "5"), day, kind, F.when(variant, key - 1).otherwise(F.lit(0)), F.when(key % 2 == 0, 17).otherwise(22), F.lit("views")], "title_id title_title series_id title_seriesnum title_seriesnum_2 title_copyright title_ttype title_parent title_language title_views"),
        "canonical_author": (part, [key, author, F.when(variant, 2).otherwise(1)], "title_id author_id ca_status"),
        "publishers": (region, [F.col("r_regionkey"), F.col("r_name")], "publisher_id publisher_name"),
        "pubs": (part, [key, F.col("p_name"), day, key % 5, F.concat(F.lit("x+"), size.cast("string")), F.when(key % 2 == 0, "ebook").otherwise("tp"), kind, F.when(key % 7 == 0, "12345").when(key % 4 == 0, isbn13_to_10(_isbn(key))).otherwise(_isbn(key))], "pub_id pub_title pub_year publisher_id pub_pages pub_ptype pub_ctype pub_isbn"),
        "pub_content": (part, [key, key], "title_id pub_id"),
        "pub_authors": (part, [author, key], "author_id pub_id"),
    }
    folder = f"{shared_dir(spark)}/quire/dump-{uuid.uuid4().hex}"
    head = [line for t, (_, _, columns) in tables.items() for line in (f"CREATE TABLE `{t}` (", *(f"  `{c}` text," for c in columns.split()), ") ENGINE=x;")]
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.text(f"{folder}/0")
    for t, (df, values, _) in tables.items():
        _rows(df, t, values).write.text(f"{folder}/{t}")
    return f"{folder}/*"


_TITLES = """s AS (SELECT count(*) AS n FROM supplier),
    d AS (SELECT *, p_partkey % 3 = 0 AS variant, p_partkey % s.n + 1 AS author, p_partkey % 13 AS m, p_partkey % 4 AS dd FROM part, s WHERE p_partkey % 5 <> 0)"""


@query(
    f"""WITH {_TITLES}, up AS (SELECT d.*, u.p_partkey AS parent, CASE WHEN d.variant THEN u.p_partkey ELSE d.p_partkey END AS base, CASE WHEN d.variant THEN u.p_size ELSE d.p_size END AS bsize, coalesce(u.p_size, d.p_size) AS ysize FROM d LEFT JOIN d u ON d.variant AND u.p_partkey = d.p_partkey - 1 AND NOT u.variant),
    ser AS (SELECT up.*, base % 25 + 1 AS sid FROM up)
    SELECT p_partkey AS id, p_name AS title, coalesce('O''' || s_name, '') AS authors_text, CAST(1900 + ysize AS INTEGER) AS year, coalesce(n.n_name, '') AS series,
        CASE WHEN n.n_name IS NULL THEN '' ELSE CAST(bsize AS VARCHAR) || CASE WHEN base % 2 = 0 THEN '.5' ELSE '' END END AS series_num,
        CASE WHEN n.n_nationkey % 2 = 1 THEN (SELECT n_name FROM nation WHERE n_nationkey = 0) ELSE '' END AS series_parent, CASE WHEN p_partkey % 2 = 0 THEN 'en' ELSE 'de' END AS language, CASE WHEN variant THEN p_partkey - 1 END AS variant_of
    FROM ser LEFT JOIN nation n ON n.n_nationkey + 1 = sid LEFT JOIN supplier ON s_suppkey = base % ser.n + 1"""
)
def catalogue_works(spark, sf_dir):
    """Works of catalogue B from a dump of its nine tables: kinds of books, variants that take their parent's series, authors and year, series above
    series, names with quotes."""
    t = catalog.catalogue_b(dumps.read_dump_b(spark, _dump(spark, sf_dir)))["works"]
    return t.select("id", "title", "authors_text", "year", "series", "series_num", F.coalesce("series_parent", F.lit("")).alias("series_parent"), "language", "variant_of")


@query(
    f"""WITH {_TITLES}, b AS (SELECT *, {_ISBN} AS b FROM d WHERE p_partkey % 7 <> 0)
    SELECT p_partkey AS id, p_partkey AS work_id, b || {_CHECK} AS isbn13, p_name AS title, coalesce('O''' || s_name, '') AS authors_text, r_name AS publisher, CAST(1900 + p_size AS INTEGER) AS year,
        CASE WHEN m > 0 THEN CAST(m AS INTEGER) END AS month, CASE WHEN m > 0 AND dd > 0 THEN CAST(dd AS INTEGER) END AS day, CASE WHEN p_partkey % 2 = 0 THEN 'ebook' ELSE 'tp' END AS binding, p_size AS pages
    FROM b LEFT JOIN supplier ON s_suppkey = author JOIN region ON r_regionkey = p_partkey % 5"""
)
def catalogue_editions(spark, sf_dir):
    """Editions of catalogue B from the same dump: numbers of both lengths made 13 digits, invalid ones left out, partial dates, pages behind a plus."""
    t = catalog.catalogue_b(dumps.read_dump_b(spark, _dump(spark, sf_dir)))["editions"]
    return t.select("id", "work_id", "isbn13", "title", "authors_text", "publisher", "year", "month", "day", "binding", "pages")


@query("""SELECT doc_id, sha256('<html><body><p>' || regexp_replace(coalesce(text, ''), '[&<>]', ' ', 'g') || '</p></body></html>') AS sha, source AS folder FROM documents""")
def members_read(spark, sf_dir):
    """A book archive of every document in a folder for its source: the archives are found there, and their chapters read back."""
    folder = f"{shared_dir(spark).removeprefix('file://')}/quire/shelf-{uuid.uuid4().hex}"
    name = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".epub"))
    book_source.write_books(_book_plan(load(spark, sf_dir, "documents"), name), folder)
    files = archives.find_books(spark, folder).where("size > 0")
    found = archives.read_members(spark, folder, files.select(F.col("path").alias("book_id"), F.lit("OPS/a.xhtml").alias("path")))
    return found.select(F.regexp_extract("book_id", r"(\d+)\.epub$", 1).cast("bigint").alias("doc_id"), F.sha2("content", 256).alias("sha"), F.regexp_extract("book_id", r"/([^/]*)/[^/]*$", 1).alias("folder"))


_ASKED = [  # title, authors; title, subtitle, authors found; confidence
    ("The Long Road", "Berg, Anna", "the long  ROAD!", "", "Anna Berg; Bo", 0.6), ("Long Road: A Story", "Anna Berg & Bo", "Long Road", "a story", "B. Bo", 0.6), ("The Long Road", "", "The long road", "", "Anyone", 0.45),
    ("The Long Road", "Anna Berg", "The Long Road", "", "Anna Holm", 0.0), ("The Long Road", "", "The Long Roads", "", "", 0.0), ("Café Été", "Élise Œuvré", "Cafe ete", "", "Oeuvre, E.", 0.6),
]


@query("SELECT c_custkey, CAST(CASE c_custkey % 6 " + " ".join(f"WHEN {i} THEN {c[-1]}" for i, c in enumerate(_ASKED)) + " END AS DOUBLE) AS confidence FROM customer")
def acceptance_by_authors(spark, sf_dir):
    """Found titles of six kinds: with a surname in common, by subtitle, without an author asked for, with another author, another title, with marks."""
    k = (F.col("c_custkey") % len(_ASKED)).cast("int")
    pick = lambda n: F.get(F.array(*[F.lit(c[n]) for c in _ASKED]), k)
    rows = load(spark, sf_dir, "customer").select("c_custkey", *[pick(n).alias(f"v{n}") for n in range(5)])
    return rows.select("c_custkey", catalog.accept(*[F.col(f"v{n}") for n in range(5)]).alias("confidence"))


@query(
    """WITH i AS (SELECT l_orderkey AS book_id, l_linenumber % 3 AS k FROM lineitem WHERE l_returnflag <> 'N')
    SELECT o_orderkey AS book_id, count(k) AS issues, count(k) FILTER (k = 0) AS fixable, coalesce(bool_or(k <> 2), false) AS problem FROM orders LEFT JOIN i ON book_id = o_orderkey GROUP BY 1"""
)
def validation_report(spark, sf_dir):
    """Orders as books, lines that are no N as issues of three codes: a fixable error, a warning that is not, a lock."""
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("book_id"), (F.col("l_linenumber") % 3).cast("int").alias("k"))
    each = [validation.issue_rows(lines.where(F.col("k") == k), code, F.lit("")) for k, code in enumerate(("LANGUAGE_MISSING", "MIMETYPE_POSITION", "DRM_DETECTED"))]
    return validation.report(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id")), each[0].unionByName(each[1]).unionByName(each[2]))


def _dump_a(spark, sf_dir) -> str:
    """A dump of catalogue A: parts as editions in shapes of all kinds, suppliers as authors, nations as works."""
    part, supplier, nation = (load(spark, sf_dir, t) for t in ("part", "supplier", "nation"))
    key = F.col("p_partkey")
    line = lambda kind, path, json: F.concat_ws("\t", F.lit(f"/type/{kind}"), path, F.lit("1"), F.lit("2026-01-01T00:00:00"), json).alias("value")
    author = lambda n: F.concat(F.lit("/authors/OL"), n.cast("string"), F.lit("A"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    entry = lambda c: F.concat(F.lit('{"key":"'), c, F.lit('"}'))
    own = F.concat(F.lit("["), quoted(author(key % 10)), F.lit(","), entry(author(key % 10 + 1)), F.lit(",7,null]"))
    number = F.when(key % 7 == 0, '["12345","x"]').when(key % 4 == 0, F.concat(F.lit("["), quoted(isbn13_to_10(_isbn(key))), F.lit("]"))).otherwise(F.concat(F.lit('["bad",'), quoted(_isbn(key)), F.lit("]")))
    json = F.concat(
        F.lit('{"title":"  '), F.col("p_name"), F.lit('  ","authors":'), F.when(key % 2 == 0, own).otherwise("[]"), F.lit(',"works":['), entry(F.concat(F.lit("/works/OL"), (key % 25).cast("string"), F.lit("W"))), F.lit('],"languages":'),
        F.when(key % 3 == 0, '["/languages/ger"]').when(key % 3 == 1, '[{"key":"/languages/eng"},{"key":"/languages/fre"}]').otherwise("7"), F.lit(',"isbn_'), F.when(key % 4 == 0, "10").otherwise("13"), F.lit('":'), number,
        F.lit(',"publishers":["House","House","P'), F.col("p_size").cast("string"), F.lit('",5],"publish_date":"March '), (1900 + F.col("p_size")).cast("string"), F.lit('","number_of_pages":'), F.when(key % 5 == 0, '"many"').otherwise(F.col("p_size").cast("string")), F.lit(',"covers":[-1,'), key.cast("string"), F.lit("]}"),
    )
    lines = part.select(line("edition", F.concat(F.lit("/books/OL"), key.cast("string"), F.lit("M")), json))
    lines = lines.unionByName(supplier.select(line("author", author(F.col("s_suppkey")), F.concat(F.lit('{"name":"'), F.col("s_name"), F.lit('"}')))))
    lines = lines.unionByName(nation.select(line("work", F.concat(F.lit("/works/OL"), F.col("n_nationkey").cast("string"), F.lit("W")), F.concat(F.lit('{"authors":[{"author":'), entry(author(F.col("n_nationkey") % 10)), F.lit("}]}")))))
    folder = f"{shared_dir(spark)}/quire/dump-{uuid.uuid4().hex}"
    lines.unionByName(spark.sql("select '/type/redirect\\t/x\\t1\\t2026\\tno json' as value")).write.text(folder)
    return folder


@query(
    f"""WITH b AS (SELECT *, {_ISBN} AS b FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 3 <> 0),
    a AS (SELECT s_suppkey, s_name FROM supplier)
    SELECT 'OL' || p_partkey || 'M' AS key, b || {_CHECK} AS isbn13, p_name AS title,
        CASE WHEN p_partkey % 2 = 0 THEN array_to_string(list_filter([x.s_name, y.s_name], lambda n: n IS NOT NULL), '; ') ELSE coalesce(z.s_name, '') END AS authors_text,
        CASE WHEN p_partkey % 2 = 0 THEN 'OL' || (p_partkey % 10) || 'A; OL' || (p_partkey % 10 + 1) || 'A' ELSE 'OL' || (p_partkey % 25 % 10) || 'A' END AS author_keys,
        'House; P' || p_size AS publishers, CAST(1900 + p_size AS INTEGER) AS year, CASE WHEN p_partkey % 3 = 1 THEN 'en' ELSE '' END AS language, CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS pages,
        CASE WHEN p_partkey > 0 THEN CAST(p_partkey AS INTEGER) END AS cover_id, 'OL' || (p_partkey % 25) || 'W' AS work_key
    FROM b LEFT JOIN a x ON x.s_suppkey = p_partkey % 10 LEFT JOIN a y ON y.s_suppkey = p_partkey % 10 + 1 LEFT JOIN a z ON z.s_suppkey = p_partkey % 25 % 10"""
)
def catalogue_a_editions(spark, sf_dir):
    """Editions of catalogue A from a dump: lists of mixed shapes, languages kept and left out, authors borrowed from works, fields of wrong types."""
    rows = dumps.split_dump_a(spark, _dump_a(spark, sf_dir))
    t = catalog.catalogue_a(dumps.editions_a(rows["edition"]), dumps.works_a(rows["work"]), dumps.authors_a(rows["author"]), ["en"])["editions"]
    return t.select("key", "isbn13", "title", "authors_text", "author_keys", "publishers", "year", "language", "pages", "cover_id", "work_key")


@query(
    """SELECT c_custkey, lower(c_mktsegment) AS last, 3 AS names, 'eclair, a; o''neil cote' AS plain, lower(c_mktsegment) || ' o' AS key_of FROM customer"""
)
def names_taken_apart(spark, sf_dir):
    """Names parted by & and ; and and, their last names, the first author's key, and letters without marks."""
    c = load(spark, sf_dir, "customer")
    joined = F.concat(F.lit("O. "), F.col("c_mktsegment"), F.lit(" & Bo Berg and Ünal, Çelik"))
    each = names.split_names(joined)
    return c.select("c_custkey", names.surname(F.get(each, F.lit(0))).alias("last"), F.size(each).alias("names"), F.lower(text.ascii_name(F.lit("Éclair, À; O'Neil Côté"))).alias("plain"), names.first_author_key(F.array(F.lit(" "), F.get(each, F.lit(0))), F.array(F.lit("x"))).alias("key_of"))


@query(
    """SELECT p_partkey, field, value, from_file FROM (SELECT p_partkey, unnest([{'field': 'authors', 'value': p_brand, 'from_file': false}, {'field': 'series', 'value': p_type, 'from_file': false},
        {'field': 'series_index', 'value': CAST(p_size AS VARCHAR), 'from_file': true}, {'field': 'title', 'value': p_name, 'from_file': true}], recursive := true) FROM part)"""
)
def paths_parsed(spark, sf_dir):
    """Parts as files in folders by brand and type: what each segment of a pattern finds, and whether the file's own name gave it."""
    path = F.concat(F.lit("/shelf/"), F.col("p_brand"), F.lit("/"), F.col("p_type"), F.lit("/"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" - "), F.col("p_name"), F.lit("~"), F.col("p_partkey").cast("string"), F.lit(".epub"))
    p = spread(load(spark, sf_dir, "part").select("p_partkey", path.alias("path")), "path")
    found = paths.parse_paths(p, "%authors%/%series%/%series_index% - %title%", "/shelf")
    value = F.when(F.col("field") == "title", F.regexp_replace("value", r"~\d+$", "")).otherwise(F.col("value"))
    return found.join(p, "path").select("p_partkey", "field", value.alias("value"), "from_file")
