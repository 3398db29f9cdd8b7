import pytest
from pyspark.sql import functions as F

from quire.functions import dates, identifiers, names, patterns, text


def value(spark, f, *args):
    row = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    got = row.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first().x
    return tuple(got) if hasattr(got, "__fields__") else got


CASES = [
    (identifiers.is_isbn13, ("9780441172719",), True),
    (identifiers.is_isbn13, ("978-0-441-17271-0",), False),
    (identifiers.is_isbn10, ("0-8044-2957-X",), True),
    (identifiers.is_isbn10, ("X804429570",), False),
    (identifiers.isbn10_to_13, ("0441172717",), "9780441172719"),
    (identifiers.isbn13_to_10, ("9790000000001",), ""),
    (identifiers.best_isbn13, (None,), ""),
    (dates.split_date, ("2001-02-03T10:00",), ("2001", "02", "03")),
    (dates.split_date, ("02-03",), ("", "", "")),
    (dates.format_date, ("2001", "2", ""), "2001-02"),
    (dates.catalogue_date, ("1999-00-10",), (1999, None, None)),
    (dates.catalogue_date, ("8888-00-00",), (None, None, None)),
    (dates.publish_date, ("March 4, 1998",), ("1998", "3", "4")),
    (dates.publish_date, ("4th March 1998",), ("1998", "3", "4")),
    (dates.publish_date, ("[1998-03-04]",), ("1998", "3", "4")),
    (dates.publish_date, ("c1998",), ("1998", "", "")),
    (dates.publish_date, ("03/04/1998",), ("1998", "", "")),
    (dates.publish_date, ("1990s",), ("", "", "")),
    (dates.publish_date, ("Feb 30, 1990",), ("1990", "", "")),
    (dates.volume_number, ("IV",), 4),
    (dates.volume_number, ("twelve",), 12),
    (dates.volume_number, ("1000",), None),
    (dates.page_count, ("xii, 320 p.",), None), (dates.page_count, ("xii+320",), 320), (dates.page_count, ("viii+304",), 304),
    (lambda c: dates.zero_pad(c, 2), ("5.5",), "05.5"),
    (dates.series_number, ("5", "1"), "5.1"),
    (text.title_key, ("The Hobbit",), "hobbit"),
    (text.title_key, ("The",), "the"),
    (text.words_key, ("Éclair & Straße, Ærø",), "eclair strasse aero"),
    (text.title_stem, ("Dune: Book One",), "Dune"),
    (text.fix_missing_spaces, ("Hello.World",), "Hello. World"),
    (text.strip_html, ("<p>a&amp;b</p><p>c</p>",), "a&b\nc"),
    (text.strip_html, ("2 < 3",), "2 < 3"),
    (lambda c: text.change_case(c, "title"), ("the lord of the rings",), "The Lord of the Rings"),
    (lambda c: text.search_replace(c, "a.c", "$1"), ("a.c abc",), "$1 abc"),
    (lambda c: text.search_replace(c, r"(\w)-(\w)", r"\2-\1", regex=True), ("a-b",), "b-a"),
    (text.file_name, ("con",), "_con"),
    (text.file_name, (" ..",), "Untitled"),
    (text.unsafe_path, ("a/../b",), True),
    (text.unsafe_path, ("a/b..c",), False),
    (lambda c: text.resolve_href(F.lit("OEBPS/x.opf"), c), ("a/../b%20c.html#d",), "OEBPS/b c.html"),
    (lambda c: text.resolve_href(F.lit("x.opf"), c), ("../../y",), None),
    (names.space_initials, ("J.R.R.Tolkien",), "J. R. R. Tolkien"),
    (names.to_sort, ("Jane Q. Doe; Bo",), "Doe, Jane Q.; Bo"),
    (names.from_sort, ("Doe, Jane Q.; Bo",), "Jane Q. Doe; Bo"),
    (names.author_key, ("Tolkien, J.R.R.",), "j r r tolkien"),
    (names.author_key, ("JRR Tolkien",), "j r r tolkien"),
    (names.surname, ("Herbert, Frank",), "herbert"),
    (names.clean_series, ("Voyagers (Ben Bova)", "Ben Bova"), "Voyagers"),
    (names.clean_series, ("Star Wars (Legends)", "X"), "Star Wars (Legends)"),
    (lambda c: patterns.parse("%authors% - %series% %series_index% - %title%", c), ("Frank Herbert - Dune 02 - Dune Messiah",), {"authors": "Frank Herbert", "series": "Dune", "series_index": "2", "title": "Dune Messiah"}),
    (lambda c: patterns.parse("%title%[ (%year%)]", c), ("Dune (1965)",), {"title": "Dune", "year": "1965"}),
    (lambda c: patterns.parse("%title%[ (%year%)]", c), ("Dune",), {"title": "Dune"}),
    (lambda c: patterns.parse("%authors% - %title%", c), ("A & B - C",), {"authors": "A; B", "title": "C"}),
    (lambda c: patterns.parse("%title% - %year%", c), ("nothing",), None),
]


@pytest.mark.parametrize("f, args, want", CASES)
def test_value(spark, f, args, want):
    assert value(spark, f, *args) == want


def test_edition_isbns(spark):
    row = spark.sql("select array('bad', '9780441172719', '9780804429573') a, array('080442957X') b")
    got = row.select(identifiers.edition_isbns(F.col("a"), F.col("b")).alias("x")).first().x
    assert (got.isbn13, got.isbn10, got.extras) == ("9780441172719", "080442957X", ["9780804429573"])


def test_render_closes_gaps(spark):
    one = lambda a, s: value(spark, lambda x, y: patterns.render("%authors% - [%series% - ]%title%", {"authors": x, "series": y, "title": F.lit("T")}), a, s)
    assert one("A", "S") == "A - S - T" and one("A", "") == "A - T" and one("", "") == "T"


def test_render_then_parse(spark):
    pattern = "%authors% - %series% %series_index% - %title%"
    made = value(spark, lambda a, t: patterns.render(pattern, {"authors": a, "title": t, "series": F.lit("Saga"), "series_index": F.lit("3")}), "Ann Lee", "The End")
    assert value(spark, lambda c: patterns.parse(pattern, c), made) == {"authors": "Ann Lee", "title": "The End", "series": "Saga", "series_index": "3"}


def test_bad_regex_is_refused():
    with pytest.raises(Exception, match="."):
        text.search_replace(F.lit("x"), "(", "y", regex=True)


def test_entities(spark):
    from html import unescape

    texts = ["&#8217;t &eacute;&#x41; &amp;lt; &nbsp;x", "no entity", "a & b && &", "&unknown; &amp", "&#0; &#xD800; &#1114112; &#x110000; &#99999999;", "&#128512;&#x1F600;&euro;", "&AMP;", "", None, "&#xe9;&hellip;&Eacute;;"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.unescaped(F.col("t")).alias("u")).collect()
    found = {r.i: r.u for r in rows}
    for i in (0, 1, 2, 5, 7, 9):
        assert found[i] == unescape(texts[i]).replace("\u00a0", " ")
    assert found[3] == "&unknown; &amp" and found[4] == texts[4] and found[6] == "&AMP;" and found[8] is None
    html = spark.createDataFrame([("<p>It&#8217;s caf&eacute; &#x26; more&lt;b&gt;</p>",)], "h string").select(text.strip_html(F.col("h")).alias("t")).first().t
    assert html == "It’s café & more<b>"


def test_headings_as_their_sql_reads_them(spark):
    """Only the entities asked for are read, long ones stay whole, and a blank first heading is the first one where blanks are asked for."""
    from quire.operators import mining

    long = "x" * 300
    pages = spark.createDataFrame([(1, f"<h1> </h1><h2>a &quot;b&quot; &lt;</h2><h3>{long}</h3>")], "page_id long, html string")
    read = lambda **how: [r.text for r in mining.headings(pages, "html", "page_id", **how).orderBy("place").collect()]
    assert read() == ['a "b" <', "x" * 200]
    plain = {"entities": (("&lt;", "<"),), "most": None}
    assert read(**plain) == ["a &quot;b&quot; <", long]
    assert mining.first_headings(mining.headings(pages, "html", "page_id", blank=True, **plain), "page_id").first().heading == ""


def test_paragraphs_of_a_page_that_ends_long_after_them(spark):
    """A page with much behind its last paragraph costs about its length; one without any gives nothing."""
    import time

    from quire.operators import mining

    html = "<div><p>one</p> and <P class='a'>t&amp;<b>wo</b></P >" + "y" * 200_000
    pages = spark.createDataFrame([(1, html), (2, "z" * 200_000), (3, None)], "page_id long, html string")
    began = time.time()
    found = [(r.page_id, r.place, html[r.start - 1 : r.start - 1 + r.length], r.text) for r in mining.paragraph_spans(pages, ["page_id"], "html").orderBy("place").collect()]
    assert found == [(1, 0, "<p>one</p>", "one"), (1, 1, "<P class='a'>t&amp;<b>wo</b></P >", "t&wo")]
    assert time.time() - began < 30
