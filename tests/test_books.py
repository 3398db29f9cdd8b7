"""Archives, dumps, catalogues, mining, edits, recipes and streams on small inputs made here."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import authors, catalog, duplicates, edits, mining, title_pages, validation
from quire.plans.recipe import Recipe, Step, default_steps
from quire.sources import archives, book_source, dumps
from quire.streaming import journal

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'


def book(path, title="Dune", language="en", items=("a.xhtml", "b.xhtml"), missing=(), spine=("i0", "i1"), mimetype="application/epub+zip", toc=True, body="text", extra="", version="3.0"):
    manifest = "".join(f'<item id="i{k}" href="{h}" media-type="application/xhtml+xml"/>' for k, h in enumerate(items))
    manifest += '<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' * toc
    opf = f"""<package xmlns="http://www.idpf.org/2007/opf" version="{version}" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">
        <dc:identifier id="id">urn:isbn:9780441172719</dc:identifier><dc:title>{title}</dc:title><dc:language>{language}</dc:language><dc:creator id="c" opf:role="aut">Frank Herbert</dc:creator><meta refines="#c" property="file-as">Herbert, Frank</meta>
        <meta property="belongs-to-collection" id="s">Dune Saga</meta><meta refines="#s" property="group-position">1</meta>{extra}</metadata>
        <manifest>{manifest}</manifest><spine>{"".join(f'<itemref idref="{i}"/>' for i in spine)}</spine></package>"""
    with zipfile.ZipFile(path, "w") as z:
        if mimetype:
            z.writestr("mimetype", mimetype)
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/p.opf", opf)
        for h in items:
            if h not in missing:
                z.writestr(f"OEBPS/{h}", f"<html><head><title>x</title></head><body><h1>{h}</h1><p>{body}</p></body></html>")
        if toc:
            z.writestr("OEBPS/nav.xhtml", "<html/>")


@pytest.fixture(scope="module")
def shelf(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shelf")
    book(f"{folder}/good.epub")
    book(f"{folder}/copy.epub", title="Dune again")
    book(f"{folder}/bad.epub", title="", language="", items=("a.xhtml", "b.xhtml", "a2.xhtml"), missing=("a2.xhtml",), spine=("i0", "i9"), mimetype="", toc=False, body="other", extra='<meta refines="#zz" property="role">aut</meta>')
    (folder / "broken.epub").write_bytes(b"no archive")
    (folder / "note.txt").write_text("x")
    return folder


@pytest.fixture(scope="module")
def raw(spark, shelf):
    return book_source.scan_books(spark, str(shelf)).cache()


def name_of(path):
    return path.rsplit("/", 1)[-1].removesuffix(".epub")


def test_packages(spark, shelf, raw):
    assert {name_of(r.path) for r in archives.find_books(spark, str(shelf)).collect()} == {"good", "copy", "bad", "broken"}
    rows = {name_of(r.book_id): r for r in archives.metadata(raw).collect()}
    good = rows["good"]
    assert (good.title, good.authors, good.author_sort, good.series, good.series_index, good.isbn) == ("Dune", ["Frank Herbert"], ["Herbert, Frank"], "Dune Saga", "1", "9780441172719")
    assert "broken" not in rows and raw.where("load_error <> ''").count() == 1


def test_validation(raw):
    t = archives.tables(raw)
    issues = validation.validate(t)
    found = {}
    for r in issues.collect():
        found.setdefault(name_of(r.book_id), set()).add(r.code)
    assert found["broken"] == {"LOAD_FAILED"}
    assert found["bad"] == {"MIMETYPE_MISSING", "TITLE_MISSING", "LANGUAGE_MISSING", "DANGLING_REFINES", "MANIFEST_FILE_MISSING", "DANGLING_SPINE_ITEMREF", "NO_TOC", "EPUB2_ATTRIBUTES_IN_EPUB3"}
    assert found["good"] == {"MIMETYPE_POSITION", "EPUB2_ATTRIBUTES_IN_EPUB3"} or found["good"] == {"EPUB2_ATTRIBUTES_IN_EPUB3"}
    status = {name_of(r.book_id): r.status for r in validation.statuses(t["books"], issues).collect()}
    assert status["bad"] == status["broken"] == "INVALID" and status["good"] == "ISSUES"
    fixes = {(name_of(r.book_id), r.code): r.after for r in validation.fixes(t, issues).collect()}
    assert fixes["bad", "LANGUAGE_MISSING"] == "en" and fixes["bad", "DANGLING_SPINE_ITEMREF"] is None


def test_reading_order_and_text(spark, shelf, raw):
    t = archives.tables(raw)
    order = validation.reading_order(t["spine"], t["manifest"], t["entries"])
    assert [(name_of(r.book_id), r.ordinal, r.path) for r in order.orderBy("book_id", "ordinal").collect()][-2:] == [("good", 1, "OEBPS/a.xhtml"), ("good", 2, "OEBPS/b.xhtml")]
    members = archives.read_members(spark, str(shelf), order.select("book_id", "path"))
    texts = {name_of(r.book_id): r for r in archives.front_and_back(order, members).collect()}
    assert "text" in texts["good"].front and texts["good"].front.index("a.xhtml") < texts["good"].front.index("b.xhtml") and texts["good"].back == ""


def test_duplicate_books(raw):
    t = archives.tables(raw)
    opf = raw.select(F.col("path").alias("book_id"), "opf_path")
    entries = t["entries"].join(opf, "book_id").select("book_id", "name", "crc", "size", (F.col("name") == F.col("opf_path")).alias("is_opf"))
    prints = {name_of(r.book_id): r.fingerprint for r in duplicates.content_fingerprint(entries).collect()}
    assert prints["good"] == prints["copy"] != prints["bad"]


def test_writing(spark, shelf, raw, tmp_path):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "good.epub").load(str(shelf)).select("path", "content")
    opf = archives.package_document({"title": "New & old", "authors": [("A", "A")], "series": "S", "series_index": 2, "identifier": "x", "manifest": [("i0", "a.xhtml", "application/xhtml+xml")], "spine": ["i0"]})
    plan = files.select("path", F.lit("new.epub").alias("name"), F.lit("OEBPS/p.opf").alias("opf_path"), F.lit(opf).alias("opf"), F.create_map(F.lit("OEBPS/b.xhtml"), F.lit(None).cast("binary")).alias("staged"))
    assert [r.error for r in book_source.write_books(plan, str(tmp_path)).collect()] == [""]
    again = book_source.scan_books(spark, str(tmp_path))
    row = archives.metadata(again).first()
    assert (row.title, row.series, row.series_index) == ("New & old", "S", "2")
    assert [e.name for e in again.first().entries][0] == "mimetype" and all(e.name != "OEBPS/b.xhtml" for e in again.first().entries)
    assert "FileExistsError" in book_source.write_books(plan, str(tmp_path)).first().error


def test_dump_a(spark, tmp_path):
    editions = [
        {"title": " Dune ", "isbn_13": ["978-0-441-17271-9"], "authors": [{"key": "/authors/A1"}, {"key": "/authors/A9"}], "languages": [{"key": "/languages/eng"}], "publish_date": "March 1998", "covers": [-1, 5], "works": [{"key": "/works/W1"}]},
        {"title": "Borrowed", "isbn_10": ["080442957X"], "works": [{"key": "/works/W1"}], "number_of_pages": "many", "subjects": "notalist"},
        {"title": "Wrong", "isbn_13": ["9780441172710"]},
        {"title": "Fremd", "isbn_13": ["9783161484100"], "languages": [{"key": "/languages/ger"}]},
    ]
    lines = [f"/type/edition\t/books/E{i}\t1\t2020\t{json.dumps(e)}" for i, e in enumerate(editions)]
    lines += ['/type/author\t/authors/A1\t1\t2020\t{"name": "Old"}', '/type/author\t/authors/A1\t2\t2021\t{"personal_name": "Frank Herbert"}', '/type/work\t/works/W1\t1\t2020\t{"authors": [{"author": {"key": "/authors/A1"}}]}', "/type/redirect\t/x\t1\t2020\tno json"]
    with gzip.open(f"{tmp_path}/dump.txt.gz", "wt") as f:
        f.write("\n".join(lines))
    path = f"{tmp_path}/dump.txt.gz"
    rows = dumps.read_dump_a(spark, path, "edition")
    dumps.refuse_bad_dump(rows)
    t = catalog.catalogue_a(dumps.editions_a(rows), dumps.works_a(dumps.read_dump_a(spark, path, "work")), dumps.authors_a(dumps.read_dump_a(spark, path, "author")), ["en"])
    found = {r.key: r for r in t["editions"].collect()}
    assert sorted(found) == ["E0", "E1"] and found["E0"].authors_text == "Frank Herbert" and found["E0"].author_keys == "A1; A9" and found["E0"].year == 1998 and found["E0"].cover_id == 5
    assert found["E1"].isbn13 == "9780804429573" and found["E1"].authors_text == "Frank Herbert" and found["E1"].pages is None
    assert {r.why: r.rows for r in t["summary"].collect()} == {"kept": 2, "no_isbn": 1, "language": 1} and t["authors"].count() == 1
    asked = spark.createDataFrame([(1, "0-8044-2957-X"), (2, "bad")], "probe_id int, isbn string")
    assert [(r.probe_id, r.id) for r in catalog.lookup_by_isbn(asked, t["editions"], t["extra_isbns"]).collect()] == [(1, found["E1"].id)]


def test_dump_b(spark, tmp_path):
    defined = "".join(f"CREATE TABLE `{t}` (\n" + "".join(f"  `{c}` text,\n" for c in columns) + ") ENGINE=x;\n" for t, columns in dumps.DUMP_B.items())
    (tmp_path / "b.sql").write_text(
        defined + "INSERT INTO `languages` VALUES (17,'en'),(22,'de');\nINSERT INTO `authors` VALUES (1,'Ann O\\'Neil'),(2,'');\nINSERT INTO `series` VALUES (5,'Saga',6),(6,'Universe',NULL);\n"
        "INSERT INTO `titles` VALUES (10,'First Book',5,'2','5','1990-00-00','NOVEL',0,17),(11,'Erstes Buch',NULL,NULL,NULL,'1995-01-01','NOVEL',10,22),(12,'Mag',NULL,NULL,NULL,'1990-00-00','MAGAZINE',0,17);\n"
        "INSERT INTO `canonical_author` VALUES (10,1,1),(10,2,1);\nINSERT INTO `publishers` VALUES (3,'Harbor');\nINSERT INTO `pubs` VALUES (100,'First Book','1991-05-00',3,'x+320','ebook','NOVEL','0-8044-2957-X'),(101,'Odd','8888-00-00',3,'9','tp','NOVEL','123');\n"
        "INSERT INTO `pub_content` VALUES (100,10),(100,12);\nINSERT INTO `pub_authors` VALUES (100,1);\nINSERT INTO `unused` VALUES (1,'x');\n"
    )
    t = catalog.catalogue_b(dumps.read_dump_b(spark, f"{tmp_path}/b.sql"))
    works = {r.id: r for r in t["works"].collect()}
    assert sorted(works) == [10, 11] and works[10].series_num == "2.5" and works[10].series_parent == "Universe" and works[10].authors_text == "Ann O'Neil"
    assert works[11].series == "Saga" and works[11].series_num == "2.5" and works[11].year == 1990 and works[11].language == "de" and works[11].variant_of == 10
    (e,) = t["editions"].collect()
    assert (e.id, e.work_id, e.isbn13, e.publisher, e.year, e.month, e.day, e.pages) == (100, 10, "9780804429573", "Harbor", 1991, 5, None, 320)
    with pytest.raises(ValueError):
        dumps.refuse_small_dump(dumps.read_dump_b(spark, f"{tmp_path}/b.sql", ("pubs", "titles")), 5)


def test_title_lookup(spark):
    works = spark.createDataFrame([(1, "Dune", "Frank Herbert", 1965, 1), (2, "Dune Messiah", "Frank Herbert", 1969, 1), (3, "Dune", "Someone Else", 1990, 0)], "id int, title string, authors_text string, year int, known int")
    probes = spark.createDataFrame([(1, "Dune: Book One", "Herbert, Frank", 1965), (2, "Dune", "Nobody Here", 1965)], "probe_id int, title string, authors string, year int")
    rows = catalog.lookup_by_title(probes, works).orderBy("probe_id", "place").collect()
    assert [(r.probe_id, r.id) for r in rows] == [(1, 1), (1, 2)] and rows[0].attempt == 1


def test_merge_groups(spark):
    books = spark.createDataFrame([(1, "f", "t", "a", ""), (2, "f", "t", "a", "i"), (3, "g", "t", "a", "i"), (4, "", "u", "b", "j"), (5, "", "v", "b", "j")], "book_id int, fingerprint string, title_key string, author_key string, isbn13 string")
    rows = {(r.kind, r.n, r.first_id) for r in duplicates.merge_groups(duplicates.candidate_groups(books)).collect()}
    assert rows == {("content", 2, 1), ("title", 3, 1), ("isbn", 2, 4)}


def test_page_headers(spark):
    rows, place = [], 0
    for page in range(1, 13):
        head = f"{page * 2} THE LONG ROAD" if page % 2 else f"CHAPTER ONE {page * 2}"
        for t in (head, "", f"the sentence number {page} goes on and") if page > 1 else ("CHAPTER ONE", head, "The story begins and"):
            rows.append((1, place, t))
            place += 1
    df = spark.createDataFrame(rows, "book_id int, place int, text string")
    found = mining.page_furniture(df)
    assert found.count() == 12 and {r.confidence for r in found.collect()} == {0.85}
    joined = mining.join_cut_sentences(df, found).orderBy("place").collect()
    assert len(joined) == 2 and joined[1].text.startswith("The story begins and the sentence number 2 goes")
    assert mining.page_furniture(joined and mining.join_cut_sentences(df, found)).count() == 0


def test_contents(spark):
    html = lambda *hs: "<html><body>" + "".join(f'<h{n} id="{i}">{t}</h{n}>' for n, i, t in hs) + "</body></html>"
    docs = [(1, k, f"d{k}.xhtml", "", html((1, "a", "Running"), (1, "", f"Chapter {k}"), (3, "x", "Part &amp; more"), (2, "y", "Two")), "Book") for k in range(1, 8)]
    docs += [(2, k, f"p{k}.xhtml", "untitled", "<p>x</p>", "Book") for k in range(1, 4)]
    rows = mining.contents(spark.createDataFrame(docs, "book_id int, ordinal int, path string, title string, html string, book_title string")).orderBy("book_id", "place").collect()
    assert [(r.title, r.depth) for r in rows if r.book_id == 1][:2] == [("Chapter 1", 1), ("Chapter 2", 1)]
    assert [r.title for r in rows if r.book_id == 2] == ["Section 1", "Section 2", "Section 3"]


def test_scan_and_genres(spark):
    df = spark.createDataFrame([(1, "Copyright © 1998 by Ann Lee\nPublished by Harbor Books.\nISBN 0-8044-2957-X\n", "Third edition")], "id int, front string, back string")
    found = {r.field: (r.value, r.confidence) for r in title_pages.scan_books(df, "id", "front", "back").collect()}
    assert found == {"isbn": ("9780804429573", 1.0), "year": ("1998", 0.65), "holder": ("Ann Lee", 0.6), "publisher": ("Harbor Books", 0.7), "edition": ("Third edition", 0.54)}
    text = spark.createDataFrame([(1, "a psychological thriller about science-fiction")], "id int, t string")
    hits = mining.genre_hits(text, "id", "t", ["Thriller", "Psychological Thriller", "Science Fiction", "Fiction"], "description")
    assert {r.genre for r in hits.collect()} == {"Psychological Thriller", "Science Fiction"}
    assert [r.genre for r in mining.rank_genres(hits, "id").orderBy("place").collect()] == ["Psychological Thriller", "Science Fiction"]


def test_authors(spark):
    rows = [(1, [" Herbert,  Frank "], [""]), (2, ["J.R.R.TOLKIEN & CHRISTOPHER TOLKIEN"], []), (3, ["Unknown"], []), (4, ["Dr. Who"], []), (5, ["Ann Lee", "Lee, Ann"], []), (6, ["John Smith, jr"], []), (7, ["Ludwig van Beethoven"], [])]
    got = {r.book_id: r for r in authors.clean_authors(spark.createDataFrame(rows, "book_id int, authors array<string>, author_sort array<string>")).collect()}
    assert got[1].authors == ["Frank Herbert"] and got[1].author_sort == ["Herbert, Frank"] and {"whitespace", "flip"} <= {c.rule for c in got[1].changes}
    assert got[2].authors == ["J. R. R. Tolkien", "Christopher Tolkien"] and got[3].authors == ["Unknown"] and got[4].needs_review and got[4].authors == ["Dr. Who"]
    assert got[5].authors == ["Ann Lee"] and got[6].authors == ["John Smith Jr."] and got[6].author_sort == ["Smith, John, Jr."] and got[7].author_sort == ["van Beethoven, Ludwig"]


@pytest.mark.parametrize("n", [1, 64, 65, 300])
def test_renames_of_any_length(spark, n):
    moves = spark.range(n).selectExpr("'p' || id as old_path", "'p' || (id + 1) as new_path").unionByName(spark.sql("select 'x' old_path, 'y' new_path"))
    assert {tuple(r) for r in edits.follow_renames(moves).collect()} == {("p0", f"p{n}"), ("x", "y")}


def test_renames_in_a_cycle(spark):
    moves = spark.range(3).selectExpr("'p' || id as old_path", "'p' || (id + 1) % 3 as new_path").unionByName(spark.sql("select 'x' old_path, 'p0' new_path"))
    with pytest.raises(ValueError):
        edits.follow_renames(moves)


def test_edits(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, title string, lang string")
    new, log = edits.bulk_edit(old, {"lang": "x"}, "id")
    assert [(r.id, r.field, r.old, r.new) for r in log.collect()] == [(2, "lang", "y", "x")] and new.where("lang = 'x'").count() == 2
    plan = spark.createDataFrame([(1, "A"), (2, "a"), (3, "B")], "o int, t string")
    taken = spark.createDataFrame([("b",)], "t string")
    assert {r.o: r.name for r in edits.number_collisions(plan, "t", "o", taken).collect()} == {1: "A", 2: "a (2)", 3: "B (2)"}
    tags = spark.sql("select array('Sci', 'Fi') a, array('sci', 'New') b").select(edits.add_only_tags(F.col("a"), F.col("b")).alias("t")).first().t
    assert tags == ["Sci", "Fi", "New"]


def test_recipe(spark):
    books = spark.createDataFrame([(1, "A.Title", "", "", False), (2, "Fine", "<p>x</p>", "de", True)], "book_id int, title string, description string, language string, locked boolean")
    steps = default_steps()
    guess = Step("guess", lambda b: b.select("book_id", F.lit("language").alias("field"), F.lit("en").alias("value"), F.lit(0.5).alias("confidence")))
    recipe = Recipe([steps["strip_description_html"], steps["missing_space_title"], guess])
    out = {(r.book_id, r.step): r.outcome for r in recipe.results(books).collect()}
    assert out == {(1, "missing_space_title"): "applied", (1, "guess"): "review", (2, "strip_description_html"): "skipped", (2, "guess"): "skipped"}
    new, changes = recipe.apply(books)
    assert {r.book_id: r.title for r in new.collect()} == {1: "A. Title", 2: "Fine"} and changes.count() == 1
    again = Recipe.from_json(recipe.to_json(), {**steps, "guess": guess})
    assert [s.name for s in again.steps] == [s.name for s in recipe.steps] and again.threshold == recipe.threshold


def test_stream(spark, tmp_path):
    rows = "values (1L, 'b', 'title', '', 'x', timestamp'2024-01-01 10:00:00'), (1L, 'b', 'title', '', 'x', timestamp'2024-01-01 10:05:00'), (2L, 'b', 'lang', '', 'y', timestamp'2024-01-01 11:00:00')"
    spark.sql(f"select * from ({rows}) as t(change_id, book_id, field, old, new, at)").write.parquet(f"{tmp_path}/in")
    journal.append_to(journal.read_changes(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    done = spark.read.parquet(f"{tmp_path}/out")
    assert done.count() == 2 and journal.hourly(done).count() == 2


def test_paths(spark):
    from quire.operators import paths

    files = spark.createDataFrame([("/r/Ann Lee/Saga/1 - One.epub",), ("/r/Ann Lee/Other/2 - Two.epub",), ("/r/Bo/3 - Three.epub",)], "path string")
    found = paths.parse_paths(files, "%authors%/%series%/%series_index% - %title%", "/r")
    saved = spark.createDataFrame([("/r/Ann Lee/Other/2 - Two.epub", "series", "Saga")], "path string, field string, value string")
    sure = {(r.path[-9:-5].strip(" -"), r.field): (r.value, r.sure) for r in paths.corroborate(found, saved).collect()}
    assert sure["One", "authors"] == ("Ann Lee", True) and sure["One", "series"] == ("Saga", True) and sure["Two", "series"] == ("Other", False)
    conf = {r.path: (r.confidence, r.missing) for r in paths.path_confidence(paths.corroborate(found, saved)).collect()}
    assert conf["/r/Ann Lee/Saga/1 - One.epub"] == (0.975, 0) and conf["/r/Ann Lee/Other/2 - Two.epub"] == (0.925, 0) and conf["/r/Bo/3 - Three.epub"][1] == 1
    assert {r.siblings for r in paths.sibling_stems(files).collect()} == {0}
