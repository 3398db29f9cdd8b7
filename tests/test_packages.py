"""Package documents that are edited and mended in place."""

from xml.etree import ElementTree

from quire.sources.archives import NS
from quire.sources.packages import OPF, edit_package, external_packages, mend_package, mended_packages

DOCUMENT = b"""<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf">
<dc:identifier id="id">urn:uuid:1</dc:identifier><dc:identifier opf:scheme="ISBN">9780441172719</dc:identifier><dc:title>Old</dc:title><dc:creator id="a">Ann Lee</dc:creator><meta refines="#a" property="file-as">Lee, Ann</meta>
<dc:creator id="t">Per Lund</dc:creator><meta refines="#t" property="role">trl</meta><dc:subject id="d">823</dc:subject><meta refines="#d" property="authority">DDC</meta><dc:subject>old tag</dc:subject><meta name="cover" content="c"/><meta property="dcterms:modified">2020</meta>
<meta name="calibre:series" content="Saga"/><meta refines="#zz" property="role">aut</meta></metadata><manifest><item id="x" href="a.xhtml" media-type="application/xhtml+xml"/><item id="x" href="b.xhtml" media-type="application/xhtml+xml"/><item id="m" href="gone%20away.xhtml" media-type="x"/></manifest>
<spine><itemref idref="x"/><itemref idref="m"/><itemref idref="q"/></spine><guide><reference type="text" title="T" href="a.xhtml#p"/><reference type="toc" title="T" href="no.xhtml"/></guide></package>"""


def texts(package, path):
    return [e.text for e in package.findall(path, {"o": NS["opf"], "dc": NS["dc"]})]


def test_editing_keeps_the_rest():
    new = ElementTree.fromstring(edit_package(DOCUMENT, {"title": "New & <old>", "authors": [("Bo Ek", "Ek, Bo"), ("Cy", "")], "tags": ["one"], "isbn": "9780804429573", "series_index": "2", "publisher": "House", "stamp": "OK 2026"}))
    assert texts(new, ".//dc:title") == ["New & <old>"] and texts(new, ".//dc:creator") == ["Bo Ek", "Cy", "Per Lund"] and texts(new, ".//dc:subject") == ["823", "one"] and texts(new, ".//dc:publisher") == ["House"]
    assert texts(new, ".//dc:identifier") == ["urn:uuid:1", "urn:isbn:9780804429573"]
    metas = {(m.get("name") or m.get("property")): (m.get("content") or m.text) for m in new.iter(f"{OPF}meta")}
    assert metas["cover"] == "c" and metas["dcterms:modified"] == "2020" and metas["authority"] == "DDC" and metas["file-as"] == "Ek, Bo" and metas["calibre:series"] == "Saga" and metas["group-position"] == "2" and metas["quire:checked"] == "OK 2026"
    assert len(new.findall(f".//{OPF}reference")) == 2 and len(new.findall(f".//{OPF}item")) == 3
    again = ElementTree.fromstring(edit_package(edit_package(DOCUMENT, {"series": ""}), {"title": ""}))
    assert texts(again, ".//dc:title") == [] and "calibre:series" not in {m.get("name") for m in again.iter(f"{OPF}meta")} and texts(again, ".//dc:creator") == ["Ann Lee", "Per Lund"]


def test_mending(spark):
    faults = [("DANGLING_REFINES", "zz", None), ("DUPLICATE_MANIFEST_ID", "x", "x-2"), ("MANIFEST_FILE_MISSING", "OEBPS/gone%20away.xhtml", None), ("DANGLING_SPINE_ITEMREF", "q", None), ("BAD_GUIDE", "no.xhtml", None), ("LANGUAGE_MISSING", "", "en"), ("EPUB2_ATTRIBUTES_IN_EPUB3", "", ""), ("TITLE_MISSING", "", None)]
    new = ElementTree.fromstring(mend_package(DOCUMENT, faults))
    assert [i.get("id") for i in new.iter(f"{OPF}item")] == ["x", "x-2"] and [r.get("idref") for r in new.iter(f"{OPF}itemref")] == ["x"] and [g.get("type") for g in new.iter(f"{OPF}reference")] == ["text"]
    assert texts(new, ".//dc:language") == ["en"] and not any(m.get("refines") == "#zz" for m in new.iter(f"{OPF}meta")) and not any(k.startswith(OPF) for e in new.iter() for k in e.attrib)
    documents = spark.createDataFrame([("b", DOCUMENT), ("bad", b"no xml"), ("fine", DOCUMENT)], "book_id string, content binary")
    fixes = spark.createDataFrame([("b", "LANGUAGE_MISSING", "", "de"), ("bad", "LANGUAGE_MISSING", "", "de")], "book_id string, code string, before string, after string")
    rows = {r.book_id: r for r in mended_packages(documents, fixes).collect()}
    assert set(rows) == {"b", "bad"} and rows["bad"].error and texts(ElementTree.fromstring(bytes(rows["b"].opf)), ".//dc:language") == ["de"]


def test_packages_of_other_programs(spark):
    other = DOCUMENT.replace(b"Lee, Ann", b"Unknown")
    (row,) = external_packages(spark.createDataFrame([("1", other), ("2", b"<")], "id string, content binary")).collect()
    assert (row.title, row.authors, row.sort, row.isbn, row.tags, row.series) == ("Old", ["Ann Lee"], [""], "9780441172719", ["old tag"], "Saga")


def test_the_journal_names_the_ids_that_the_package_gets(spark):
    from quire.operators.validation import renamed_ids

    ids = ["x", "x", "x-2", "x", "x-04", "y", "x-4", "z", "z", "x-2"]
    package = "".join(f'<item id="{i}" href="{k}"/>' for k, i in enumerate(ids))
    document = f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><manifest>{package}</manifest></package>'.encode()
    rows = [(r.item_id, r.new_id) for r in renamed_ids(spark.createDataFrame([(1, i) for i in ids], "book_id int, item_id string")).collect()]
    assert sorted(rows) == [("x", "x-3"), ("x", "x-5"), ("x-2", "x-2-2"), ("z", "z-2")]
    new = ElementTree.fromstring(mend_package(document, [("DUPLICATE_MANIFEST_ID", before, after) for before, after in rows]))
    assert sorted(i.get("id") for i in new.iter(f"{OPF}item")) == sorted({*ids, *(after for _, after in rows)})
