"""Book archives: zip files with a package document, read into one table per kind of row, and written anew."""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import collapse
from quire.sources.stores import file_system, seekable

#: Bytes of a member that are read at most; larger ones are listed only.
MEMBER_LIMIT = 8 << 20
#: Bytes of members that are handed on at a time, about.
BATCH_BYTES = 8 << 20
FRONT_DOCS, BACK_DOCS, MOST_TEXT, TAIL_SHARE = 4, 3, 20_000, 0.25
NS = {"opf": "http://www.idpf.org/2007/opf", "dc": "http://purl.org/dc/elements/1.1/", "c": "urn:oasis:names:tc:opendocument:xmlns:container", "enc": "http://www.w3.org/2001/04/xmlenc#"}
FONT_OBFUSCATION = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC")

PERSON = "struct<name:string,sort:string,role:string>"
RAW_SCHEMA = f"""path string, load_error string, version string, opf_path string, title string, language string, publisher string, description string, date string,
    isbn string, ddc string, series string, series_index string, creators array<{PERSON}>, subjects array<string>, unique_id string, toc_id string, encrypted boolean, encrypted_paths array<string>,
    identifiers array<struct<id:string,value:string>>, manifest array<struct<place:int,item_id:string,path:string,media_type:string,properties:string,remote:boolean>>,
    spine array<struct<place:int,idref:string>>, guide array<struct<type:string,title:string,path:string>>, metas array<struct<id:string,refines:string,property:string,old_attributes:boolean,value:string>>,
    entries array<struct<place:int,name:string,crc:bigint,size:bigint,stored:boolean,head:string>>, ids array<string>"""


def find_books(spark: SparkSession, folder: str, extension: str = "epub", recursive: bool = True) -> DataFrame:
    """(path, size, modified) of all archives below a folder, each once, without temporary files. Only directories are listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", recursive).load(folder)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).where(~F.col("path").rlike(r"/[.~][^/]*$")).distinct()


def _safe(root: str) -> bool:
    return bool(root) and not re.match(r"^/|^[A-Za-z]:", root) and "\\" not in root and "\0" not in root and ".." not in root.split("/")


def _tree(data: bytes) -> ElementTree.Element:
    """XML without a document type: nothing is expanded or fetched."""
    if re.search(rb"<!(DOCTYPE|ENTITY)[^>]*\[", data[:4096]):
        raise ValueError("document types are not read")
    return ElementTree.fromstring(data)


def _text(node) -> str:
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def read_package(path: str, source: BinaryIO | None) -> dict:
    """One archive's row, from a seekable file, of which only the directory and the members needed are read; what is wrong with it ends up in load_error."""
    row = {c: [] if c in LISTS else "" for c in COLUMNS} | {"path": path, "encrypted": False}
    try:
        with zipfile.ZipFile(source) as z:
            for place, info in enumerate(z.infolist()):
                head = z.read(info)[:64].decode("latin-1").strip() if info.filename == "mimetype" and info.file_size < 4096 else ""
                row["entries"].append({"place": place, "name": info.filename, "crc": info.CRC, "size": info.file_size, "stored": info.compress_type == 0, "head": head})
            names = {e["name"] for e in row["entries"]}
            container = _tree(z.read("META-INF/container.xml"))
            opf = next((r.get("full-path") for r in container.iter(f"{{{NS['c']}}}rootfile")), "")
            if not _safe(opf or "") or opf not in names:
                raise ValueError("no package document")
            package, folder = _tree(z.read(opf)), posixpath.dirname(opf)
            if "META-INF/encryption.xml" in names:
                row["encrypted"] = True
                for data in _tree(z.read("META-INF/encryption.xml")).iter(f"{{{NS['enc']}}}EncryptedData"):
                    method, ref = data.find("enc:EncryptionMethod", NS), data.find(".//enc:CipherReference", NS)
                    if ref is not None and (method is None or method.get("Algorithm") not in FONT_OBFUSCATION):
                        row["encrypted_paths"].append(unquote(ref.get("URI") or ""))
        row.update(_package_fields(package, folder))
        row["opf_path"] = opf
    except Exception as e:  # noqa: BLE001 - one bad archive never ends the scan
        row["load_error"] = f"{type(e).__name__}: {e}"[:300]
    return row


def _package_fields(package: ElementTree.Element, folder: str) -> dict:
    meta = package.find("opf:metadata", NS)
    meta = meta if meta is not None else ElementTree.Element("none")
    old = lambda node, name: node.get(f"{{{NS['opf']}}}{name}") or ""
    metas = [{"id": m.get("id") or "", "refines": m.get("refines") or "", "property": m.get("property") or m.get("name") or "", "old_attributes": False, "value": _text(m) or m.get("content") or ""} for m in meta.findall("opf:meta", NS)]
    refined = lambda i, prop: next((m["value"] for m in metas if i and m["refines"] == f"#{i}" and m["property"] == prop), "")
    plain = lambda prop: next((m["value"] for m in metas if m["property"] == prop and not m["refines"]), "")
    creators = [{"name": _text(c), "sort": old(c, "file-as") or refined(c.get("id"), "file-as"), "role": old(c, "role") or refined(c.get("id"), "role")} for c in meta.findall("dc:creator", NS)]
    for c in [*meta.findall("dc:creator", NS), *meta.findall("dc:identifier", NS)]:
        if old(c, "file-as") or old(c, "role") or old(c, "scheme"):
            metas.append({"id": "", "refines": "", "property": c.tag.rpartition("}")[2], "old_attributes": True, "value": ""})
    subjects, ddc = [], ""
    for s in meta.findall("dc:subject", NS):
        if (old(s, "authority") or refined(s.get("id"), "authority")).upper() == "DDC":
            ddc = ddc or refined(s.get("id"), "term") or _text(s)
        elif _text(s):
            subjects.append(_text(s))
    identifiers = [{"id": i.get("id") or "", "value": _text(i), "scheme": old(i, "scheme")} for i in meta.findall("dc:identifier", NS)]
    isbn = next((re.sub("(?i)^urn:isbn:", "", i["value"]) for i in identifiers if i["scheme"].upper() == "ISBN" or i["value"].lower().startswith("urn:isbn:")), "")
    collection = next((m for m in metas if m["property"] == "belongs-to-collection"), None)
    series = plain("calibre:series") or (collection["value"] if collection else "")
    index = plain("calibre:series_index") or (refined(collection["id"], "group-position") if collection else "")

    def path(href: str) -> str:
        return posixpath.normpath(posixpath.join(folder, unquote(re.split("[?#]", href)[0])))

    remote = lambda href: bool(re.match("[a-z]+://", href))
    items = package.findall("opf:manifest/opf:item", NS)
    first = lambda tag: _text(meta.find(f"dc:{tag}", NS))
    spine = package.find("opf:spine", NS)
    return {
        "version": package.get("version") or "", "title": first("title"), "language": first("language"), "publisher": first("publisher"), "description": first("description"), "date": first("date"),
        "isbn": isbn, "ddc": ddc, "series": series, "series_index": index if series else "", "creators": [c for c in creators if c["name"]], "subjects": subjects,
        "unique_id": package.get("unique-identifier") or "", "toc_id": (spine.get("toc") or "") if spine is not None else "", "identifiers": [{"id": i["id"], "value": i["value"]} for i in identifiers], "metas": metas,
        "manifest": [{"place": k, "item_id": i.get("id") or "", "path": h if remote(h := i.get("href") or "") else path(h), "media_type": (i.get("media-type") or "").lower(), "properties": i.get("properties") or "", "remote": remote(i.get("href") or "")} for k, i in enumerate(items)],
        "spine": [{"place": k, "idref": r.get("idref") or ""} for k, r in enumerate(package.findall("opf:spine/opf:itemref", NS))],
        "ids": [e.get("id") for e in package.iter() if e.get("id")],
        "guide": [{"type": g.get("type") or "", "title": g.get("title") or "", "path": path(g.get("href") or "")} for g in package.findall("opf:guide/opf:reference", NS)],
    }


#: Names of the columns, and those that are arrays.
COLUMNS = [c.strip().split(" ")[0] for c in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", RAW_SCHEMA)).split(",")]
LISTS = ("creators", "subjects", "encrypted_paths", "identifiers", "manifest", "spine", "guide", "metas", "entries", "ids")


def tables(raw: DataFrame) -> dict[str, DataFrame]:
    """The tables that validation takes; a book's id is its path."""
    book = F.col("path").alias("book_id")
    each = lambda c: raw.where("load_error = ''").select(book, F.explode(c).alias("x")).select("book_id", "x.*")
    books = raw.select(book, "load_error", "version", "title", "language", F.transform("creators", lambda c: c["name"]).alias("authors"), "unique_id", "toc_id", F.coalesce("encrypted", F.lit(False)).alias("encrypted"))
    entries = raw.select(book, F.explode("entries").alias("x")).select("book_id", "x.*")
    ids = raw.select(book, F.explode("ids").alias("ref"))
    return {"books": books, "entries": entries, "ids": ids} | {c: each(c) for c in ("identifiers", "manifest", "spine", "guide", "metas")}


def metadata(raw: DataFrame) -> DataFrame:
    """The fields of every book that loaded; authors and sort forms stay aligned by place."""
    writers = F.filter("creators", lambda c: c["role"].isin("", "aut"))
    return raw.where("load_error = ''").select(
        F.col("path").alias("book_id"), collapse(F.col("title")).alias("title"), F.transform(writers, lambda c: c["name"]).alias("authors"), F.transform(writers, lambda c: c["sort"]).alias("author_sort"), F.col("subjects").alias("tags"),
        "publisher", "date", "isbn", "ddc", "language", "series", "series_index", "description",
    )


def read_members(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(book_id, path, content) of the wanted members (book_id, path) of at most MEMBER_LIMIT bytes, with safe names only, of archives in or
    below a folder. Of an archive its directory and the wanted members are read, in the task that has its list; an archive that
    can't be read, or lies elsewhere, has no members. Contents are handed on some megabytes at a time."""
    _, root, prefix = file_system(folder)
    lists = wanted.groupBy("book_id").agg(F.collect_set("path").alias("paths"))  # a book's own members
    inside = lists.where(F.col("book_id").startswith(f"{prefix}{root.rstrip('/')}/") & ~F.col("book_id").contains("/../"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.binary()))], ["book_id", "path", "content"])

        for batch in batches:
            rows, held = [], 0
            for book, paths in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    system, place, _ = file_system(book)
                    with system.open_input_file(place) as file, zipfile.ZipFile(seekable(file)) as z:
                        sizes = {i.filename: i.file_size for i in z.infolist()}
                        found = [(book, p, z.read(p)) for p in sorted(paths) if _safe(p) and sizes.get(p, MEMBER_LIMIT + 1) <= MEMBER_LIMIT]
                except Exception:  # noqa: BLE001 - an unreadable archive has no members
                    continue
                for row in found:
                    rows.append(row)
                    held += len(row[2])
                    if held >= BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
            yield batch_of(rows)

    return inside.mapInArrow(read, "book_id string, path string, content binary")


def front_and_back(order: DataFrame, members: DataFrame) -> DataFrame:
    """(book_id, front, back): text of the first four and last three documents of the reading order (book_id, ordinal, path), no
    document twice, 20,000 characters in all. Where there are last documents a quarter is kept for them, and they also get what the
    front leaves; else the front may have all."""
    text = F.decode("content", "UTF-8")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style|head)\b.*?</\1\s*>", " "), r"(?i)</?(p|div|br|h[1-6]|li|tr)\b[^>]*>", "\n"), "<[^>]*>", "")
    n = F.count("*").over(Window.partitionBy("book_id"))
    rows = order.withColumn("n", n).where((F.col("ordinal") <= FRONT_DOCS) | (F.col("ordinal") > F.col("n") - BACK_DOCS)).join(members.select("book_id", "path", text.alias("t")), ["book_id", "path"])
    part = F.when(F.col("ordinal") <= FRONT_DOCS, "front").otherwise("back")
    whole = rows.withColumn("part", part).groupBy("book_id", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "t"))), lambda x: x["t"]), "\n").alias("t"))  # seven documents at most
    sides = whole.groupBy("book_id").pivot("part", ["front", "back"]).agg(F.first("t"))
    return sides.select("book_id", *(c.alias(a) for c, a in zip(budget(F.coalesce("front", F.lit("")), F.col("back")), ("front", "back"))))


def budget(front: Column, back: Column) -> tuple[Column, Column]:
    """Both texts cut to MOST_TEXT characters in all; back is null where there are no last documents."""
    tail = int(MOST_TEXT * TAIL_SHARE)
    head = F.substring(front, F.lit(1), F.when(back.isNull(), MOST_TEXT).otherwise(MOST_TEXT - tail))
    return head, F.substring(F.coalesce(back, F.lit("")), F.lit(1), F.lit(MOST_TEXT) - F.length(head))


def package_document(fields: dict) -> bytes:
    """A version 3 package document of a book's fields: title, language, authors (name, sort), tags, ddc, series, isbn, manifest, spine."""
    from xml.sax.saxutils import escape, quoteattr

    e = lambda x: escape(str(x or ""))
    lines = [f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="{NS["opf"]}" version="3.0" unique-identifier="id"><metadata xmlns:dc="{NS["dc"]}">', f'<dc:identifier id="id">{e(fields.get("identifier"))}</dc:identifier>']
    lines += [f"<dc:title>{e(fields.get('title'))}</dc:title>", f"<dc:language>{e(fields.get('language') or 'en')}</dc:language>"]
    for k, (name, sort) in enumerate(fields.get("authors") or []):
        lines.append(f'<dc:creator id="a{k}">{e(name)}</dc:creator>')
        if sort:
            lines.append(f'<meta refines="#a{k}" property="file-as">{e(sort)}</meta>')
    lines += [f"<dc:subject>{e(t)}</dc:subject>" for t in fields.get("tags") or []]
    if fields.get("ddc"):
        lines.append(f'<dc:subject id="ddc">{e(fields["ddc"])}</dc:subject><meta refines="#ddc" property="authority">DDC</meta>')
    if fields.get("isbn"):
        lines.append(f"<dc:identifier>urn:isbn:{e(fields['isbn'])}</dc:identifier>")
    if fields.get("series"):
        n = fields.get("series_index")
        lines.append(f'<meta property="belongs-to-collection" id="s">{e(fields["series"])}</meta><meta name="calibre:series" content={quoteattr(fields["series"])}/>')
        if n:
            lines.append(f'<meta refines="#s" property="group-position">{e(n)}</meta><meta name="calibre:series_index" content={quoteattr(str(n))}/>')
    for tag in ("publisher", "date", "description"):
        if fields.get(tag):
            lines.append(f"<dc:{tag}>{e(fields[tag])}</dc:{tag}>")
    lines.append("</metadata><manifest>" + "".join(f"<item id={quoteattr(i)} href={quoteattr(h)} media-type={quoteattr(m)}/>" for i, h, m in fields.get("manifest") or []) + "</manifest>")
    lines.append("<spine>" + "".join(f"<itemref idref={quoteattr(i)}/>" for i in fields.get("spine") or []) + "</spine></package>")
    return "\n".join(lines).encode()
