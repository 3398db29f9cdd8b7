"""Package documents that exist already: fields set and faults mended in place, with all that isn't touched kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.sources.archives import NS, _package_fields, _tree

OPF, DC = f"{{{NS['opf']}}}", f"{{{NS['dc']}}}"
SIMPLE = ("title", "language", "publisher", "description", "date")
SERIES = ("calibre:series", "calibre:series_index")
STAMP = "quire:checked"
for _prefix, _name in (("", "opf"), ("dc", "dc")):
    ElementTree.register_namespace(_prefix, NS[_name])
ElementTree.register_namespace("opf", NS["opf"])


def _written(package: ElementTree.Element) -> bytes:
    return b'<?xml version="1.0" encoding="utf-8"?>\n' + ElementTree.tostring(package, encoding="utf-8")


def _metadata(package: ElementTree.Element) -> ElementTree.Element:
    found = package.find(f"{OPF}metadata")
    if found is None:
        found = ElementTree.Element(f"{OPF}metadata")
        package.insert(0, found)
    return found


def _drop(meta: ElementTree.Element, gone: list[ElementTree.Element]) -> None:
    """Take elements out, with the metas that refine them."""
    ids = {f"#{e.get('id')}" for e in gone if e.get("id")}
    for e in [*gone, *(m for m in meta.findall(f"{OPF}meta") if m.get("refines") in ids)]:
        if e in list(meta):
            meta.remove(e)


def _role(meta: ElementTree.Element, creator: ElementTree.Element) -> str:
    refined = (m.text or "" for m in meta.findall(f"{OPF}meta") if creator.get("id") and m.get("refines") == f"#{creator.get('id')}" and m.get("property") == "role")
    return creator.get(f"{OPF}role") or next(refined, "")


def edit_package(document: bytes, changes: dict) -> bytes:
    """The document with changed fields: title, language, publisher, description, date, isbn, series, series_index (texts; empty takes the field out),
    authors (pairs of name and sort form), tags, stamp (a line about the last check). Creators with other roles, identifiers, other
    metas, classes of subjects, manifest, spine and guide stay as they are."""
    package = _tree(document)
    meta, three = _metadata(package), (package.get("version") or "").startswith("3")
    ids = {e.get("id") for e in package.iter() if e.get("id")}

    def fresh(stem: str) -> str:
        n = 1
        while f"{stem}{n}" in ids:
            n += 1
        ids.add(f"{stem}{n}")
        return f"{stem}{n}"

    def add(tag: str, text: str, at: int | None = None, **attributes: str) -> ElementTree.Element:
        e = ElementTree.Element(tag, {k.replace("__", ":"): v for k, v in attributes.items()})
        e.text = text or None
        meta.insert(len(meta) if at is None else at, e)
        return e

    def refine(e: ElementTree.Element, prop: str, text: str) -> None:
        if not e.get("id"):
            e.set("id", fresh("r"))
        add(f"{OPF}meta", text, refines=f"#{e.get('id')}", property=prop)

    for tag in SIMPLE:
        if tag in changes:
            first, *others = [*meta.findall(f"{DC}{tag}"), None]
            if not changes[tag]:
                _drop(meta, [e for e in (first, *others) if e is not None])
            elif first is None:
                add(f"{DC}{tag}", changes[tag])
            else:
                first.text = changes[tag]
    if "authors" in changes:
        writers = [c for c in meta.findall(f"{DC}creator") if _role(meta, c) in ("", "aut")]
        at = list(meta).index(writers[0]) if writers else None
        _drop(meta, writers)
        for k, (name, sort) in enumerate(changes["authors"]):
            e = add(f"{DC}creator", name, None if at is None else min(at + k, len(meta)))
            if three:
                refine(e, "role", "aut")
                if sort:
                    refine(e, "file-as", sort)
            else:
                e.set(f"{OPF}role", "aut")
                if sort:
                    e.set(f"{OPF}file-as", sort)
    if "tags" in changes:
        classed = {m.get("refines") for m in meta.findall(f"{OPF}meta") if m.get("property") == "authority"}
        _drop(meta, [s for s in meta.findall(f"{DC}subject") if not s.get(f"{OPF}authority") and f"#{s.get('id')}" not in classed])
        for tag in changes["tags"]:
            add(f"{DC}subject", tag)
    if "isbn" in changes:
        unique = package.get("unique-identifier")
        own = [i for i in meta.findall(f"{DC}identifier") if (i.get(f"{OPF}scheme") or "").upper() == "ISBN" or (i.text or "").strip().lower().startswith("urn:isbn:")]
        kept = next((i for i in own if i.get("id") == unique), None)
        _drop(meta, [i for i in own if i is not kept])
        if changes["isbn"]:
            if kept is None:
                kept = add(f"{DC}identifier", "")
            kept.text = f"urn:isbn:{changes['isbn']}"
    if "series" in changes or "series_index" in changes:
        now = _package_fields(package, "")
        name, n = changes.get("series", now["series"]), changes.get("series_index", now["series_index"])
        _drop(meta, [m for m in meta.findall(f"{OPF}meta") if m.get("name") in SERIES or m.get("property") in (*SERIES, "belongs-to-collection")])
        if name:
            add(f"{OPF}meta", "", name=SERIES[0], content=name)
            if n:
                add(f"{OPF}meta", "", name=SERIES[1], content=str(n))
            if three:
                e = add(f"{OPF}meta", name, property="belongs-to-collection", id=fresh("series"))
                if n:
                    refine(e, "group-position", str(n))
    if "stamp" in changes:
        _drop(meta, [m for m in meta.findall(f"{OPF}meta") if m.get("name") == STAMP])
        if changes["stamp"]:
            add(f"{OPF}meta", "", name=STAMP, content=changes["stamp"])
    return _written(package)


def mend_package(document: bytes, faults: list[tuple[str, str, str | None]]) -> bytes:
    """The document without the faults, rows (code, before, after) as validation.fixes gives them; also BAD_GUIDE, whose before is a path in the
    guide. Codes without a fix change nothing."""
    package = _tree(document)
    meta = _metadata(package)
    manifest, spine, guide = (package.find(f"{OPF}{t}") for t in ("manifest", "spine", "guide"))
    three = (package.get("version") or "").startswith("3")
    folderless = lambda e: re.split("[?#]", e.get("href") or "")[0]
    for code, before, after in faults:
        if code == "PRIMARY_ID_MISSING":
            e = next((i for i in meta.findall(f"{DC}identifier") if i.get("id") and i.get("id") == package.get("unique-identifier")), None)
            if e is None:
                e = ElementTree.SubElement(meta, f"{DC}identifier", {"id": package.get("unique-identifier") or "book-id"})
            e.text = after
            package.set("unique-identifier", e.get("id"))
        elif code == "LANGUAGE_MISSING":
            (meta.find(f"{DC}language") if meta.find(f"{DC}language") is not None else ElementTree.SubElement(meta, f"{DC}language")).text = after
        elif code == "AUTHORS_AMPERSAND":
            for c in [c for c in meta.findall(f"{DC}creator") if " & " in (c.text or "")]:
                first, *others = [x.strip() for x in c.text.split(" & ") if x.strip()]
                c.text, at = first, list(meta).index(c)
                for k, name in enumerate(others):
                    e = ElementTree.Element(f"{DC}creator", {a: v for a, v in c.attrib.items() if a == f"{OPF}role"})
                    e.text = name
                    meta.insert(at + 1 + k, e)
        elif code == "DANGLING_REFINES":
            for m in [m for m in meta.findall(f"{OPF}meta") if (m.get("refines") or "").lstrip("#") == before]:
                meta.remove(m)
        elif code == "MANIFEST_FILE_MISSING" and manifest is not None:
            gone = [i for i in manifest.findall(f"{OPF}item") if before == folderless(i) or before.endswith("/" + folderless(i))]
            for i in gone:
                manifest.remove(i)
            left = {i.get("id") for i in manifest.findall(f"{OPF}item")}
            for r in [r for r in (spine if spine is not None else []) if r.get("idref") in {i.get("id") for i in gone} - left]:
                spine.remove(r)
        elif code == "DUPLICATE_MANIFEST_ID" and manifest is not None:
            taken = {i.get("id") for i in manifest.findall(f"{OPF}item")}
            for i in [i for i in manifest.findall(f"{OPF}item") if i.get("id") == before][1:]:
                n = 2
                while f"{before}-{n}" in taken:
                    n += 1
                i.set("id", f"{before}-{n}")
                taken.add(f"{before}-{n}")
        elif code == "DANGLING_SPINE_ITEMREF" and spine is not None:
            for r in [r for r in spine.findall(f"{OPF}itemref") if r.get("idref") == before]:
                spine.remove(r)
        elif code == "BAD_GUIDE" and guide is not None:
            for g in [g for g in guide if before == folderless(g) or before.endswith("/" + folderless(g))]:
                guide.remove(g)
            if not len(guide):
                package.remove(guide)
                guide = None
        elif code == "EPUB2_ATTRIBUTES_IN_EPUB3" and three:
            for k, e in enumerate([*meta.findall(f"{DC}creator"), *meta.findall(f"{DC}contributor"), *meta.findall(f"{DC}identifier")]):
                for name in ("role", "file-as", "scheme"):
                    if (value := e.attrib.pop(f"{OPF}{name}", None)) is not None and name != "scheme":
                        e.set("id", e.get("id") or f"old-{k}")
                        m = ElementTree.SubElement(meta, f"{OPF}meta", {"refines": f"#{e.get('id')}", "property": name})
                        m.text = value
    return _written(package)


def mended_packages(documents: DataFrame, fixes: DataFrame) -> DataFrame:
    """(book_id, opf, error): the package documents (book_id, content) of the books that ``fixes`` (book_id, code, before, after) has rows
    for, mended. What comes of it goes into book_source.write_books."""
    lists = fixes.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("code", "before", "after"))).alias("faults"))  # a book's own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for book, content, faults in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    out.append((book, mend_package(content, [(f["code"], f["before"] or "", f["after"]) for f in faults]), ""))
                except Exception as e:  # noqa: BLE001 - one bad document never ends the run
                    out.append((book, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.string())], ["book_id", "opf", "error"])

    return documents.join(lists, "book_id").select("book_id", "content", "faults").mapInArrow(run, "book_id string, opf binary, error string")


def external_packages(documents: DataFrame) -> DataFrame:
    """(id, title, authors, sort, publisher, date, language, isbn, tags, series, series_index) of package documents that another program wrote
    (id, content). A sort form of "Unknown" is none; a document that can't be read has no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, content in zip(batch["id"], batch["content"]):
                try:
                    f = _package_fields(_tree(content), "")
                except (ElementTree.ParseError, ValueError):
                    continue
                writers = [c for c in f["creators"] if c["role"] in ("", "aut")]
                sorts = ["" if c["sort"].lower() == "unknown" else c["sort"] for c in writers]
                rows.append((i, f["title"], [c["name"] for c in writers], sorts, f["publisher"], f["date"], f["language"], f["isbn"], f["subjects"], f["series"], f["series_index"]))
            yield pd.DataFrame(rows, columns=["id", "title", "authors", "sort", "publisher", "date", "language", "isbn", "tags", "series", "series_index"])

    return documents.select(F.col("id").cast("string").alias("id"), "content").mapInPandas(run, "id string, title string, authors array<string>, sort array<string>, publisher string, date string, language string, isbn string, tags array<string>, series string, series_index string")
