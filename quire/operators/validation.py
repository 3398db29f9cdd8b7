"""Structure checks of book archives: each rule is one small DataFrame of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import text_of, unsafe_path

# Issue codes with severity and whether a fix is known.
CODES = {
    "LOAD_FAILED": ("error", False), "MIMETYPE_MISSING": ("error", False), "MIMETYPE_CONTENT": ("error", False), "MIMETYPE_POSITION": ("warning", False), "PRIMARY_ID_MISSING": ("error", True), "TITLE_MISSING": ("error", False),
    "LANGUAGE_MISSING": ("error", True), "AUTHORS_AMPERSAND": ("warning", True), "DANGLING_REFINES": ("warning", True), "EPUB2_ATTRIBUTES_IN_EPUB3": ("warning", True), "MANIFEST_FILE_MISSING": ("error", True),
    "DUPLICATE_MANIFEST_ID": ("error", True), "DANGLING_SPINE_ITEMREF": ("error", True), "NO_TOC": ("warning", True), "DRM_DETECTED": ("locked", False),
}
STATUSES = ("INVALID", "DRM", "ISSUES", "OK")


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows that grow with the books, for a join by shuffle: what many rules look up would else go through the driver for each of them."""
    return rows.hint("merge")


def issue_rows(df: DataFrame, code: str, detail: Column) -> DataFrame:
    severity, fixable = CODES[code]
    return df.select("book_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"), F.lit(fixable).alias("fixable"))


def missing_files(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Manifest items whose file the archive lacks; remote ones need none."""
    return manifest.where("not remote").join(_shuffled(entries.select("book_id", F.col("name").alias("path"))), ["book_id", "path"], "left_anti")


def repeated_ids(manifest: DataFrame) -> DataFrame:
    """(book_id, item_id, n): ids that more than one item of a book has."""
    return manifest.groupBy("book_id", "item_id").agg(F.count("*").alias("n")).where("n > 1")


def dangling_guide(guide: DataFrame, entries: DataFrame) -> DataFrame:
    """Guide references to files that the archive lacks."""
    return guide.join(_shuffled(entries.select("book_id", F.col("name").alias("path"))), ["book_id", "path"], "left_anti")


def repaired_guide(guide: DataFrame, entries: DataFrame) -> DataFrame:
    """The guide without references that lead nowhere, each kind and target once."""
    return guide.join(_shuffled(entries.select("book_id", F.col("name").alias("path"))), ["book_id", "path"], "left_semi").dropDuplicates(["book_id", "type", "path"])


def validate(t: dict[str, DataFrame]) -> DataFrame:
    """Issues of all books. Tables: books (book_id, load_error, version, title, language, authors, unique_id, toc_id, encrypted), entries
    (book_id, place, name, stored, head), identifiers (book_id, id, value), manifest (book_id, item_id, path, remote, properties, media_type),
    spine (book_id, place, idref), ids (book_id, ref: every id of the package), metas (book_id, id, refines, property, old_attributes). Rules on one table need no shuffle; those that look
    something up are anti-joins. A book that did not load has that one issue."""
    books = t["books"]
    failed = books.where(text_of(F.col("load_error")) != "")
    fine = books.where(text_of(F.col("load_error")) == "")
    ids = fine.select("book_id")
    mime = t["entries"].where("name = 'mimetype'")
    items, spine, metas = t["manifest"], t["spine"], t["metas"]
    known = items.select("book_id", F.col("item_id").alias("ref"))
    rules = [
        issue_rows(failed, "LOAD_FAILED", F.col("load_error")),
        issue_rows(ids.join(_shuffled(mime), "book_id", "left_anti"), "MIMETYPE_MISSING", F.lit("")),
        issue_rows(mime.where("head <> 'application/epub+zip'"), "MIMETYPE_CONTENT", F.col("head")),
        issue_rows(mime.where("head = 'application/epub+zip' and (place <> 0 or not stored)"), "MIMETYPE_POSITION", F.col("place")),
        issue_rows(fine.join(_shuffled(t["identifiers"].where("value <> ''").select("book_id", F.col("id").alias("unique_id"))), ["book_id", "unique_id"], "left_anti"), "PRIMARY_ID_MISSING", F.col("unique_id")),
        issue_rows(fine.where(F.trim(text_of(F.col("title"))) == ""), "TITLE_MISSING", F.lit("")),
        issue_rows(fine.where(F.trim(text_of(F.col("language"))) == ""), "LANGUAGE_MISSING", F.lit("")),
        issue_rows(fine.where(F.exists(F.col("authors"), lambda a: a.contains(" & "))), "AUTHORS_AMPERSAND", F.array_join("authors", "; ")),
        issue_rows(metas.where("refines <> ''").withColumn("ref", F.regexp_replace("refines", "^#", "")).join(_shuffled(t["ids"]), ["book_id", "ref"], "left_anti"), "DANGLING_REFINES", F.col("ref")),
        issue_rows(metas.where("old_attributes").select("book_id", "property").join(_shuffled(fine.where("version >= '3'").select("book_id")), "book_id"), "EPUB2_ATTRIBUTES_IN_EPUB3", F.col("property")),
        issue_rows(missing_files(items, t["entries"]), "MANIFEST_FILE_MISSING", F.col("path")),
        issue_rows(repeated_ids(items), "DUPLICATE_MANIFEST_ID", F.col("item_id")),
        issue_rows(spine.withColumn("ref", F.col("idref")).join(_shuffled(known), ["book_id", "ref"], "left_anti"), "DANGLING_SPINE_ITEMREF", F.col("idref")),
        issue_rows(fine.join(_shuffled(items.where("media_type = 'application/x-dtbncx+xml' or array_contains(split(properties, ' '), 'nav')")), "book_id", "left_anti"), "NO_TOC", F.lit("")),
        issue_rows(fine.where("encrypted"), "DRM_DETECTED", F.lit("")),
    ]
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


def statuses(books: DataFrame, issues: DataFrame) -> DataFrame:
    """book_id and the worst status: INVALID for an error, DRM, ISSUES for a warning, else OK."""
    worst = issues.groupBy("book_id").agg(F.min(F.when(F.col("severity") == "error", 0).when(F.col("severity") == "locked", 1).otherwise(2)).alias("w"))
    return books.select("book_id").join(_shuffled(worst), "book_id", "left").select("book_id", F.element_at(F.array(*map(F.lit, STATUSES)), F.coalesce("w", F.lit(3)) + 1).alias("status"))


def report(books: DataFrame, issues: DataFrame) -> DataFrame:
    """Per book: issues, fixable ones, and whether there is a problem (a lock alone is none)."""
    sums = issues.groupBy("book_id").agg(F.count("*").alias("issues"), F.count_if("fixable").alias("fixable"), F.bool_or(F.col("severity") != "locked").alias("problem"))
    return books.select("book_id").join(sums, "book_id", "left").select("book_id", F.coalesce("issues", F.lit(0)).alias("issues"), F.coalesce("fixable", F.lit(0)).alias("fixable"), F.coalesce("problem", F.lit(False)).alias("problem"))


def orphans(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Archive files that no manifest names, but the package's own."""
    content = entries.where(~F.col("name").rlike(r"^(mimetype$|META-INF/)|/$|\.opf$"))
    return content.select("book_id", F.col("name").alias("path")).join(manifest.select("book_id", "path"), ["book_id", "path"], "left_anti")


def rebuilt_manifest(manifest: DataFrame) -> DataFrame:
    """One row of each id and each path: the contents list wins, then the first."""
    rank = F.when((F.col("media_type") == "application/x-dtbncx+xml") | F.array_contains(F.split("properties", " "), "nav"), 0).otherwise(1)
    for key in ("item_id", "path"):
        manifest = manifest.withColumn("_n", F.row_number().over(Window.partitionBy("book_id", key).orderBy(rank, "place"))).where("_n = 1").drop("_n")
    return manifest


def renamed_ids(manifest: DataFrame) -> DataFrame:
    """(book_id, item_id, new_id): a new id for each item but the first of those that share one: x-2, x-3 and so on, past the ids that the book has."""
    base, number = F.regexp_extract("item_id", r"^(.*)-(\d{1,9})$", 1), F.regexp_extract("item_id", r"^(.*)-(\d{1,9})$", 2)
    used = manifest.where(number != "").select("book_id", base.alias("item_id"), F.when(~number.startswith("0"), number.cast("int")).alias("u")).groupBy("book_id", "item_id").agg(F.collect_set("u").alias("used"))  # a book's own
    rows = repeated_ids(manifest).join(used, ["book_id", "item_id"], "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    free = F.filter(F.sequence(F.lit(2).cast("long"), F.col("n") + F.size("used") + 1), lambda k: ~F.array_contains("used", k.cast("int")))
    return rows.select("book_id", "item_id", F.explode(F.slice(free, F.lit(1), (F.col("n") - 1).cast("int"))).alias("k")).select("book_id", "item_id", F.concat("item_id", F.lit("-"), F.col("k").cast("string")).alias("new_id"))


def fixes(t: dict[str, DataFrame], issues: DataFrame, language: str = "en") -> DataFrame:
    """(book_id, code, before, after): what a fix changes. An after of null removes the thing."""
    of = lambda code: issues.where(F.col("code") == code)
    change = lambda df, before, after: df.select("book_id", "code", before.alias("before"), after.alias("after"))
    none = F.lit(None).cast("string")
    rows = change(of("PRIMARY_ID_MISSING"), F.lit(""), F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.substring(F.sha2(F.col("book_id").cast("string"), 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")))
    rows = rows.unionByName(change(of("LANGUAGE_MISSING"), F.lit(""), F.lit(language)))
    rows = rows.unionByName(change(of("AUTHORS_AMPERSAND"), F.col("detail"), F.regexp_replace("detail", " & ", "; ")))
    for code in ("DANGLING_REFINES", "DANGLING_SPINE_ITEMREF", "MANIFEST_FILE_MISSING"):
        rows = rows.unionByName(change(of(code), F.col("detail"), none))
    repeats = of("DUPLICATE_MANIFEST_ID").join(renamed_ids(t["manifest"]).select("book_id", F.col("item_id").alias("detail"), "new_id"), ["book_id", "detail"])
    rows = rows.unionByName(change(repeats, F.col("detail"), F.col("new_id")))
    return rows.unionByName(change(of("EPUB2_ATTRIBUTES_IN_EPUB3"), F.col("detail"), F.concat(F.lit("refines:"), "detail")))


#: A fingerprint has four lanes of 32 bits, each the sum of a lane of all entries' hashes: so entries may come in any order, and one
#: that goes or comes is taken from or added to the sums.
LANES, LANE = 4, 1 << 32
CANONICAL_MIMETYPE = b"application/epub+zip"


def entry_lanes(name: Column, crc: Column, size: Column) -> Column:
    """The lanes of an archive entry: parts of the SHA-256 of its name, CRC and size."""
    code = F.sha2(F.concat_ws("\n", text_of(name), crc.cast("string"), size.cast("string")), 256)
    return F.array(*[F.conv(F.substring(code, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(LANES)])


def _summed(rows: DataFrame) -> DataFrame:
    """book_id and the sums of ``lanes``, each times ``sign``, within 32 bits."""
    sums = rows.groupBy("book_id").agg(*[F.sum(F.col("sign") * F.get("lanes", F.lit(k))).alias(f"s{k}") for k in range(LANES)])
    return sums.select("book_id", F.array(*[F.pmod(f"s{k}", F.lit(LANE)) for k in range(LANES)]).alias("lanes"))


def _code(lanes: Column) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(F.get(lanes, F.lit(k))), 8, "0")) for k in range(LANES)])


def _counted(entries: DataFrame) -> DataFrame:
    """Entries that a fingerprint is about: files, but not the package document, which holds the stamp itself."""
    return entries.where(~F.col("name").rlike(r"(/|\.opf)$"))


def fingerprints(entries: DataFrame) -> DataFrame:
    """(book_id, lanes, fingerprint) of archives by their entries (book_id, name, crc, size): the same for the same files, whatever their
    order and compression. The package document is no part of it. An archive without entries has no row."""
    rows = _counted(entries).select("book_id", F.lit(1).alias("sign"), entry_lanes(F.col("name"), F.col("crc"), F.col("size")).alias("lanes"))
    return _summed(rows).withColumn("fingerprint", _code(F.col("lanes")))


def predicted_fingerprints(known: DataFrame, entries: DataFrame, edits: DataFrame) -> DataFrame:
    """(book_id, fingerprint) that archives will have once ``edits`` (book_id, name, data: bytes, null to remove; of each name one) are saved,
    worked out from the lanes they have and their list of entries, without reading an archive. known: fingerprints(entries). Saving
    also makes the mimetype canonical. Removing what isn't there, or replacing a file by the same bytes, changes nothing."""
    mime = known.select("book_id", F.lit("mimetype").alias("name"), F.lit(CANONICAL_MIMETYPE).alias("data"))
    staged = _counted(edits.select("book_id", "name", "data").where("name <> 'mimetype'").unionByName(mime))
    old = _counted(entries).join(staged.select("book_id", "name"), ["book_id", "name"], "left_semi").select("book_id", F.lit(-1).alias("sign"), entry_lanes(F.col("name"), F.col("crc"), F.col("size")).alias("lanes"))
    new = staged.where("data is not null").select("book_id", F.lit(1).alias("sign"), entry_lanes(F.col("name"), F.crc32("data"), F.octet_length("data")).alias("lanes"))
    rows = known.select("book_id", F.lit(1).alias("sign"), "lanes").unionByName(old).unionByName(new)
    return _summed(rows).select("book_id", _code(F.col("lanes")).alias("fingerprint"))


def stamp_state(books: DataFrame) -> DataFrame:
    """book_id, stale (null where there is no stamp) and a line of text. books: book_id, stamped_status, stamped_at, stamped_fingerprint, fingerprint."""
    known = (text_of(F.col("stamped_fingerprint")) != "") & (text_of(F.col("fingerprint")) != "")
    stale = F.when(known, F.col("stamped_fingerprint") != F.col("fingerprint"))
    note = F.when(stale, " (changed since)").when(stale.isNull(), " (unverified)").otherwise("")
    text = F.when(text_of(F.col("stamped_status")) == "", "never checked").otherwise(F.concat(F.col("stamped_status"), F.lit(" · "), text_of(F.col("stamped_at")), note))
    return books.select("book_id", stale.alias("stale"), text.alias("state"))


def reading_order(spine: DataFrame, manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """(book_id, ordinal, path): the documents of the spine that exist, each once, in order (of one place by path), without the contents list."""
    docs = manifest.where("media_type in ('application/xhtml+xml', 'text/html') and not array_contains(split(properties, ' '), 'nav')")
    rows = spine.join(docs.select("book_id", F.col("item_id").alias("idref"), "path"), ["book_id", "idref"]).where(~unsafe_path(F.col("path")))
    rows = rows.join(entries.select("book_id", F.col("name").alias("path")), ["book_id", "path"], "left_semi")
    rows = rows.groupBy("book_id", "path").agg(F.min("place").alias("place"))
    return rows.select("book_id", F.row_number().over(Window.partitionBy("book_id").orderBy("place", "path")).cast("long").alias("ordinal"), "path")


def cover_path(manifest: DataFrame, cover_meta: DataFrame) -> DataFrame:
    """(book_id, path): the item with the cover property, else the one that the cover meta names (book_id, item_id)."""
    by_property = manifest.where("array_contains(split(properties, ' '), 'cover-image')").select("book_id", "path", F.lit(0).alias("rank"), "place")
    by_meta = manifest.join(cover_meta, ["book_id", "item_id"]).select("book_id", "path", F.lit(1).alias("rank"), "place")
    return by_property.unionByName(by_meta).groupBy("book_id").agg(F.min_by("path", F.struct("rank", "place")).alias("path"))


#: Kinds of pictures by their first bytes (as hexadecimal), with the ending of a file of that kind.
PICTURES = (("FFD8FF", "image/jpeg", "jpg"), ("89504E470D0A1A0A", "image/png", "png"), ("47494638", "image/gif", "gif"))


def staged_covers(covers: DataFrame, manifest: DataFrame, cover_meta: DataFrame, entries: DataFrame, packages: DataFrame) -> DataFrame:
    """(book_id, path, data, media_type, item_id, how): what is to be staged so that a book has a new cover. covers: book_id, data; packages: book_id, opf_path.

    how: ``replace``, the file of the present cover if the new one is of the same kind; else ``add``, a file cover.jpg (or by its kind) beside the package
    document, cover-2.jpg and so on where that is taken, with an id that no item has; ``refuse`` (no path) for what is no picture."""
    code = F.hex(F.substring("data", 1, 8))
    kind, ending = F.lit(""), F.lit("")
    for head, media_type, end in PICTURES:
        kind, ending = F.when(code.startswith(head), media_type).otherwise(kind), F.when(code.startswith(head), end).otherwise(ending)
    now = cover_path(manifest, cover_meta).join(manifest.select("book_id", "path", "item_id", F.lower("media_type").alias("now_type")), ["book_id", "path"]).dropDuplicates(["book_id"])
    rows = covers.select("book_id", "data", kind.alias("media_type"), ending.alias("ending")).join(now.withColumnRenamed("path", "now_path"), "book_id", "left").join(packages.select("book_id", "opf_path"), "book_id", "left")
    same = (F.col("media_type") != "") & (F.col("now_type") == F.col("media_type"))
    how = F.when(F.col("media_type") == "", "refuse").when(F.coalesce(same, F.lit(False)), "replace").otherwise("add")
    # names and ids that are taken: those that look like cover, cover-2, ...
    folder = F.regexp_extract(text_of(F.col("opf_path")), "^(.*/)[^/]*$", 1)
    names = entries.select("book_id", F.lower("name").alias("t")).unionByName(manifest.select("book_id", F.concat(F.lit("#"), F.lower("item_id")).alias("t"))).where(F.col("t").rlike(r"(^|[/#])cover(-[0-9]+)?(\.[a-z]+)?$"))
    taken = names.groupBy("book_id").agg(F.collect_set("t").alias("taken"))  # a book's own covers
    rows = rows.join(taken, "book_id", "left").withColumns({"how": how, "folder": folder, "taken": F.coalesce("taken", F.array().cast("array<string>"))})
    nth = lambda k: F.when(k == 1, "").otherwise(F.concat(F.lit("-"), k.cast("string")))
    free = lambda k: ~F.array_contains("taken", F.lower(F.concat("folder", F.lit("cover"), nth(k), F.lit("."), "ending"))) & ~F.array_contains("taken", F.concat(F.lit("#cover"), nth(k)))
    number = nth(F.get(F.filter(F.sequence(F.lit(1), F.size("taken") + 1), free), F.lit(0)))
    added = F.col("how") == "add"
    path = F.when(F.col("how") == "replace", F.col("now_path")).when(added, F.concat("folder", F.lit("cover"), number, F.lit("."), "ending"))
    item = F.when(F.col("how") == "replace", F.col("item_id")).when(added, F.concat(F.lit("cover"), number))
    return rows.select("book_id", path.alias("path"), "data", "media_type", item.alias("item_id"), "how")
