"""Look-up catalogues on disk: versions of tables, written whole and then switched to by one small file.

A catalogue is a folder of any store that Spark writes to:

    <root>/version-<id>/<table>/...   Parquet files, each with a range of the table's key, sorted
    <root>/version-<id>/info/...      (key, value): source, recipe, files, rows of each table, a line of description
    <root>/CURRENT                    the name of the version that look-ups read

A build writes a version folder of its own and reads nothing that is switched to, so a build that fails, wherever it does, leaves the
catalogue as it was. Readers that opened a version go on reading it until it is dropped."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of a file of a sorted table, about.
FILE_ROWS = 2_000_000
POINTER = "CURRENT"


class CatalogueError(ValueError):
    """The catalogue can't be asked or built; the message says why in one line."""


class Files:
    """The store of a path, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.system = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.conf = spark._jsc.hadoopConfiguration()

    def at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def read(self, name: str) -> str | None:
        if not self.system.exists(self.at(name)):
            return None
        stream = self.system.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """The file has the new text or the old one, whenever this ends."""
        part = self.at(f".{name}-{uuid.uuid4().hex}")
        stream = self.system.create(part, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = SparkContext._gateway.new_array(rename, 1)
        overwrite[0] = rename.OVERWRITE
        whole = self.system.makeQualified
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf).rename(whole(part), whole(self.at(name)), overwrite)

    def versions(self) -> list[str]:
        if not self.system.exists(self.path(self.root)):
            return []
        found = [(s.getModificationTime(), s.getPath().getName()) for s in self.system.listStatus(self.path(self.root)) if s.isDirectory()]
        return [name for _, name in sorted(found) if name.startswith("version-")]

    def delete(self, name: str) -> None:
        self.system.delete(self.at(name), True)


@dataclass
class Catalogue:
    """One version of a catalogue, as opened. tables: name to rows."""

    version: str
    info: dict[str, str]
    tables: dict[str, DataFrame]

    def describe(self) -> str:
        return self.info.get("description", "")

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def described(source: str, info: dict[str, str], rows: dict[str, int]) -> str:
    """One line: what it was built from, when, and how much there is."""
    date = f" ({info['date']})" if info.get("date") else ""
    counts = ", ".join(f"{n:,} {table}" for table, n in rows.items() if n)
    more = f"; {info['languages']}" if info.get("languages") else ""
    return f"Built from {source}{date} on {info['built'][:10]}: {counts}{more}"


def write_catalogue(spark: SparkSession, root: str, recipe: str, source: str, tables: dict[str, tuple[DataFrame, str]], info: dict[str, str] | None = None, least: dict[str, int] | None = None) -> Catalogue:
    """Write a new version and switch to it. tables: name to rows and the column they are found by; least: rows that a table must have.

    Each table is dealt into ranges of its column and sorted within them, so a look-up by it reads the files and row groups that may
    hold it (by their least and greatest values) and no others; an equal value is never in two files' middles. Rows are counted
    as they are written and again when all is there; a count that differs, or is below ``least``, raises and nothing is
    switched. recipe: a name and a number (``editions/1``); look-ups refuse another recipe's version."""
    if not re.fullmatch(r"[\w-]+/\d+", recipe):
        raise CatalogueError(f"a recipe is a name and a number, not {recipe!r}")
    files = Files(spark, root)
    version = f"version-{uuid.uuid4().hex}"
    try:
        rows: dict[str, int] = {}
        for name, (table, column) in tables.items():
            seen = Observation()
            table.repartitionByRange(column).sortWithinPartitions(column).observe(seen, F.count("*").alias("n")).write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{files.root}/{version}/{name}")
            there = spark.read.parquet(f"{files.root}/{version}/{name}").count()
            if there != (seen.get["n"] or 0):
                raise CatalogueError(f"{name} has {there} rows, but {seen.get['n']} were written")
            if there < (least or {}).get(name, 0):
                raise CatalogueError(f"{name} has only {there} rows; is the dump whole?")
            rows[name] = there
        about = {"built": spark.sql("select date_format(now(), \"yyyy-MM-dd'T'HH:mm:ss\") t").first().t} | (info or {})
        about |= {"source": source, "recipe": recipe, **{f"rows.{t}": str(n) for t, n in rows.items()}, "tables": json.dumps({t: c for t, (_, c) in tables.items()})}
        about["description"] = described(source, about, rows)
        spark.createDataFrame(sorted(about.items()), "key string, value string").coalesce(1).write.parquet(f"{files.root}/{version}/info")
        files.replace(POINTER, version)
    except BaseException:
        files.delete(version)
        raise
    return open_catalogue(spark, root, recipe)


def open_catalogue(spark: SparkSession, root: str | None, recipe: str) -> Catalogue:
    """The version that is switched to. Raises in one line if there is none, if it is of another recipe or number, or lacks a table."""
    if not root:
        raise CatalogueError("no catalogue is set up")
    files = Files(spark, root)
    version = files.read(POINTER)
    if version is None:
        raise CatalogueError(f"there is no catalogue at {root}")
    try:
        info = {r.key: r.value for r in spark.read.parquet(f"{files.root}/{version}/info").collect()}  # some twenty rows
    except AnalysisException:
        raise CatalogueError(f"the catalogue at {root} is damaged; build it again") from None
    found = info.get("recipe", "")
    if found.split("/")[0] != recipe.split("/")[0]:
        raise CatalogueError(f"the catalogue at {root} was built by the recipe {found or 'of something else'}, not by {recipe}")
    if found != recipe:
        raise CatalogueError(f"the catalogue at {root} was built by {found}, this needs {recipe}; build it again")
    try:
        return Catalogue(version, info, {t: spark.read.parquet(f"{files.root}/{version}/{t}") for t in json.loads(info["tables"])})
    except (AnalysisException, KeyError):
        raise CatalogueError(f"the catalogue at {root} lacks a table; build it again") from None


def not_ready(spark: SparkSession, root: str | None, recipe: str) -> str:
    """Why the catalogue can't be asked, or an empty text."""
    try:
        open_catalogue(spark, root, recipe)
    except CatalogueError as e:
        return str(e)
    return ""


def drop_old_versions(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete all versions but the current one and the ``keep`` - 1 youngest others; their names. What a failed build left goes too."""
    files = Files(spark, root)
    current = files.read(POINTER)
    others = [v for v in files.versions() if v != current]
    gone = others[: len(others) - (keep - 1)] if keep > 1 else others
    for version in gone:
        files.delete(version)
    return gone
