"""Building the look-up catalogues from their dumps, and asking them: dump to tables to a version on disk to look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import text_of
from quire.operators import catalog
from quire.sources import dumps
from quire.sources.catalogue import Catalogue, open_catalogue, write_catalogue

#: Recipes, with the number that rises when the tables change.
EDITIONS, WORKS = "editions/2", "works/2"
LEAST_ROWS_B = 100_000


def edition_tables(found: dict[str, DataFrame]) -> dict[str, tuple[DataFrame, str]]:
    """The tables of catalogue A with the columns they are found by: numbers lead to editions by one more table, so that either form of
    a number and an edition's further numbers are found by one range of files."""
    editions = found["editions"]
    numbers = editions.select(F.explode(F.array_distinct(F.array("isbn13", "isbn10"))).alias("number"), "id").where("number <> ''").unionByName(found["extra_isbns"].select(F.col("isbn13").alias("number"), F.col("edition_id").alias("id")))
    return {"editions": (editions, "id"), "numbers": (numbers.distinct(), "number"), "extra_isbns": (found["extra_isbns"], "isbn13"), "authors": (found["authors"], "author_key"), "words": (catalog.token_table(editions, "id", "title"), "token")}


def build_a(spark: SparkSession, dump: str, root: str, languages: list[str], keep_unknown: bool = True) -> Catalogue:
    """Catalogue A from a dump's files (editions, authors and works in one folder or file). Raises if too many lines are no JSON, or no edition is kept."""
    rows = dumps.split_dump_a(spark, dump)
    dumps.refuse_bad_dump(rows["edition"])
    found = catalog.catalogue_a(dumps.editions_a(rows["edition"]), dumps.works_a(rows["work"]), dumps.authors_a(rows["author"]), languages, keep_unknown)
    why = {r.why: r.rows for r in found["summary"].collect()}  # three reasons at most
    info = {"date": dumps.dump_date(F.lit(dump)), "languages": ", ".join(languages) or "all languages"} | {f"left_out.{k}": str(n) for k, n in why.items() if k != "kept"}
    info["date"] = spark.range(1).select(info["date"].alias("d")).first().d
    return write_catalogue(spark, root, EDITIONS, dump.rstrip("/").rsplit("/", 1)[-1], edition_tables(found), info, {"editions": 1})


def build_b(spark: SparkSession, dump: str, root: str, least: int = LEAST_ROWS_B) -> Catalogue:
    """Catalogue B from a MySQL dump. Raises if a table is missing, odd or small (publications and titles: ``least`` rows)."""
    tables = dumps.read_dump_b(spark, dump)
    dumps.refuse_small_dump(tables, least)
    found = catalog.catalogue_b(tables)
    numbers = found["editions"].select(F.explode(F.array_distinct(F.array("isbn13", "isbn10"))).alias("number"), "id").where("number <> ''")
    day = spark.range(1).select(dumps.dump_date(F.lit(dump)).alias("d")).first().d
    wanted = {"works": (found["works"], "id"), "editions": (found["editions"], "id"), "numbers": (numbers, "number"), "words": (catalog.token_table(found["works"], "id", "title"), "token")}
    return write_catalogue(spark, root, WORKS, dump.rstrip("/").rsplit("/", 1)[-1], wanted, {"date": day}, {"editions": 1})


def by_number(probes: DataFrame, catalogue: Catalogue, most: int = catalog.MOST_BY_ISBN) -> DataFrame:
    """probe_id, id and place of the editions with a probe's number (probes: probe_id, isbn), as catalog.lookup_by_isbn gives them.
    Numbers are met in the table that is sorted by them."""
    asked = catalog.asked_numbers(probes)
    numbers = catalog.asked_once(asked).select("probe_id", F.explode(F.array_distinct(F.array("isbn13", "isbn10"))).alias("number")).where("number <> ''")
    hits = numbers.join(catalogue["numbers"], "number").select("probe_id", "id").distinct()
    return catalog.ranked_editions(asked, hits, catalogue["editions"], most)


def by_title(probes: DataFrame, catalogue: Catalogue, most: int = catalog.MOST_BY_TITLE) -> DataFrame:
    """probe_id, id, attempt, score and place of the best works or editions for a title (see catalog.lookup_by_title)."""
    if catalogue.info["recipe"] == WORKS:
        works = catalogue["works"].withColumn("known", (text_of(F.col("series")) != "").cast("int"))
    else:
        works = catalogue["editions"].withColumn("known", F.least(catalog.completeness() / 8, F.lit(1.0)))
    return catalog.lookup_by_title(probes, works, most)


def opened_a(spark: SparkSession, root: str | None) -> Catalogue:
    return open_catalogue(spark, root, EDITIONS)


def opened_b(spark: SparkSession, root: str | None) -> Catalogue:
    return open_catalogue(spark, root, WORKS)
