"""Runs of a recipe under a write-ahead journal: what is to change is written down before anything changes, and a run that was cut off is
told apart from a finished one and brought to its end without changing anything twice.

    <root>/run-<id>/begin/    the changes: book_id, field, old, new, step
    <root>/run-<id>/finish/   what became of each: book_id, field, outcome

Either part counts when Spark's mark of success is in its folder. A run with a begin and no finish is open."""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import text_of
from quire.plans.recipe import Recipe
from quire.shared import Scratch
from quire.sources.catalogue import Catalogue, Files, open_catalogue, write_catalogue

CHANGES = "book_id string, field string, old string, new string, step string"
OUTCOMES = "book_id string, field string, outcome string"
#: What can become of a change: it is made now, it had been made already, or the field holds something else by now and is left alone.
APPLIED, DONE, CONFLICT = "applied", "done before", "conflict"


class Store(Protocol):
    """Where the books' fields are kept. Applying the same changes again must be harmless."""

    def values(self, wanted: DataFrame) -> DataFrame:
        """(book_id, field, value) of the wanted (book_id, field)."""

    def apply(self, changes: DataFrame) -> None:
        """Set fields: book_id, field, new."""


class RunJournal:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def _path(self, run: str, part: str) -> str:
        return f"{self.files.root}/run-{run}/{part}"

    def _has(self, run: str, part: str) -> bool:
        return self.files.system.exists(self.files.at(f"run-{run}/{part}/_SUCCESS"))

    def begin(self, run: str, changes: DataFrame) -> DataFrame:
        """Write down what the run is to change. A run that has begun keeps what it wrote down then."""
        if not self._has(run, "begin"):
            changes.select(*[F.col(c.split(" ")[0]).cast("string") for c in CHANGES.split(", ")]).write.mode("overwrite").parquet(self._path(run, "begin"))
        return self.changes(run)

    def finish(self, run: str, outcomes: DataFrame) -> DataFrame:
        outcomes.select("book_id", "field", "outcome").write.mode("overwrite").parquet(self._path(run, "finish"))
        return self.outcomes(run)

    def changes(self, run: str) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(self._path(run, "begin"))

    def outcomes(self, run: str) -> DataFrame:
        return self.spark.read.schema(OUTCOMES).parquet(self._path(run, "finish"))

    def runs(self) -> dict[str, str]:
        """The state of every run by its id: begun and not finished is ``open``. A run that died while it wrote down its begin has changed
        nothing and is ``void``."""
        found = [s.getPath().getName().removeprefix("run-") for s in self.files.system.listStatus(self.files.path(self.files.root)) if s.getPath().getName().startswith("run-")] if self.files.system.exists(self.files.path(self.files.root)) else []
        return {run: "finished" if self._has(run, "finish") else "open" if self._has(run, "begin") else "void" for run in sorted(found)}


def carry_out(journal: RunJournal, run: str, store: Store) -> DataFrame:
    """Make the changes of a run that has begun, and finish it: (book_id, field, outcome). A field that still holds what it held is set; one
    that holds the new text was set before; one that holds anything else was changed by something else meanwhile and stays so.
    What is to be done is decided from the store as it is now, so a run may be carried out again wherever it was cut off."""
    changes, scratch = journal.changes(run), Scratch(journal.spark, "run")
    now = store.values(changes.select("book_id", "field")).select(F.col("book_id").cast("string").alias("book_id"), "field", text_of(F.col("value")).alias("value"))
    held = changes.join(now, ["book_id", "field"], "left")
    outcome = F.when(F.col("value") == F.col("new"), DONE).when(F.col("value") == F.col("old"), APPLIED).otherwise(CONFLICT)
    judged = scratch.write(held.withColumn("outcome", outcome), "judged")
    store.apply(judged.where(F.col("outcome") == APPLIED).select("book_id", "field", "new"))
    return journal.finish(run, judged)


def run_recipe(recipe: Recipe, books: DataFrame, journal: RunJournal, store: Store, run: str | None = None) -> tuple[str, DataFrame]:
    """(run id, outcomes) of a recipe over ``books`` (book_id, fields, locked). The books are read once into the shared folder, and all
    steps see that reading."""
    run = run or uuid.uuid4().hex
    seen = Scratch(journal.spark, "scan").write(books, "books")
    journal.begin(run, recipe.apply(seen)[1])
    return run, carry_out(journal, run, store)


def resume(journal: RunJournal, store: Store) -> dict[str, DataFrame]:
    """Bring all open runs to their end: their outcomes by id. Finished and void runs are left alone."""
    return {run: carry_out(journal, run, store) for run, state in journal.runs().items() if state == "open"}


class TableStore:
    """Books in a table that is kept in versions: changes are one new version, so they are all made or none."""

    RECIPE = "books/1"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def put(self, books: DataFrame) -> Catalogue:
        return write_catalogue(self.spark, self.root, self.RECIPE, "books", {"books": (books, "book_id")})

    def books(self) -> DataFrame:
        return open_catalogue(self.spark, self.root, self.RECIPE)["books"]

    def values(self, wanted: DataFrame) -> DataFrame:
        books = self.books()
        fields = [c for c in books.columns if c != "book_id"]
        rows = books.select(F.col("book_id").cast("string").alias("book_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text_of(F.col(f)).alias("value")) for f in fields])).alias("x")).select("book_id", "x.*")
        return rows.join(wanted, ["book_id", "field"], "left_semi")

    def apply(self, changes: DataFrame) -> None:
        if changes.isEmpty():
            return
        books = self.books()
        new = changes.groupBy(F.col("book_id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("field", "new"))).alias("_new"))  # a book's fields
        fields = [c for c in books.columns if c != "book_id"]
        joined = books.join(new, F.col("book_id").cast("string") == F.col("_id"), "left")
        self.put(joined.select("book_id", *[F.coalesce(F.try_element_at("_new", F.lit(f)), F.col(f)).alias(f) for f in fields]))
