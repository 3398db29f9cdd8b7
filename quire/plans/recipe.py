"""A recipe is a list of steps. A step is a function from books to suggestions; the recipe decides which are applied."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.patterns import parse
from quire.functions.text import fix_missing_spaces, let, strip_html, text_of
from quire.operators.languages import language_of

THRESHOLD = 0.9
#: A step's rows: which book and field, the value, how sure, and why.
COLUMNS = ("book_id", "field", "value", "confidence", "step")


@dataclass
class Step:
    """Either find: books to rows of (book_id, field, value, confidence), or suggest: books to a column of their own rows, an array of
    struct(field, value, confidence), null where there is nothing to suggest. field: the one field it writes, if it says so."""

    name: str
    find: Callable[[DataFrame], DataFrame] | None = None
    enabled: bool = True
    fills_only: bool = True
    options: dict = dataclasses.field(default_factory=dict)
    suggest: Callable[[DataFrame], Column] | None = None
    field: str | None = None
    #: For options that may be left empty: what they are then, asked anew in each run.
    fallbacks: dict[str, Callable[[], str]] = dataclasses.field(default_factory=dict)
    #: As suggest, for a step whose suggestion depends on its options.
    from_options: Callable[[Step, DataFrame], Column] | None = None

    def option(self, name: str) -> tuple[str, str]:
        """(value, where it is from: recipe, fallback or nothing) of an option as this run has it."""
        own = str(self.options.get(name) or "").strip()
        if own:
            return own, "recipe"
        found = self.fallbacks[name]().strip() if name in self.fallbacks else ""
        return found, "fallback" if found else "nothing"


@dataclass
class Recipe:
    steps: list[Step]
    threshold: float = THRESHOLD

    def to_json(self) -> str:
        return json.dumps({"threshold": self.threshold, "steps": [{"name": s.name, "enabled": s.enabled, "options": s.options} for s in self.steps]})

    @classmethod
    def from_json(cls, text: str, known: dict[str, Step]) -> Recipe:
        data = json.loads(text)
        steps = [dataclasses.replace(known[s["name"]], enabled=s.get("enabled", True), options=s.get("options", {})) for s in data["steps"] if s["name"] in known]
        return cls(steps, data.get("threshold", THRESHOLD))

    def pinned(self) -> Recipe:
        """The recipe with what its empty options stand for now written into them, so that later changes of the fallbacks leave it as it is."""
        now = lambda s: s.options | {name: value for name in s.fallbacks if (value := s.option(name)[0])}
        return Recipe([dataclasses.replace(s, options=now(s)) for s in self.steps], self.threshold)

    def results(self, books: DataFrame) -> DataFrame:
        """All steps' rows with an outcome: applied, review (below the threshold), skipped (the field has a value already, an earlier
        step was applied to it, or the book is not to be touched). books: book_id, the fields, and locked.

        A step adds to each book a suggestion (value, confidence) for one field; all steps' suggestions are worked out in one reading of
        the books, and the steps of a book's field are weighed against each other within the book's own row."""
        steps = [(i, s) for i, s in enumerate(self.steps) if s.enabled]
        columns, joined = [], books
        for i, s in steps:
            if s.from_options is not None:
                columns.append((i, s, s.from_options(s, books)))
            elif s.suggest is not None:
                columns.append((i, s, s.suggest(books)))
            else:  # a step that needs more than the book's own row
                found = s.find(books).select("book_id", F.struct("field", "value", "confidence").alias("x"))
                joined = joined.join(found.groupBy("book_id").agg(F.collect_list("x").alias(f"_found_{i}")), "book_id", "left")
                columns.append((i, s, F.col(f"_found_{i}")))
        now = F.create_map(*[x for c in books.columns if c not in ("book_id", "locked") and c in self._written(columns, books) for x in (F.lit(c), text_of(F.col(c)))])
        shape = "array<struct<field:string,value:string,confidence:double>>"

        def marked(i: int, s: Step, found: Column) -> Column:
            parts = lambda x: (x["field"].alias("field"), x["value"].alias("value"), x["confidence"].cast("double").alias("confidence"))
            return F.transform(F.coalesce(found, F.array().cast(shape)), lambda x: F.struct(*parts(x), F.lit(s.name).alias("step"), F.lit(i).alias("place"), F.lit(s.fills_only).alias("fills_only")))

        lists = [marked(i, s, c) for i, s, c in columns]
        rows = joined.select("book_id", "locked", now.alias("fields"), F.explode(F.concat(*lists)).alias("r")).select("book_id", "locked", "r.*", F.try_element_at("fields", F.col("r.field")).alias("now")).where("now is not null")
        if len(steps) > 1:
            open_ = ~F.col("locked") & (~F.col("fills_only") | (F.col("now") == "")) & (F.col("value") != F.col("now")) & (F.col("confidence") >= self.threshold)
            short = rows.groupBy("book_id", "field").agg(F.min(F.when(open_, F.col("place"))).alias("first")) if self._contested(columns) else None
            rows = rows.join(short, ["book_id", "field"], "left") if short is not None else rows.withColumn("first", F.lit(None).cast("int"))
        else:
            rows = rows.withColumn("first", F.lit(None).cast("int"))
        skipped = F.col("locked") | (F.col("fills_only") & (F.col("now") != "")) | (F.col("value") == F.col("now")) | F.coalesce(F.col("first") < F.col("place"), F.lit(False))
        outcome = F.when(skipped, "skipped").when(F.col("confidence") >= self.threshold, "applied").otherwise("review")
        return rows.select(*COLUMNS, "now", outcome.alias("outcome"))

    @staticmethod
    def _written(columns: list, books: DataFrame) -> set[str]:
        """The fields that the steps may write: all, if a step doesn't say which."""
        named = [s.field for _, s, _ in columns]
        return set(books.columns) if None in named else set(named)

    @staticmethod
    def _contested(columns: list) -> bool:
        """Whether two steps may write one field."""
        named = [s.field for _, s, _ in columns]
        return None in named or len(set(named)) < len(named)

    def apply(self, books: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(books with the applied values, the changes as book_id, field, old, new, step)."""
        changes = self.results(books).where("outcome = 'applied'").select("book_id", "field", F.col("now").alias("old"), F.col("value").alias("new"), "step")
        values = changes.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "new"))).alias("v"))  # at most one per field
        names = [c for c in books.columns if c not in ("book_id", "locked")]
        out = books.join(values, "book_id", "left").select("book_id", *[F.coalesce(F.try_element_at("v", F.lit(c)), F.col(c)).alias(c) for c in names], "locked")
        return out, changes


def language_step(text_col: str = "description") -> Step:
    def suggest(books: DataFrame) -> Column:
        guess = language_of(F.col(text_col))
        return let(guess, lambda g: F.when(g["lang_code"] != "", F.array(F.struct(F.lit("language").alias("field"), g["lang_code"].alias("value"), g["confidence"].alias("confidence")))))

    return Step("language", suggest=suggest, field="language")


def text_step(name: str, field_name: str, change) -> Step:
    """A step that rewrites a field by a column function, where that changes it."""

    def suggest(books: DataFrame) -> Column:
        old = text_of(F.col(field_name))
        return let(change(old), lambda new: F.when(new != old, F.array(F.struct(F.lit(field_name).alias("field"), new.alias("value"), F.lit(1.0).alias("confidence")))))

    return Step(name, suggest=suggest, field=field_name, fills_only=False)


def parse_step(name: str, source_col: str, field_name: str, fallback: Callable[[], str], confidence: float = 1.0) -> Step:
    """A step that fills a field with what its option ``pattern`` finds in a column, or where that is empty, with what the fallback's pattern finds.
    Without either it suggests nothing."""

    def suggest(step: Step, books: DataFrame) -> Column:
        pattern, _ = step.option("pattern")
        if not pattern:
            return F.lit(None).cast("array<struct<field:string,value:string,confidence:double>>")
        found = parse(pattern, F.col(source_col))[field_name]
        return let(found, lambda v: F.when(F.coalesce(v, F.lit("")) != "", F.array(F.struct(F.lit(field_name).alias("field"), v.alias("value"), F.lit(confidence).alias("confidence")))))

    return Step(name, from_options=suggest, field=field_name, fallbacks={"pattern": fallback})


def default_steps() -> dict[str, Step]:
    steps = [text_step("strip_description_html", "description", strip_html), text_step("missing_space_title", "title", fix_missing_spaces), language_step()]
    return {s.name: s for s in steps}
