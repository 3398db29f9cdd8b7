"""Edits and their journal: differences, undo, restore, renames, plans for files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import collapse, text_of
from quire.shared import Scratch

# Limits of the journal and of undo.
MOST_CHARS, UNDO_DEPTH = 20_000, 50


def differences(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new) for each field whose collapsed text differs; rows that only one side has are compared with blanks."""
    o = old.select(key, *[collapse(F.col(f)).alias(f"o_{f}") for f in fields])
    n = new.select(key, *[collapse(F.col(f)).alias(f"n_{f}") for f in fields])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f"o_{f}", F.lit("")).alias("old"), F.coalesce(f"n_{f}", F.lit("")).alias("new")) for f in fields])
    each = o.join(n, key, "full").select(key, F.explode(rows).alias("r")).where("r.old <> r.new")
    return each.select(key, "r.field", F.substring("r.old", 1, MOST_CHARS).alias("old"), F.substring("r.new", 1, MOST_CHARS).alias("new"))


def bulk_edit(books: DataFrame, values: dict[str, str], key: str) -> tuple[DataFrame, DataFrame]:
    """(books with the ticked fields set, the journal of what that changed)."""
    edited = books.withColumns({f: F.lit(v) for f, v in values.items()})
    return edited, differences(books, edited, key, list(values))


def restore(changes: DataFrame, key: str, moment: str, at) -> DataFrame:
    """(key, field, value): what fields held at a moment: the new text of the last change until then, else the old text of the first
    one after it. changes: key, field, old, new, and the column ``moment``."""
    before = F.col(moment) <= F.lit(at)
    rows = changes.groupBy(key, "field").agg(
        F.max_by(F.when(before, F.col("new")), F.when(before, F.col(moment))).alias("last_new"), F.min_by(F.when(~before, F.col("old")), F.when(~before, F.col(moment))).alias("first_old"), F.count_if(before).alias("n")
    )
    return rows.select(key, "field", F.when(F.col("n") > 0, F.col("last_new")).otherwise(F.col("first_old")).alias("value"))


def undo_stack(actions: DataFrame, key: str, order: str, depth: int = UNDO_DEPTH) -> DataFrame:
    """(key, order, steps_back): the edits that undo can still reach, newest first; at most ``depth``."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return actions.withColumn("steps_back", back.cast("long")).where(F.col("steps_back") <= depth)


def follow_renames(moves: DataFrame) -> DataFrame:
    """(first_path, last_path) at the ends of each chain of moves (old_path, new_path), of any length. Each round doubles the length of
    the chains that are joined and is written to the shared folder; rounds end when no link changes. Moves in a cycle have no
    last path: a ValueError."""
    scratch, turn = Scratch(moves.sparkSession, "renames"), 0
    moves = scratch.write(moves.select("old_path", "new_path"), "moves")
    links, most = moves.select(F.col("old_path").alias("a"), F.col("new_path").alias("b")), moves.count()
    while True:
        further, seen = links.select(F.col("a").alias("b"), F.col("b").alias("c")), Observation()  # counted while it is written
        joined = links.join(further, "b", "left").observe(seen, F.count("c").alias("n"))
        links = scratch.write(joined.select("a", F.coalesce("c", "b").alias("b")), f"links-{turn}")
        if turn:
            scratch.drop(f"links-{turn - 1}")
        if not seen.get["n"]:
            break
        turn += 1
        if 1 << turn > 2 * most:  # longer than all moves in a row
            raise ValueError("the moves go round in a cycle")
    return links.join(moves.select(F.col("new_path").alias("a")), "a", "left_anti").select(F.col("a").alias("first_path"), F.col("b").alias("last_path"))


def series_numbers(books: DataFrame, series: str, *order: str, first: float = 1, step: float = 1) -> DataFrame:
    """The books with series_index: first, first + step, ... in each series by the order given."""
    n = F.row_number().over(Window.partitionBy(series).orderBy(*order))
    return books.withColumn("series_index", F.lit(first) + F.lit(step) * (n - 1))


def review(old: Column, new: Column) -> Column:
    """What a look-up's value does to a field: fill a blank (ticked), overwrite (unticked), or nothing."""
    o, n = collapse(old), collapse(new)
    return F.when((n == "") | (o == n), "same").when(o == "", "fill").otherwise("overwrite")


def rank_within(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """The rows with ``name``: 0, 1, ... within each key by the order. Ranges of (key, order) are written to the shared folder and counted; each is then
    numbered on its own, shifted by what the ranges before it have of the key, so a key with a third of all rows is numbered in
    as many tasks as hold it."""
    scratch, at = Scratch(rows.sparkSession, "ranks"), (F.col("_k").asc_nulls_last(), F.col("_o").asc_nulls_last())
    ranged = rows.select(F.struct("*").alias("row"), F.col(key).alias("_k"), F.col(order).alias("_o")).repartitionByRange(*at).withColumn("_b", F.spark_partition_id())
    ranged = scratch.write(ranged, "ranges")
    counts = ranged.groupBy("_k", "_b").agg(F.count("*").alias("n"))
    before = counts.select("_k", "_b", (F.sum("n").over(Window.partitionBy("_k").orderBy("_b")) - F.col("n")).alias("before")).where("before > 0")  # a key that lies in one range needs none
    within = F.row_number().over(Window.partitionBy("_b", "_k").orderBy(at[1])) - 1
    numbered = ranged.withColumn("_n", within).join(before, ["_k", "_b"], "left")
    return numbered.select("row.*", (F.col("_n") + F.coalesce("before", F.lit(0))).alias(name))


def number_collisions(plan: DataFrame, target: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """The plan with ``name``: the target, or "target (2)", "target (3)" where an earlier row or ``taken`` (targets that exist already, column
    of the same name) has it. Numbers that would give another row's target or a taken name are passed over; capitals make no
    difference.

    The r-th free number from 2 on is 1 + r and as many more as there are numbers in use that have fewer than r free ones below
    them; so only the numbers in use of a target are gathered, never those that are given out."""
    base, number = F.regexp_extract("_t", r"^(.*) \((\d{1,9})\)$", 1), F.regexp_extract("_t", r"^(.*) \((\d{1,9})\)$", 2)
    names = plan.select(F.lower(target).alias("_t"))
    exist = taken.select(F.lower(target).alias("_t")).distinct().withColumn("_e", F.lit(1)) if taken is not None else names.limit(0).withColumn("_e", F.lit(1))
    used = names.unionByName(exist.select("_t")).distinct().where(number != "").select(base.alias("_t"), number.cast("int").alias("_u")).where("_u >= 2")
    below = F.transform(F.sort_array(F.collect_set("_u")), lambda u, i: u - 2 - i)  # free numbers below each one in use
    facts = exist.join(used.groupBy("_t").agg(below.alias("_below")), "_t", "full")
    rows = rank_within(plan.withColumn("_t", F.lower(target)), "_t", order, "_n").join(facts, "_t", "left")
    r = F.col("_n") + F.when(F.col("_e").isNull(), 0).otherwise(1)
    passed = F.size(F.filter(F.coalesce("_below", F.array().cast("array<int>")), lambda free: free < r))
    numbered = F.concat(F.col(target), F.lit(" ("), (1 + r + passed).cast("string"), F.lit(")"))
    return rows.withColumn("name", F.when(r == 0, F.col(target)).otherwise(numbered)).select(*plan.columns, "name")


def file_plan(files: DataFrame, target: Column, order: str) -> DataFrame:
    """(path, new_path, action): keep, move, or blocked (an empty name). files: path, stem, extension, folder. Nothing is moved."""
    plan = number_collisions(files.withColumn("target", F.concat("folder", F.lit("/"), target)), "target", order)
    new = F.concat("name", F.lit("."), "extension")
    action = F.when(F.trim(target) == "", "blocked").when(new == F.col("path"), "keep").otherwise("move")
    return plan.select("path", F.when(F.trim(target) == "", F.col("path")).otherwise(new).alias("new_path"), action.alias("action"))


def conversion_plan(files: DataFrame, known: list[str], existing: DataFrame, policy: str, now: Column, recent_minutes: int = 10) -> DataFrame:
    """(path, output, action): convert, or skip with the reason. Only the first of several sources of one output is converted.
    files: path, extension, modified; existing: output."""
    rows = files.withColumn("output", F.concat(F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".epub")))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("output").orderBy("path")))
    rows = rows.join(existing.select("output", F.lit(True).alias("there")), "output", "left")
    recent = F.col("modified") > now - F.make_dt_interval(mins=F.lit(recent_minutes))
    action = F.when(~F.lower("extension").isin(*known), "skip: format").when(F.col("there"), "skip: exists").when(F.col("nth") > 1, "skip: claimed").when(recent, "skip: recent").otherwise(f"convert, then {policy}")
    return rows.select("path", "output", action.alias("action"))


def add_only_tags(have: Column, more: Column) -> Column:
    """Tags in their order, then new ones; capitals make no difference."""
    every = F.concat(F.coalesce(have, F.array().cast("array<string>")), F.coalesce(more, F.array().cast("array<string>")))
    every = F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(every, lambda x, i: F.array_position(F.transform(every, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def vocabulary(defaults: DataFrame, hidden: DataFrame, custom: DataFrame, col: str) -> DataFrame:
    """Defaults without the hidden ones, and the custom ones."""
    return defaults.select(col).join(hidden.select(col), col, "left_anti").union(custom.select(col)).distinct()


def missing_fields(fields: list[str]) -> Column:
    """The names of the fields that are blank; month and day count only with a blank year."""
    blank = {f: F.trim(text_of(F.col(f))) == "" for f in fields}
    ok = {f: b & blank["year"] if f in ("month", "day") and "year" in blank else b for f, b in blank.items()}
    return F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in ok.items()]))
