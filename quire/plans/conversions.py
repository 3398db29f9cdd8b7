"""Verified conversions in two phases: all outputs are read back and checked before any source is moved; the source of an output that fails stays."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import text_of
from quire.operators.edits import number_collisions
from quire.shared import Scratch
from quire.sources.book_source import CHUNK
from quire.sources.stores import file_system, seekable

#: What becomes of the sources: kept, moved to a folder of the day, or to the folder of things to be deleted.
POLICIES = ("keep", "quarantine", "recycle")


def archive_problem(path: str) -> str:
    """Why a file is no whole book archive, or an empty text. Every member is read, some of its bytes at a time, and its checksum compared."""
    try:
        system, place, _ = file_system(path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            return "there is no such file"
        if not info.size:
            return "the file is empty"
        with system.open_input_file(place) as file, zipfile.ZipFile(seekable(file)) as z:
            for member in z.infolist():
                with z.open(member) as part:
                    while part.read(CHUNK):
                        pass
            return "" if "META-INF/container.xml" in z.namelist() else "it is no book: META-INF/container.xml is missing"
    except Exception as e:  # noqa: BLE001 - whatever is wrong with it, it does not pass
        return f"it can't be read: {type(e).__name__}"


def verify(outputs: DataFrame) -> DataFrame:
    """(path, problem) of each path, read in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([archive_problem(p) for p in batch.column(0).to_pylist()], pa.string())], ["path", "problem"])

    return outputs.select("path").distinct().repartition("path").mapInArrow(run, "path string, problem string")


def settle(done: DataFrame, problems: DataFrame, policy: str, day: Column, now: Column, taken: DataFrame, recent_minutes: int = 10) -> DataFrame:
    """(source, result, action, destination, note): what is to become of each source. done: source, result, modified; problems: path, problem of
    every result (one without a row was not checked, which is a problem); taken: path, files that are there.

    ``failed``: the result did not pass, and the source stays whatever the policy; ``kept``: by the policy, or because it was changed in
    the last minutes; else ``quarantined`` into a folder of the day beside it, or ``recycled``, under a name that is free there."""
    if policy not in POLICIES:
        raise ValueError(f"{policy!r} is none of {', '.join(POLICIES)}")
    rows = done.join(problems.select(F.col("path").alias("result"), "problem"), "result", "left").withColumn("problem", F.coalesce("problem", F.lit("it was not checked")))
    recent = F.lit(recent_minutes > 0) & (F.col("modified") > now - F.make_dt_interval(mins=F.lit(recent_minutes)))
    moves = "quarantined" if policy == "quarantine" else "recycled"
    action = F.when(F.lit(policy == "keep"), "kept").when(F.col("problem") != "", "failed").when(recent, "kept").otherwise(moves)
    note = F.when(action == "failed", F.col("problem")).when((action == "kept") & F.lit(policy != "keep"), F.concat(F.lit("changed in the last "), F.lit(str(recent_minutes)), F.lit(" minutes"))).otherwise("")
    rows = rows.select("source", "result", action.alias("action"), note.alias("note"))
    folder, name = F.regexp_extract("source", "^(.*)/[^/]*$", 1), F.regexp_extract("source", "([^/]*)$", 1)
    stem, ending = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    place = F.concat_ws("/", folder, F.concat(F.lit("converted " if policy == "quarantine" else "recycled "), day))
    moved = rows.where(F.col("action").isin("quarantined", "recycled")).withColumn("ending", ending).withColumn("target", F.concat_ws("/", place, stem))
    # names are numbered among files of one ending
    there = taken.select(F.regexp_extract("path", r"(\.[^./]*)$", 1).alias("ending"), F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"))
    keyed = moved.withColumn("target", F.concat("ending", F.lit("\n"), "target"))
    numbered = number_collisions(keyed, "target", "source", there.select(F.concat("ending", F.lit("\n"), "stem").alias("target")))
    named = numbered.select("source", F.concat(F.regexp_replace("name", r"^[^\n]*\n", ""), "ending").alias("destination"))
    return rows.join(named, "source", "left").select("source", "result", "action", text_of(F.col("destination")).alias("destination"), "note")


def carry_out(settled: DataFrame) -> DataFrame:
    """Move the sources that are to be moved: (source, result, action, destination, note). One that can't be moved is ``failed``, with the
    reason. May be repeated: a source that is gone and whose destination is there has been moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                if not row["destination"]:
                    continue
                try:
                    system, source, _ = file_system(row["source"])
                    _, target, _ = file_system(row["destination"])
                    here, there = (system.get_file_info(p).type != fs.FileType.NotFound for p in (source, target))
                    if here and there:
                        raise FileExistsError(row["destination"])
                    if here:
                        system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                        system.move(source, target)
                    elif not there:
                        raise FileNotFoundError(row["source"])
                except Exception as e:  # noqa: BLE001 - the source is where it was
                    row |= {"action": "failed", "note": f"{type(e).__name__}: {e}"[:300]}
            yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return settled.mapInArrow(run, settled.schema)


def settle_conversions(done: DataFrame, policy: str, day: Column, now: Column, taken: DataFrame, dry_run: bool = False, recent_minutes: int = 10) -> DataFrame:
    """Both phases: every result is read back and the plan written to the shared folder; only then are sources moved. dry_run: what would happen."""
    scratch = Scratch(done.sparkSession, "conversions")
    problems = scratch.write(verify(done.select(F.col("result").alias("path"))), "problems")
    plan = scratch.write(settle(done, problems, policy, day, now, taken, recent_minutes), "plan")
    return plan if dry_run else scratch.write(carry_out(plan), "settled")
