"""Facts from paths: a pattern per path segment, with a confidence that other files of the batch can raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.patterns import fields_of, parse
from quire.functions.text import collapse, text_of

# Confidence of a value from the file's own name, from a folder, and what corroboration adds to the latter.
FROM_FILE, FROM_FOLDER, CORROBORATED = 1.0, 0.75, 0.2


def segments(path: Column, root: str) -> Column:
    """Folders below the root and the file's stem."""
    inner = F.regexp_replace(F.when(path.startswith(root), F.substring(path, len(root) + 1, 1 << 20)).otherwise(path), r"^[/\\]+", "")
    return F.split(F.regexp_replace(inner, r"\.[A-Za-z0-9]{2,5}$", ""), r"[/\\]+")


def parse_paths(files: DataFrame, pattern: str, root: str) -> DataFrame:
    """(path, field, value, from_file, missing): what each segment of the pattern ("%authors%/%series%/%title%") finds. The last
    segments of path and pattern belong together; missing is how many segments the path lacks. A field of two segments has the
    value of the one nearest the file."""
    parts = pattern.split("/")
    rows = files.select("path", segments(F.col("path"), root).alias("s"))
    found = []
    for k, part in enumerate(reversed(parts)):
        at = F.size("s") - 1 - k
        value = F.when(at >= 0, parse(part, F.get("s", at)))
        for field in fields_of(part):
            found.append(F.struct(F.lit(field).alias("field"), value[field].alias("value"), F.lit(k).alias("up")))
    each = rows.select("path", F.greatest(F.lit(len(parts)) - F.size("s"), F.lit(0)).alias("missing"), F.explode(F.array(*found)).alias("f")).where("f.value is not null")
    return each.groupBy("path", F.col("f.field").alias("field")).agg(F.min_by("f.value", "f.up").alias("value"), (F.min("f.up") == 0).alias("from_file"), F.first("missing").alias("missing"))


def corroborate(found: DataFrame, saved: DataFrame) -> DataFrame:
    """found with ``sure``: whether a folder's value is also that of another folder's file of the batch, stands in another file's
    name, or is in another file's saved metadata (saved: path, field, value). A file is no witness for itself: its own votes are
    taken off the grouped counts, so no pairs of files are formed."""
    key = F.lower(collapse(F.col("value")))
    folder = F.regexp_extract("path", r"^(.*)[/\\][^/\\]*$", 1)
    rows = found.select("*", key.alias("k"), folder.alias("folder"))
    batch = rows.groupBy("field", "k").agg(F.count_distinct("folder").alias("folders"), F.count_if("from_file").alias("names"))
    own = saved.select("path", "field", F.lower(collapse(F.col("value"))).alias("k")).where("k <> ''").distinct()
    kept = own.groupBy("field", "k").agg(F.count("*").alias("saved"))
    rows = rows.join(batch, ["field", "k"]).join(kept, ["field", "k"], "left").join(own.withColumn("mine", F.lit(1)), ["path", "field", "k"], "left")
    sure = (F.col("folders") >= 2) | (F.col("names") - F.col("from_file").cast("int") >= 1) | (F.coalesce("saved", F.lit(0)) - F.coalesce("mine", F.lit(0)) >= 1)
    return rows.select("path", "field", "value", "from_file", "missing", sure.alias("sure"))


def path_confidence(found: DataFrame) -> DataFrame:
    """(path, confidence, missing): the mean over the fields."""
    one = F.when(F.col("from_file"), FROM_FILE).otherwise(FROM_FOLDER + F.when(F.col("sure"), CORROBORATED).otherwise(0.0))
    return found.groupBy("path").agg(F.round(F.avg(one), 4).alias("confidence"), F.max("missing").alias("missing"))


def folder_and_stem(path: Column) -> tuple[Column, Column]:
    """The folder of a file, and its name without the ending."""
    path = text_of(path)
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1), F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def sibling_stems(files: DataFrame) -> DataFrame:
    """(path, folder, stem, siblings) of every archive: the stems of a file's siblings are those of its folder but its own, one row each;
    siblings counts them. Only names are looked at."""
    folder, stem = folder_and_stem(F.col("path"))
    rows = files.where(F.lower("path").endswith(".epub")).select("path", folder.alias("folder"), stem.alias("stem")).distinct()
    counts = rows.groupBy("folder").agg(F.count("*").alias("n"))
    return rows.join(counts, "folder").select("path", "folder", "stem", (F.col("n") - 1).alias("siblings"))


def sibling_support(files: DataFrame, pattern: str, field: str) -> DataFrame:
    """(path, value, support): what the pattern finds in each stem for a field, and how many other stems of the folder give the same value
    (white space and capitals apart). A folder's values are counted and each file's own is taken off, so no pairs of files are formed."""
    stems = sibling_stems(files)
    found = stems.withColumn("value", parse(pattern, F.col("stem"))[field]).where("value is not null").withColumn("k", F.lower(collapse(F.col("value"))))
    counts = found.groupBy("folder", "k").agg(F.count("*").alias("n"))
    return found.join(counts, ["folder", "k"]).select("path", "value", (F.col("n") - 1).alias("support"))
