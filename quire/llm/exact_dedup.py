"""Exact dedup through an extendible-hash index kept as tables in the shared folder. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.hot_keys import FEW_ROWS, MOST_HOT
from quire.shared import Scratch

#: Bits by which the directory grows at a time, and those of a key.
STEP, KEY_BITS = 12, 60
#: Text bytes of a bucket before it splits: within these bounds about a thousandth of all; beyond so many buckets it rises.
LEAST_BYTES, MOST_BYTES, MOST_BUCKETS = 64 << 10, 8 << 20, 1 << 19
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z only. Where every character is one byte, lower() does just that, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text.cast("string"), F.lit("")))


def prefix(key: str, bits: int) -> Column:
    """The first bits of a key of KEY_BITS."""
    return F.shiftright(key, KEY_BITS - bits)


class Directory:
    """The directory of an extendible hash: which bucket each key belongs to.

    levels: tables (slot, depth, bucket), one for each STEP bits of the key. A slot of a level stands for a value of the first STEP,
    2 * STEP, ... bits. Its bucket has the key's first ``depth`` bits, so all slots that share them share the bucket; a slot
    that is overfull by itself has no bucket, and the next level is its doubling. A bucket's number is its bits with a 1 before."""

    def __init__(self, levels: list[DataFrame]):
        self.levels = levels

    def place(self, rows: DataFrame, key: str = "key") -> DataFrame:
        """The rows with their ``bucket``; the directory is broadcast (at most about 2 * MOST_BUCKETS slots of 20 bytes a level)."""
        buckets = []
        for i, level in enumerate(self.levels):
            rows = rows.withColumn(f"slot_{i}", prefix(key, (i + 1) * STEP))
            rows = rows.join(F.broadcast(level.select(F.col("slot").alias(f"slot_{i}"), F.col("bucket").alias(f"bucket_{i}"))), f"slot_{i}", "left")
            buckets.append(f"bucket_{i}")
        rows = rows.withColumn("bucket", F.coalesce(*buckets))
        return rows.drop(*buckets, *(f"slot_{i}" for i in range(len(self.levels))))


def build_directory(keys: DataFrame, capacity: int, scratch: Scratch) -> Directory:
    """Split buckets until none holds more than ``capacity`` bytes, or a single key. keys: key, bytes.

    A directory of g bits has a bucket for each value of the first g bits of a key. A bucket that holds more than it may
    splits by the next bit, and where the directory has no bit left for that, it doubles. STEP doublings are worked out from
    one sum over the keys of the slots that are still overfull; a level has one row for each slot in use."""
    levels, parents = [], None
    for i in range(KEY_BITS // STEP):
        bits = (i + 1) * STEP
        rows = keys.select(prefix("key", bits).alias("slot"), "bytes").withColumn("up", F.shiftright("slot", STEP))
        if parents is not None:
            rows = rows.join(F.broadcast(parents), "up", "left_semi")
        # the slots of one overfull slot are at most 2^STEP, and are brought into one partition
        slots = rows.groupBy("up", "slot").agg(F.sum("bytes").alias("bytes")).repartition("up")
        depth = F.lit(bits)
        for d in range(bits - 1, bits - STEP - 1, -1):
            slots = slots.withColumn(f"full_{d}", F.sum("bytes").over(Window.partitionBy("up", F.shiftright("slot", bits - d))))
            depth = F.when(F.col(f"full_{d}") <= capacity, d).otherwise(depth)
        bucket = F.expr(f"shiftright(slot, {bits} - depth) + shiftleft(1L, depth)")
        whole = (F.col("bytes") <= capacity) | F.lit(bits == KEY_BITS)
        level = scratch.write(slots.select("slot", "bytes", depth.cast("int").alias("depth")).withColumn("bucket", F.when(whole, bucket)), f"directory-{i}")
        levels.append(level)
        parents = level.where("bucket is null").select(F.col("slot").alias("up"))
        if parents.isEmpty():
            break
    return Directory(levels)


class Index:
    """Texts by key, and the owner task of each: the task that a bucket's rows go to.

    Of keys that very many rows have (at most MOST_HOT of them, in ``hot``), each reading task merges its own copies before they are
    sent, so that no owner receives a third of all rows."""

    def __init__(self, rows: DataFrame, text: str, scratch: Scratch):
        """rows: ``text`` and others; a column key is added."""
        self.scratch, seen = scratch, Observation()
        self.rows = rows.withColumn("key", F.shiftrightunsigned(F.xxhash64(normalised(F.col(text))), 64 - KEY_BITS))
        keys = self.rows.groupBy("key").agg(F.max(F.octet_length(text)).cast("long").alias("bytes"), F.count("*").alias("n"))
        keys = scratch.write(keys.observe(seen, F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "keys")
        total, n = seen.get["bytes"] or 0, seen.get["n"] or 0
        capacity = max(total // MOST_BUCKETS, min(MOST_BYTES, max(LEAST_BYTES, total // 1024)))
        self.directory = build_directory(keys, capacity, scratch)
        self.hot = scratch.write(keys.where(F.col("n") > max(FEW_ROWS, n // MOST_HOT)).select("key"), "hot")

    def owned(self, rows: DataFrame) -> DataFrame:
        """The rows with their bucket, each in its owner task."""
        return self.directory.place(rows).repartition("bucket")

    def cold(self) -> DataFrame:
        return self.rows.join(F.broadcast(self.hot), "key", "left_anti")

    def warm(self) -> DataFrame:
        return self.rows.join(F.broadcast(self.hot), "key", "left_semi")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same bytes after A-Z are lower-cased; null counts as empty, so null and empty texts
    are one group. Of a group the row with the largest doc_id stays (a null id is smaller than any; a group of null ids only
    keeps one of them). Of rows that repeat the id and text that stay, one is kept. An empty table gives no rows; other columns
    are never read.

    How: keys (hashes of the texts) and their bytes are counted, the directory is split from these, and every row goes to the
    task that owns its bucket. There the rows of a bucket are sorted by key and text: different texts of one key are a chain
    (numbered 1, 2, ...), equal ones are found by comparing the texts themselves. The entries of very frequent keys come to
    the owner merged; their rows are told the result by key and SHA-256.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    index = Index(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "text", scratch)
    equal = Window.partitionBy("bucket", "key", "norm")
    chain = F.dense_rank().over(Window.partitionBy("bucket", "key").orderBy("norm"))

    rows = index.owned(index.cold()).withColumn("norm", normalised(F.col("text"))).drop("text")
    rows = rows.withColumn("place", F.row_number().over(equal.orderBy(F.desc_nulls_last("doc_id")))).withColumn("chain", chain)
    rows = rows.withColumn("keep_id", F.max("doc_id").over(equal)).withColumn("group_size", F.count("*").over(equal))
    cold = rows.select("bucket", "key", "chain", "doc_id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), F.sha2("norm", 256).alias("text_sha256"))

    warm = index.warm().select("key", "doc_id", normalised(F.col("text")).alias("norm"))
    merged = warm.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = index.owned(merged).withColumn("chain", chain).select("bucket", "key", "chain", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    entries = scratch.write(entries, "entries")
    # rows that repeat id and text are counted into one, and told apart again after the look-up
    warm = warm.groupBy("key", F.sha2("norm", 256).alias("text_sha256"), "doc_id").agg(F.count("*").alias("same"))
    few = entries.count() <= MOST_HOT  # many different texts of very frequent keys are met by a shuffle instead
    warm = warm.join(F.broadcast(entries) if few else entries, ["key", "text_sha256"]).withColumn("copy", F.explode(F.expr("sequence(1L, same)")))
    warm = warm.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1))
    table = scratch.write(cold.unionByName(warm.select(*cold.columns)), "index")
    scratch.drop("keys", "hot", "entries", *(f"directory-{i}" for i in range(len(index.directory.levels))))
    return table.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_duplicates keeps, with all their columns, whatever their names. Null texts count as empty; of rows that
    share the largest id and the text, one stays, one of them. An empty table stays empty.

    Whole rows go to the owners of their buckets, where the first of equal texts is taken; of very frequent keys each
    reading task sends its best row only."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = Index(rows, "text", scratch)
    best = Window.partitionBy("bucket", "key", "norm").orderBy(F.desc_nulls_last("doc_id"), "text")
    in_row = F.col(f"row.`{text_col}`").cast("string")
    cold = index.owned(index.cold().drop("text")).withColumn("text", in_row).withColumn("norm", normalised(in_row))
    cold = cold.withColumn("place", F.row_number().over(best)).where("place = 1").select("row")
    warm = index.warm().withColumn("norm", normalised(F.col("text")))
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), F.col("doc_id").isNotNull())
    warm = warm.groupBy("key", "norm").agg(F.max_by("row", order).alias("row"))
    warm = index.owned(warm).groupBy("bucket", "key", "norm").agg(F.first("row").alias("row")).select("row")
    return cold.unionByName(warm).select("row.*")
