"""Duplicate books: groups by content, by title and author, and by number, merged by strength of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Kinds of evidence, strongest first.
TIERS = ("identical", "possible", "weak")


def content_fingerprint(entries: DataFrame) -> DataFrame:
    """book_id and fingerprint ("count-hash"): a SHA-256 over the sorted (name, crc, size) of a book's archive entries, but
    the metadata file's. entries: book_id, name, crc (long), size (long), is_opf."""
    line = F.concat(F.col("name"), F.lit("\0"), F.lower(F.lpad(F.hex("crc"), 8, "0")), F.lit("\0"), F.col("size").cast("string"), F.lit("\n"))
    rows = entries.select("book_id", "name", "crc", "size", F.when(~F.col("is_opf"), F.struct("name", "crc", "size", line.alias("line"))).alias("e"))
    every = F.sort_array(F.collect_list("e"))
    out = rows.groupBy("book_id").agg(every.alias("es"))  # a book's own entries
    return out.select("book_id", F.concat(F.size("es").cast("string"), F.lit("-"), F.substring(F.sha2(F.array_join(F.transform("es", lambda e: e["line"]), ""), 256), 1, 16)).alias("fingerprint"))


def candidate_groups(books: DataFrame) -> DataFrame:
    """(kind, key, tier, book_id): one row per member of each group of two and more. books: book_id, fingerprint, title_key,
    author_key, isbn13; empty texts make no group. A group stays in rows, so its size is no matter."""
    part = lambda kind, tier, key, ok: books.where(ok).select(F.lit(kind).alias("kind"), key.alias("key"), F.lit(tier).alias("tier"), "book_id")
    both = F.concat_ws("\0", "title_key", "author_key")
    every = (
        part("content", TIERS[0], F.col("fingerprint"), F.col("fingerprint") != "")
        .unionByName(part("title", TIERS[1], both, (F.col("title_key") != "") & (F.col("author_key") != "")))
        .unionByName(part("isbn", TIERS[2], F.col("isbn13"), F.col("isbn13") != ""))
    )
    sizes = every.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1")
    return every.join(sizes, ["kind", "key"])


def merge_groups(members: DataFrame) -> DataFrame:
    """Groups with the same members as one, led by the strongest tier; a group strictly inside a stronger one is dropped;
    groups that overlap in part stay. members: kind, key, tier, book_id, n. Returns kind, key, tier, n, first_id, also.

    Equal member sets are told by count and two sums of hashes, so no set is gathered. A group lies inside another when as many
    of its members are in the other as it has."""
    strength = F.when(F.col("tier") == TIERS[0], 0).when(F.col("tier") == TIERS[1], 1).otherwise(2)
    groups = members.groupBy("kind", "key", "tier").agg(
        F.count("*").alias("n"), F.min("book_id").alias("first_id"), F.sum(F.xxhash64("book_id").cast("decimal(20,0)")).alias("h1"), F.sum(F.hash("book_id").cast("long")).alias("h2")
    )
    same = Window.partitionBy("n", "first_id", "h1", "h2")
    order = same.orderBy(strength, "kind", "key")
    merged = groups.withColumn("place", F.row_number().over(order)).withColumn("also", (F.count("*").over(same) - 1).cast("int")).where("place = 1")
    lead = merged.select("kind", "key", "tier", "n", "first_id", "also", strength.alias("s"))
    rows = members.select("kind", "key", "book_id").join(lead, ["kind", "key"])
    a, b = rows.alias("a"), rows.alias("b")
    # only a weaker group looks for a stronger, larger one that holds each of its members
    inside = (
        a.join(b, (F.col("a.book_id") == F.col("b.book_id")) & (F.col("b.s") < F.col("a.s")) & (F.col("b.n") > F.col("a.n")))
        .groupBy("a.kind", "a.key", "a.n", F.col("b.kind").alias("k2"), F.col("b.key").alias("key2"))
        .agg(F.count("*").alias("shared"))
        .where("shared = n")
        .select("kind", "key")
        .distinct()
    )
    return lead.join(inside, ["kind", "key"], "left_anti").drop("s")
