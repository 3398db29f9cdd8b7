"""The change journal as a stream: changes arrive as files, repeats within a day are dropped, counts follow by the hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "change_id long, book_id string, field string, old string, new string, at timestamp"


def read_changes(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """Each change once, as long as its repeat comes within a day."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["change_id"])


def hourly(changes: DataFrame) -> DataFrame:
    """Changes of every field by the hour; an hour is final when the watermark has passed it."""
    return changes.groupBy(F.window("at", "1 hour").alias("w"), "field").agg(F.count("*").alias("changes")).select(F.col("w.start").alias("hour"), "field", "changes")


def append_to(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the stream to a table of files, each change exactly once, and stop when all that is there is in."""
    return changes.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
