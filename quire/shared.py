"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. On one machine (a local master) a temporary one is set where that is unset; a
    cluster without it raises, as executors would not see each other's files."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A run's own folder below the shared one. Each table is written once and read again, which cuts the lineage:
    a lost executor costs the tasks it ran, never the steps before the last table."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """by: a column of few values, each of which gets a folder of its own, so that a filter on it reads no other rows."""
        path = f"{self.path}/{name}"
        (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession, hours: float = 24) -> int:
    """Delete what runs that began more than so many hours ago left below the shared folder; how many there were. The last tables
    of a run are read by its result, so it cannot delete them itself."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quire")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    before = jvm.java.lang.System.currentTimeMillis() - int(hours * 3_600_000)
    old = [s.getPath() for s in files.listStatus(root) if s.getModificationTime() <= before] if files.exists(root) else []
    for path in old:
        files.delete(path, True)
    return len(old)
