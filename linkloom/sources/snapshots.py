"""The link table on disk: one Parquet folder per round, and a pointer to the current one.

A round is written whole to a folder of its own before the pointer moves, so a job that dies
half-way leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.frontier import LINKS_SCHEMA, empty_frontier

POINTER_SCHEMA = "snapshot INT"


def current_snapshot(spark: SparkSession, root: str) -> int | None:
    """Number of the current snapshot, None for a table that was never written."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(POINTER_SCHEMA).json(f"{root}/pointer").agg(F.max("snapshot")).first()[0]


def write_snapshot(links: DataFrame, root: str) -> int:
    """Writes the next snapshot, then points at it. ``links`` may read the current one."""
    spark = links.sparkSession
    last = current_snapshot(spark, root)
    number = 0 if last is None else last + 1
    links.select("link", "status", "round").write.mode("overwrite").parquet(f"{root}/links/snapshot={number}")
    spark.range(1).select(F.lit(number).alias("snapshot")).write.mode("append").json(f"{root}/pointer")
    return number


def read_links(spark: SparkSession, root: str, snapshot: int | None = None) -> DataFrame:
    """The link table at a snapshot (default: the current one); empty if never written."""
    number = current_snapshot(spark, root) if snapshot is None else snapshot
    if number is None:
        return empty_frontier(spark)
    return spark.read.schema(LINKS_SCHEMA).parquet(f"{root}/links/snapshot={number}")
