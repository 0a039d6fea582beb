"""Captured responses in: files of any Spark format, as a table or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkloom.plans.capture import RESPONSES_SCHEMA


def conform(df: DataFrame) -> DataFrame:
    """Gives a capture table the response columns: an absent final URL is the URL, an absent
    status column means 200, an absent location none. Further columns stay."""
    have = set(df.columns)
    if "final_url" in have:
        df = df.withColumn("final_url", F.coalesce("final_url", "url"))
    else:
        df = df.withColumn("final_url", F.col("url"))
    if "status" not in have:
        df = df.withColumn("status", F.lit(200))
    if "location" not in have:
        df = df.withColumn("location", F.lit(None).cast("string"))
    return df.withColumn("status", F.col("status").cast("int"))


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | StructType | None = None) -> DataFrame:
    """Columnar formats bring their schema; JSON and CSV are read under the response schema."""
    reader = spark.read.format(fmt)
    if schema is not None or fmt in ("json", "csv"):
        reader = reader.schema(schema or RESPONSES_SCHEMA)
    return conform(reader.load(path))


def stream_responses(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: str | StructType = RESPONSES_SCHEMA, files_per_batch: int | None = None
) -> DataFrame:
    """A folder of captures as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return conform(reader.load(path))
