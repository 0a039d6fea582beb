"""JSON-lines sink of page records: one object and a newline per record, appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def append_records(records: DataFrame, path: str, record: str = "record") -> None:
    """Appends the JSON column ``record`` as lines."""
    records.where(records[record].isNotNull()).select(records[record].alias("value")).write.mode("append").text(path)


def read_records(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
