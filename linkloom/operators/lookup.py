"""Key lookups against a table with one row per key, with the small side's size checked.

A lookup table within the bounds is broadcast, so the large side is never shuffled. Past them the keys of
the large side are counted first, on that one column: if the table's rows for the keys that occur are within the
bounds, these are broadcast instead. Else the keys that hold a thousandth of all rows or more, a thousand of
them at most, are broadcast, and only rows of other keys are shuffled to the table, so no key is hot in a shuffle
and rows without a key stay where they are. A stream cannot be counted: its join is salted by input partition.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.session import fresh_path

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
SALTS = 32
HOT_SHARE = 1_000


@dataclass(frozen=True)
class Lookup:
    """A keyed table with its measured size."""

    table: DataFrame
    key: str
    rows: int
    bytes: int
    max_list: int = 0
    max_rows: int = MAX_BROADCAST_ROWS
    max_bytes: int = MAX_BROADCAST_BYTES

    @staticmethod
    def measured(df: DataFrame, key: str, size_of: tuple[str, ...] = (), label: str = "lookup") -> "Lookup":
        """Writes ``df`` to the shared folder, then measures what was written."""
        spark = df.sparkSession
        path = fresh_path(spark, label)
        df.write.parquet(path)
        table = spark.read.parquet(path)
        width = sum((F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in table.columns), F.lit(0))
        lists = F.greatest(F.lit(0), *(F.coalesce(F.size(c), F.lit(0)) for c in size_of)) if size_of else F.lit(0)
        got = table.agg(
            F.count(F.lit(1)).alias("rows"), F.sum(width).alias("bytes"), F.max(lists).alias("max_list")
        ).first()
        return Lookup(table, key, got["rows"], got["bytes"] or 0, got["max_list"] or 0)

    @property
    def fits_broadcast(self) -> bool:
        return self.rows <= self.max_rows and self.bytes <= self.max_bytes

    def join(self, df: DataFrame, on: str, columns: dict[str, str], how: str = "left") -> DataFrame:
        """Joins ``df[on]`` to the key; ``columns`` maps lookup columns to output names."""
        side = self.table.select(
            F.col(self.key).alias("_lk_key"), *(F.col(c).alias(name) for c, name in columns.items())
        )
        on_key = F.col(on) == F.col("_lk_key")
        if self.fits_broadcast:
            return df.join(F.broadcast(side), on_key, how).drop("_lk_key")
        if df.isStreaming:
            salted = side.withColumn("_lk_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            left = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
            return left.join(salted, on_key & (F.col("_salt") == F.col("_lk_salt")), how).drop(
                "_lk_key", "_lk_salt", "_salt"
            )
        return self._past_broadcast(df, on, side, how)

    def _past_broadcast(self, df: DataFrame, on: str, side: DataFrame, how: str) -> DataFrame:
        counts = df.where(F.col(on).isNotNull()).groupBy(F.col(on).alias("_lk_key")).agg(F.count(F.lit(1)).alias("_lk_n"))
        met = Lookup.measured(side.join(counts, "_lk_key"), "_lk_key", label="lookup-met")
        met = replace(met, max_rows=self.max_rows, max_bytes=self.max_bytes)
        names = [c for c in side.columns if c != "_lk_key"]
        if met.fits_broadcast:
            return met.join(df, on, {c: c for c in names}, how)
        total = counts.agg(F.sum("_lk_n")).first()[0]
        hot = counts.where(F.col("_lk_n") * HOT_SHARE >= total).select(F.col("_lk_key").alias("_hot"))  # HOT_SHARE keys at most
        told = hot.join(side, F.col("_hot") == F.col("_lk_key"), "left")
        known = df.join(F.broadcast(told), F.col(on) == F.col("_hot"), "left")
        stays = F.col("_hot").isNotNull() | F.col(on).isNull()
        stay = known.where(F.col("_lk_key").isNotNull() if how == "inner" else stays)
        moved = known.where(~stays).drop(*names, "_lk_key", "_hot")
        return stay.drop("_lk_key", "_hot").unionByName(moved.join(side, F.col(on) == F.col("_lk_key"), how).drop("_lk_key"))
