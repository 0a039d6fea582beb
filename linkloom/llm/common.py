"""What several operators share: written intermediates, global numbering, connected components."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import fresh_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str, group_bytes: int = 128 << 20, codec: str = "") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, and still there when an executor is lost.

    A task holds a row group of about ``group_bytes`` as it writes or reads. Without a ``codec`` Spark's setting holds.
    """
    path = fresh_path(df.sparkSession, f"llm-{label}")
    df.write.option("parquet.block.size", group_bytes).options(**{"compression": codec} if codec else {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000, size: str = "8m"):
    """Jobs run inside hand at most ``rows`` rows or about ``size`` bytes at a time to Python, so that whole texts take little memory."""
    arrow = "spark.sql.execution.arrow."
    wanted = {f"{arrow}maxRecordsPerBatch": str(rows), f"{arrow}maxBytesPerBatch": size}
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def give_back() -> None:
    """Returns what numpy and Arrow hold free to the system: a Python worker serves other tasks after this one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A batch function that gives memory back at its task's end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def in_order(df: DataFrame, order: list[str], label: str, partitions: int | None = None) -> DataFrame:
    """``df`` sorted over all partitions and written, with ``_part`` and ``_row``: its place within the sort.

    A row's global position is the rows of the parts before ``_part``, plus ``_row``. Ties in ``order``
    are told apart by the place they were read from, so a repeated key spreads over partitions.
    """
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*order, "_tie"]
    dealt = tied.repartitionByRange(partitions, *keys) if partitions else tied.repartitionByRange(*keys)
    placed = dealt.sortWithinPartitions(*keys).withColumns(
        {
            "_part": F.spark_partition_id(),
            "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
        }
    )
    return written(placed.drop("_tie"), label)


def part_offsets(parts: DataFrame, amount: str) -> DataFrame:
    """``_part, _before``: the sum of ``amount`` over all lower parts. One row per part, so it may be broadcast."""
    totals = parts.groupBy("_part").agg(F.sum(amount).alias("_amount"))
    before = "sum(_amount) OVER (ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return totals.select("_part", F.coalesce(F.expr(before), F.lit(0)).alias("_before"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """``node, root``: each node of ``edges(a, b)`` with the smallest node it can reach.

    Alternates the large-star and small-star steps: every node's neighbours are hung on the smallest
    of them until each component is one star. A step is two map-side combined aggregations and two
    joins (a hub's edges are split by the skew join), and ends in a written table.
    """
    current = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), label
    )
    state = _digest(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), label)
        before, state, current = state, _digest(new), new
        if state == before:
            break
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    """Row count and two order-free checksums: equal for equal edge sets."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
