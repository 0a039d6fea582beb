"""The link table (``link, status, round``; one row per link) as set operations.

Both sides of every join here hold a key once, or are reduced to that by a map-side combine
first, so no key can be hot.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.operators.lookup import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, Lookup
from linkloom.session import fresh_path

# --- fixed values ------------------------------------------------------------------------
WAITING, PROCESSING, COMPLETED, FAILED = "waiting", "processing", "completed", "failed"
STATUSES = [WAITING, PROCESSING, COMPLETED, FAILED]
LINKS_SCHEMA = "link STRING, status STRING, round INT"
# -----------------------------------------------------------------------------------------

# Up to this many links are taken by one task; more are taken by whole ranges.
MAX_ONE_TASK = 100_000


def empty_frontier(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LINKS_SCHEMA)


def unseen(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct links that the table does not hold yet."""
    return links.select("link").where(F.col("link").isNotNull()).distinct().join(frontier.select("link"), "link", "left_anti")


def unseen_by_batch(seen: DataFrame, links: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """:func:`unseen` for a batch much smaller than the table.

    The batch's distinct links are written and measured. Within the bounds they are broadcast to the scan
    of the table, whose rows stay where they are; what they meet there is no more than the batch.
    """
    found = Lookup.measured(links.select("link").where(F.col("link").isNotNull()).distinct(), "link", label="batch-links")
    if not replace(found, max_rows=max_rows, max_bytes=max_bytes).fits_broadcast:
        return unseen(seen, found.table)
    known = seen.select("link").join(F.broadcast(found.table), "link", "left_semi").distinct()
    return found.table.join(known, "link", "left_anti")


def insert(frontier: DataFrame, links: DataFrame, status: str = WAITING, round_no: int = 0) -> DataFrame:
    """Insert-if-absent: new links get ``status``; links already there keep theirs."""
    new = unseen(frontier, links).select(
        "link", F.lit(status).alias("status"), F.lit(round_no).cast("int").alias("round")
    )
    return frontier.select("link", "status", "round").unionByName(new)


def latest_status(updates: DataFrame, link: str = "link", status: str = "status", seq: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The last status of each link in an update log (one row per link)."""
    order = F.struct(*(F.col(c) for c in seq)) if len(seq) > 1 else F.col(seq[0])
    return updates.groupBy(F.col(link).alias("link")).agg(F.max_by(F.col(status), order).alias("status"))


def update(frontier: DataFrame, statuses: DataFrame, seq: tuple[str, ...] = ()) -> DataFrame:
    """Sets the status of the given links; unknown links are ignored.

    A link given more than once takes its last status by ``seq``, or without one the status that is furthest
    along (failed, completed, processing, waiting), so that it stays one row.
    """
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    order = F.struct(*(F.col(c) for c in seq), rank.alias("_rank"), F.col("status").alias("_status"))
    new = statuses.groupBy("link").agg(F.max_by("status", order).alias("_new"))
    return frontier.join(new, "link", "left").select(
        "link", F.coalesce("_new", "status").alias("status"), "round"
    )


def delete(frontier: DataFrame, links: DataFrame) -> DataFrame:
    """Removes the given links; unknown ones are ignored."""
    return frontier.join(links.select("link").distinct(), "link", "left_anti")


def take(frontier: DataFrame, status: str = WAITING, n: int = -1, one_task: int = MAX_ONE_TASK) -> DataFrame:
    """``n`` links of a status (-1: all), oldest round first, then by link.

    Above ``one_task`` links no single task holds them; the rows are the same, in no order.
    """
    of_status = frontier.where(F.col("status") == status)
    if n == -1:
        return of_status
    return of_status.orderBy("round", "link").limit(n) if n <= one_task else _take_ranges(of_status, n)


def _take_ranges(links: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by round and link: whole ranges while they fit, and a part of the next one.

    The ranges are written first, as a second sampling could cut them elsewhere. A row per range
    gives the number of links before it; only the range at the bound is ranked.
    """
    spark, path = links.sparkSession, fresh_path(links.sparkSession, "take")
    ranged = links.repartitionByRange("round", "link").withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_range")) - F.col("_size"))
    met = ranged.join(before.where(F.col("_before") < n), "_range")
    whole = met.where(F.col("_before") + F.col("_size") <= n)
    at_bound = met.where(F.col("_before") + F.col("_size") > n).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("_range").orderBy("round", "link"))
    )
    part = at_bound.where(F.col("_before") + F.col("_rank") <= n)
    return whole.select(*links.columns).unionByName(part.select(*links.columns))


def first(frontier: DataFrame, status: str = WAITING) -> DataFrame:
    """One link of a status, or no row."""
    return take(frontier, status, 1)


def claim(frontier: DataFrame, n: int = -1) -> DataFrame:
    """The table after taking ``n`` waiting links into ``processing``."""
    if n == -1:
        return frontier.withColumn(
            "status", F.when(F.col("status") == WAITING, F.lit(PROCESSING)).otherwise(F.col("status"))
        )
    taken = take(frontier, WAITING, n).select("link", F.lit(PROCESSING).alias("status"))
    return update(frontier, taken)


def status_counts(frontier: DataFrame) -> DataFrame:
    return frontier.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def status_counts_zero(frontier: DataFrame) -> DataFrame:
    """Counts with all four statuses present; a status outside the four is kept too.

    Each status enters the count once with weight zero, so this is one aggregation and no join.
    """
    names = F.explode(F.array(*(F.lit(s) for s in STATUSES)))
    zeros = frontier.sparkSession.range(1).select(names.alias("status"), F.lit(0).cast("bigint").alias("weight"))
    ones = frontier.select("status", F.lit(1).cast("bigint").alias("weight"))
    return ones.unionByName(zeros).groupBy("status").agg(F.sum("weight").alias("n"))
