"""Frontier upkeep as Structured Streaming jobs.

State lives in tables, one folder per micro-batch (``batch=<id>``), never in an unbounded
operator state. A batch folder is overwritten when its batch is replayed and reads of the table
leave it out, so a replay after a lost driver or executor gives the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from linkloom.operators import frontier as fr
from linkloom.plans.capture import Outputs, page_results, split_results, store_results
from linkloom.registry import Registry
from linkloom.session import fresh_path

INITIAL = -1


def batch_table(spark: SparkSession, path: str, schema: str | StructType, before: int | None = None) -> DataFrame:
    """All batches of a table, or those before batch ``before``."""
    table = spark.read.schema(schema).option("basePath", path).parquet(path)
    return table if before is None else table.where(F.col("batch") < before)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stream_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream. ``files_per_batch`` is the back-pressure knob."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """The files of a Parquet table, or its one file, as a stream, read where they lie."""
    exact = f"{path[:-1]}[{path[-1]}]"  # a stream source takes a single file only as a pattern
    return stream_files(spark, exact, spark.read.parquet(path).schema)


def _finish(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Runs a stream over all that its source holds now."""
    job = writer.option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True).start()
    job.awaitTermination()


# --- links -------------------------------------------------------------------------------------

LINK_BATCH = fr.LINKS_SCHEMA + ", batch INT"


def link_ingest(links: DataFrame, path: str, status: str = fr.WAITING) -> DataStreamWriter:
    """Insert-if-absent of a link stream into the batch table at ``path``.

    Each batch is reduced to its distinct links before it meets the table; "seen before" is asked
    of the table, so no state grows in the query. A batch within the broadcast bounds is looked for where
    the table's links are scanned: the table is read in that one column and never shuffled.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        seen = batch_table(batch.sparkSession, path, LINK_BATCH, before=batch_id)
        new = fr.unseen_by_batch(seen, batch)
        write_batch(
            new.select("link", F.lit(status).alias("status"), F.lit(batch_id + 1).cast("int").alias("round")), path, batch_id
        )

    return links.writeStream.foreachBatch(absorb)


# --- statuses ----------------------------------------------------------------------------------


def status_update(statuses: DataFrame, path: str, seq: tuple[str, ...]) -> DataStreamWriter:
    """Keeps the last status per link of each batch of a stream of status changes.

    Batches are appended as a log; :func:`current_statuses` merges them.
    """

    def absorb(batch: DataFrame, batch_id: int) -> None:
        order = F.struct(*(F.col(c) for c in seq))
        last = batch.groupBy("link").agg(F.max_by("status", order).alias("status"), F.max(order).alias("seq"))
        write_batch(last, path, batch_id)

    return statuses.writeStream.foreachBatch(absorb)


def current_statuses(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each link over all batches, by the sequence and not by arrival."""
    return fr.latest_status(spark.read.parquet(path), seq=("seq",))


def live_frontier(spark: SparkSession, links_path: str, statuses_path: str) -> DataFrame:
    """The link table with every status change so far: :func:`link_ingest` and
    :func:`status_update` tables put together."""
    return fr.update(batch_table(spark, links_path, LINK_BATCH), current_statuses(spark, statuses_path))


def compact_links(spark: SparkSession, links_path: str, statuses_path: str, new_path: str) -> None:
    """Rewrites both tables into the initial batch of a new link table, one file set per shuffle
    partition in place of one per micro-batch."""
    write_batch(live_frontier(spark, links_path, statuses_path), new_path, INITIAL)


def status_gauge(spark: SparkSession, statuses_path: str) -> DataFrame:
    """Links per current status by the log so far, with zeros: a link whose status changed counts once."""
    return fr.status_counts_zero(current_statuses(spark, statuses_path))


# --- results -----------------------------------------------------------------------------------


def result_fanout(responses: DataFrame, registry: Registry, path: str) -> DataStreamWriter:
    """Captured responses -> batch tables ``statuses``, ``records``, ``links`` under ``path``.

    The batch's results are written once and the three outputs read from there, so pages are
    extracted once and no executor's memory has to keep them.
    """
    registry.lookup  # measured before the stream starts

    def absorb(batch: DataFrame, batch_id: int) -> None:
        results = store_results(page_results(batch, registry), f"{path}/results/batch={batch_id}")
        out = split_results(results, registry)
        write_batch(out.statuses, f"{path}/statuses", batch_id)
        write_batch(out.records, f"{path}/records", batch_id)
        write_batch(out.links, f"{path}/links", batch_id)

    return responses.writeStream.foreachBatch(absorb)


# --- bounded runs, for tests and backfills -------------------------------------------------------


def run_link_ingest(spark: SparkSession, source: DataFrame, initial: DataFrame) -> DataFrame:
    path = fresh_path(spark, "links")
    write_batch(initial.select("link", "status", "round"), path, INITIAL)
    _finish(link_ingest(source, path), spark)
    return batch_table(spark, path, LINK_BATCH).select("link", "status")


def run_status_update(spark: SparkSession, source: DataFrame, seq: tuple[str, ...]) -> DataFrame:
    path = fresh_path(spark, "statuses")
    _finish(status_update(source, path, seq), spark)
    return current_statuses(spark, path)


def run_result_fanout(spark: SparkSession, source: DataFrame, registry: Registry) -> Outputs:
    path = fresh_path(spark, "results")
    _finish(result_fanout(source, registry, path), spark)
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Outputs(read("statuses"), read("records"), read("links"))


def run_status_gauge(spark: SparkSession, source: DataFrame, seq: tuple[str, ...] = ("round",)) -> DataFrame:
    path = fresh_path(spark, "gauge")
    _finish(status_update(source, path, seq), spark)
    return status_gauge(spark, path)
