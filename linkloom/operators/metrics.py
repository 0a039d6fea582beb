"""Counters and timings of a crawl as aggregates over its tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.records import record_bytes
from linkloom.operators.frontier import PROCESSING, WAITING


def result_totals() -> list[Column]:
    """Pages completed and failed and bytes stored, as aggregates over results."""
    return [
        F.count_if(F.col("success")).alias("urls.completed"),
        F.count_if(~F.col("success")).alias("urls.failed"),
        F.coalesce(F.sum(record_bytes(F.col("record"))), F.lit(0)).cast("bigint").alias("store.writes"),
    ]


def crawl_counters(frontier: DataFrame, totals: dict[str, int], links: DataFrame) -> DataFrame:
    """``counter, value``: links queued and taken, pages processing, completed and failed, new links
    found, bytes stored.

    Each link of the table was queued once; it was taken unless it still waits. ``totals`` are the
    :func:`result_totals` that were observed as the results were written, so these are not read for them.
    ``links`` are the routable links per page, counted once per page as they are found.
    """
    queued = frontier.agg(
        F.count(F.lit(1)).alias("crawlq.put"),
        F.count_if(F.col("status") != WAITING).alias("crawlq.get"),
        F.count_if(F.col("status") == PROCESSING).alias("urls.processing"),
    )
    seen = frontier.sparkSession.createDataFrame(list(totals.items()), "counter STRING, value BIGINT")
    new = links.agg(F.count(F.lit(1)).alias("urls.new"))
    return _long(queued).unionByName(seen).unionByName(_long(new))


def _long(totals: DataFrame) -> DataFrame:
    return totals.unpivot([], [f"`{c}`" for c in totals.columns], "counter", "value")


def outcome_timing(samples: DataFrame, outcome: str, elapsed_ms: str, percentiles: tuple[float, ...] = ()) -> DataFrame:
    """Count, sum, mean, lower and upper of elapsed time per outcome.

    Sums are decimal, so the result does not depend on the order of rows. Percentiles come from
    mergeable sketches of bounded size, not from collected groups.
    """
    ms = F.col(elapsed_ms).cast("decimal(38,17)")
    aggs = [
        F.count(ms).alias("n"),
        F.sum(ms).cast("double").alias("sum_ms"),
        (F.sum(ms).cast("double") / F.count(ms)).alias("mean_ms"),
        F.min(elapsed_ms).alias("lower_ms"),
        F.max(elapsed_ms).alias("upper_ms"),
    ]
    for p in percentiles:
        aggs.append(F.percentile_approx(elapsed_ms, p, 10_000).alias(f"p{round(p * 100)}_ms"))
    return samples.groupBy(F.col(outcome).alias("outcome")).agg(*aggs)


def timing_batch(samples: DataFrame, outcome: str, elapsed_ms: str, k: int = 400) -> DataFrame:
    """A batch's samples as one small row per outcome: counts, sums, bounds and a quantile sketch, to be stored.

    ``k`` sets the sketch's size (some kilobytes) and its rank error (1.65 / k or so at 99 % confidence).
    """
    ms = F.col(elapsed_ms).cast("decimal(38,17)")
    return samples.groupBy(F.col(outcome).alias("outcome")).agg(
        F.count(ms).alias("n"),
        F.sum(ms).alias("sum_ms"),
        F.min(elapsed_ms).alias("lower_ms"),
        F.max(elapsed_ms).alias("upper_ms"),
        F.kll_sketch_agg_double(F.col(elapsed_ms).cast("double"), k).alias("sketch"),
    )


def merged_timing(batches: DataFrame, percentiles: tuple[float, ...] = (), k: int = 400) -> DataFrame:
    """:func:`outcome_timing` of all batches from their stored rows: no sample is read again."""
    merged = batches.groupBy("outcome").agg(
        F.sum("n").alias("n"),
        F.sum("sum_ms").cast("double").alias("sum_ms"),
        F.min("lower_ms").alias("lower_ms"),
        F.max("upper_ms").alias("upper_ms"),
        F.kll_merge_agg_double("sketch", k).alias("_sketch"),
    )
    quantiles = [F.kll_sketch_get_quantile_double("_sketch", F.lit(p)).alias(f"p{round(p * 100)}_ms") for p in percentiles]
    return merged.select("outcome", "n", "sum_ms", (F.col("sum_ms") / F.col("n")).alias("mean_ms"), "lower_ms", "upper_ms", *quantiles)
