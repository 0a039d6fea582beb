"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` picks the tables, ``BENCH_CPUS`` the local cores. Each query is run once to warm
up (the iterative and streaming ones are not) and once timed, every result row being built. The
``scaling`` part runs three queries over the pages repeated under other hosts' paths, to show
throughput where planning time no longer counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.plans import capture
from linkloom.plans import inputs as demo
from linkloom.queries import QUERIES
from linkloom.session import fresh_path, local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "40"))
ONCE = ["crawl_rounds", "stream_link_ingest", "stream_result_fanout"]
HEADLINE = [
    "url_parts", "canonicalize", "reject_reasons", "resolve_links", "route", "route_query_set", "page_title", "page_text",
    "page_links", "scoped_links", "field_rules", "record_json_lines", "routable_links", "source_link_counts", "outcomes",
    "result_split", "frontier_insert", "frontier_update", "frontier_delete", "frontier_claim", "status_counts_zero",
    "status_latest", "outcome_timing", "crawl_counters",
]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(spark: SparkSession, name: str) -> float:
    start = time.perf_counter()
    run(QUERIES[name](spark, SF_DIR))
    return round(time.perf_counter() - start, 3)


def scaling(spark: SparkSession) -> dict:
    """The pages ``COPIES`` times over, each copy under its own paths."""
    path = fresh_path(spark, "bench-pages")
    pages = demo.table(spark, SF_DIR, "pages")
    each = pages.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    each.select(
        "page_id",
        F.regexp_replace("url", "(example[.][a-z]+)/", F.concat(F.lit("$1/c"), F.col("copy"), F.lit("/"))).alias("url"),
        "html",
    ).repartition(int(CPUS) * 4).write.parquet(path)
    registry = demo.demo_registry(spark, SF_DIR)
    captured = (
        spark.read.parquet(path)
        .withColumns({"final_url": F.col("url"), "status": F.lit(200), "location": F.lit(None).cast("string")})
    )
    rows = captured.count()
    out = {}
    for name, job in {
        "page_records": lambda: capture.page_results(captured, registry).select("url", "record"),
        "page_links": lambda: capture.result_links(capture.page_results(captured, registry), registry),
        "link_graph": lambda: capture.link_graph(capture.page_results(captured, registry), registry),
    }.items():
        run(job())
        start = time.perf_counter()
        run(job())
        sec = time.perf_counter() - start
        out[name] = {"pages": rows, "sec": round(sec, 3), "pages_per_sec": round(rows / sec)}
    return out


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    queries = {}
    for name in HEADLINE:
        timed(spark, name)
        queries[name] = timed(spark, name)
    for name in ONCE:
        queries[name] = timed(spark, name)
    result = {
        "metric": "headline_query_seconds",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "scaling": scaling(spark),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
