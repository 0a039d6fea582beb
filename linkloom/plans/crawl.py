"""Frontier expansion: claim waiting links, look their pages up, settle them, queue what is new.

Pages are read and extracted once, before the first round; the rounds work on narrow tables only.
Three tables are kept in the shared folder, bucketed by link into as many buckets as a shuffle has
partitions:

* ``graph``    one row per captured URL: success and distinct outlinks
* ``seen``     every link ever queued, appended per round
* ``settled``  every link taken, with its final status, appended per round

``seen`` and ``settled`` are also partitioned by round, so a round reads its own wave and not the whole
table. A round joins its wave to the graph bucket by bucket, with the wave as the hashed side: the graph
is neither shuffled nor sorted. Its found links are reduced map-side, shuffled once for their distinct
and hashed against ``seen`` in place, which is not sorted either. A hashed side is one bucket of narrow
rows; raise the shuffle partitions with the number of links. Each round ends in
written tables, so lineage stays one round deep and a lost executor costs one task. No round
rewrites what an earlier one wrote, whatever the size of the seen set.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators import frontier as fr
from linkloom.plans.capture import NOT_CAPTURED, status_of
from linkloom.session import fresh_path


class _Store:
    """Bucketed tables of one crawl under one path."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = fresh_path(spark, "crawl")
        self.id = uuid.uuid4().hex[:12]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.made: set[str] = set()

    def name(self, table: str) -> str:
        return f"linkloom_{table}_{self.id}"

    def append(self, table: str, df: DataFrame, key: str, by: str | None = None) -> None:
        writer = df.write.format("parquet").mode("append").option("path", f"{self.path}/{table}")
        writer = writer.partitionBy(by) if by else writer
        writer.bucketBy(self.buckets, key).saveAsTable(self.name(table))
        self.made.add(table)

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def files(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    def forget(self) -> None:
        """Drops the catalog entries; the files stay for the tables handed out."""
        for table in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")


@dataclass(frozen=True)
class Crawl:
    """``frontier(link, status, round)`` after the last round, and ``log(link, status, error,
    found_round, taken_round)`` of every link taken."""

    frontier: DataFrame
    log: DataFrame
    rounds: int
    path: str


def crawl(
    seeds: DataFrame,
    graph: DataFrame,
    max_rounds: int | None = None,
    claim: int = -1,
    on_round=None,
) -> Crawl:
    """Expands ``seeds(link)`` over ``graph`` (see ``capture.link_graph``) until nothing waits.

    ``claim`` bounds the links taken per round (-1: all that wait). Failed links are final. A link
    that is not in the graph fails as ``not_captured``. ``on_round(round, store)`` is called after each.
    """
    spark = seeds.sparkSession
    store = _Store(spark)
    store.append("graph", graph.select("url", "success", "error", "links"), "url")
    start = seeds.select("link").where(F.col("link").isNotNull()).distinct().withColumn("found_round", F.lit(0))
    store.append("seen", start, "link", "found_round")

    done = 0
    while max_rounds is None or done < max_rounds:
        wave = _wave(store, done, claim).hint("shuffle_hash")
        hits = wave.join(store.table("graph"), wave["link"] == F.col("url"), "left").select(
            "link",
            F.coalesce("success", F.lit(False)).alias("success"),
            F.when(F.col("url").isNull(), F.lit(NOT_CAPTURED)).otherwise(F.col("error")).alias("error"),
            "found_round",
            F.lit(done + 1).alias("taken_round"),
            F.when(F.col("success"), F.col("links")).alias("links"),
        )
        store.append("settled", hits, "link", "taken_round")
        taken = store.table("settled").where(F.col("taken_round") == done + 1)
        if taken.isEmpty():
            break
        done += 1
        found = taken.select(F.explode("links").alias("link")).distinct()
        # An anti-join would have to hash or sort all of "seen"; this way round only the find is hashed.
        seen = store.table("seen").select(F.col("link").alias("_seen"))
        new = seen.join(found.hint("shuffle_hash"), F.col("_seen") == F.col("link"), "right").where(F.col("_seen").isNull())
        store.append("seen", new.select("link", F.lit(done).alias("found_round")), "link", "found_round")
        if on_round is not None:
            on_round(done, store)

    seen, settled = store.files("seen"), store.files("settled")
    log = settled.select(
        "link", status_of(F.col("success")).alias("status"), "error", "found_round", "taken_round"
    )
    waiting = seen.join(settled.select("link"), "link", "left_anti").select(
        "link", F.lit(fr.WAITING).alias("status"), F.col("found_round").alias("round")
    )
    final = log.select("link", "status", F.col("found_round").alias("round")).unionByName(waiting)
    store.forget()
    return Crawl(final, log, done, store.path)


def _wave(store: _Store, done: int, claim: int) -> DataFrame:
    """Links to take next: all that wait, or the first ``claim`` by round and link."""
    seen = store.table("seen")
    if claim == -1:
        # Every earlier wave was taken whole, so what waits is exactly the last round's find.
        return seen.where(F.col("found_round") == done)
    if "settled" in store.made:
        seen = seen.join(store.table("settled").select("link"), "link", "left_anti")
    waiting = seen.select("link", F.lit(fr.WAITING).alias("status"), F.col("found_round").alias("round"))
    return fr.take(waiting, fr.WAITING, claim).select("link", F.col("round").alias("found_round"))
