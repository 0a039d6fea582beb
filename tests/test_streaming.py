"""Streams give what the batch operators give, replays included."""

from pyspark.sql import functions as F

from linkloom.operators import frontier as fr
from linkloom.plans import inputs as demo
from linkloom.session import fresh_path
from linkloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def staged(spark, df, label, files=4):
    """A table as the files of a stream, two files a batch."""
    path = fresh_path(spark, f"source-{label}")
    df.repartition(files).write.parquet(path)
    return jobs.stream_files(spark, path, df.schema, files_per_batch=2)


def test_link_ingest_equals_insert(spark):
    have = demo.frontier(spark, SF)
    new = spark.range(400).select(F.concat(F.lit("http://new/"), F.col("id") % 130).alias("link")).union(have.select("link"))
    got = jobs.run_link_ingest(spark, staged(spark, new, "t"), have)
    want = fr.insert(have, new).select("link", "status")
    assert sorted(got.collect()) == sorted(want.collect())


def test_replayed_batch_changes_nothing(spark):
    path = fresh_path(spark, "replay")
    jobs.write_batch(fr.empty_frontier(spark), path, jobs.INITIAL)
    links = lambda *v: spark.createDataFrame([(x,) for x in v], "link STRING")
    captured = []

    class Writer:
        def foreachBatch(self, fn):
            captured.append(fn)

    class Stream:
        writeStream = Writer()

    jobs.link_ingest(Stream(), path)
    absorb = captured[0]
    absorb(links("a", "b"), 0)
    absorb(links("b", "c"), 1)
    before = sorted(jobs.batch_table(spark, path, jobs.LINK_BATCH).collect())
    absorb(links("b", "c"), 1)
    assert sorted(jobs.batch_table(spark, path, jobs.LINK_BATCH).collect()) == before
    assert sorted(r["link"] for r in before) == ["a", "b", "c"]


def test_status_update_takes_the_last_by_sequence(spark):
    log = spark.range(300).select(
        (F.col("id") % 11).cast("string").alias("link"),
        F.when(F.col("id") % 2 == 0, "completed").otherwise("failed").alias("status"),
        ((F.col("id") * 37) % 300).alias("seq"),
    )
    got = jobs.run_status_update(spark, staged(spark, log, "s"), ("seq",))
    assert sorted(got.collect()) == sorted(fr.latest_status(log).collect())


def test_gauge_equals_counts(spark):
    have = demo.frontier(spark, SF)
    got = jobs.run_status_gauge(spark, staged(spark, have, "g"))
    assert sorted(got.collect()) == sorted(fr.status_counts(have).collect())


def test_gauge_counts_a_changed_link_once_and_shows_zeros(spark):
    log = spark.createDataFrame(
        [("a", "waiting", 0), ("a", "processing", 1), ("a", "completed", 2), ("b", "waiting", 0)],
        "link STRING, status STRING, seq INT",
    )
    got = {r["status"]: r["n"] for r in jobs.run_status_gauge(spark, staged(spark, log, "g"), ("seq",)).collect()}
    assert got == {"waiting": 1, "processing": 0, "completed": 1, "failed": 0}


def test_live_frontier_and_its_compaction(spark):
    links, statuses, compacted = (fresh_path(spark, n) for n in ("links", "statuses", "compacted"))
    row = lambda schema, *v: spark.createDataFrame(list(v), schema)
    jobs.write_batch(row(fr.LINKS_SCHEMA, ("a", "waiting", 0), ("b", "waiting", 0)), links, 0)
    jobs.write_batch(row(fr.LINKS_SCHEMA, ("c", "waiting", 1)), links, 1)
    log = "link STRING, status STRING, seq INT"
    jobs.write_batch(row(log, ("a", "processing", 1), ("c", "failed", 5), ("gone", "failed", 1)), statuses, 0)
    jobs.write_batch(row(log, ("a", "completed", 2), ("c", "processing", 4)), statuses, 1)
    want = [("a", "completed", 0), ("b", "waiting", 0), ("c", "failed", 1)]
    assert sorted(tuple(r) for r in jobs.live_frontier(spark, links, statuses).collect()) == want
    jobs.compact_links(spark, links, statuses, compacted)
    assert sorted(tuple(r)[:3] for r in jobs.batch_table(spark, compacted, jobs.LINK_BATCH).collect()) == want
    gauge = {r["status"]: r["n"] for r in fr.status_counts_zero(jobs.live_frontier(spark, links, statuses)).collect()}
    assert gauge == {"waiting": 1, "processing": 0, "completed": 1, "failed": 1}


def test_a_batch_is_looked_for_in_place(spark):
    """The table is not shuffled, and not read but for its links; past the bounds the result is the same."""
    path = fresh_path(spark, "seen")
    have = spark.range(5000).select(F.concat(F.lit("http://h/"), F.col("id")).alias("link"), F.lit("waiting").alias("status"))
    have.write.parquet(path)
    seen = spark.read.parquet(path)
    batch = spark.createDataFrame([("http://h/7",), ("http://n/1",), ("http://n/1",), (None,)], "link STRING")
    new = fr.unseen_by_batch(seen, batch)
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert [r.link for r in new.collect()] == ["http://n/1"]
    scans = [line for line in plan.splitlines() if path.rsplit("/", 1)[-1][:12] in line and "ReadSchema" in line]
    assert scans and all("ReadSchema: struct<link:string>" in line for line in scans)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert [r.link for r in fr.unseen_by_batch(seen, batch, max_rows=0).collect()] == ["http://n/1"]
