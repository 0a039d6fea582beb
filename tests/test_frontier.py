"""Link-table operators against a plain dictionary."""

from pyspark.sql import functions as F

from linkloom.operators import frontier as fr
from linkloom.operators import metrics


def table(spark, rows):
    return spark.createDataFrame(rows, fr.LINKS_SCHEMA)


def links(spark, values):
    return spark.createDataFrame([(v,) for v in values], "link STRING")


def state(df):
    rows = df.collect()
    got = {r["link"]: (r["status"], r["round"]) for r in rows}
    assert len(got) == len(rows), "a link is there twice"
    return got


BASE = [("a", "waiting", 0), ("b", "completed", 0), ("c", "failed", 1), ("d", "waiting", 1), ("e", "waiting", 0)]


def test_insert_keeps_what_is_there_and_is_idempotent(spark):
    t = table(spark, BASE)
    once = fr.insert(t, links(spark, ["b", "x", "x", "a", "y", None]), round_no=2)
    assert state(once) == {**{l: (s, r) for l, s, r in BASE}, "x": ("waiting", 2), "y": ("waiting", 2)}
    assert state(fr.insert(once, links(spark, ["x", "y"]), round_no=3)) == state(once)
    assert state(fr.insert(fr.empty_frontier(spark), links(spark, ["z"]))) == {"z": ("waiting", 0)}


def test_update_and_delete_ignore_unknown_links(spark):
    t = table(spark, BASE)
    new = spark.createDataFrame([("a", "completed"), ("nope", "failed")], "link STRING, status STRING")
    assert state(fr.update(t, new)) == {**{l: (s, r) for l, s, r in BASE}, "a": ("completed", 0)}
    assert set(state(fr.delete(t, links(spark, ["a", "a", "nope"])))) == set("bcde")


def test_take_first_and_claim(spark):
    t = table(spark, BASE)
    assert [r["link"] for r in fr.take(t, n=2).collect()] == ["a", "e"]
    assert {r["link"] for r in fr.take(t).collect()} == set("ade")
    assert fr.first(t).first()["link"] == "a" and fr.first(t, "processing").first() is None
    assert {l for l, (s, _) in state(fr.claim(t, 2)).items() if s == "processing"} == set("ae")
    assert {l for l, (s, _) in state(fr.claim(t)).items() if s == "processing"} == set("ade")


def test_take_by_whole_ranges_equals_one_task(spark):
    t = spark.range(0, 3000, 1, 7).select(
        F.concat(F.lit("l"), F.col("id")).alias("link"),
        F.when(F.col("id") % 5 == 0, "failed").otherwise("waiting").alias("status"),
        (F.col("id") % 4).cast("int").alias("round"),
    )
    for n in (0, 1, 777, 2400, 5000):
        assert sorted(fr.take(t, n=n, one_task=-1).collect()) == sorted(fr.take(t, n=n).collect())
    assert fr.take(fr.empty_frontier(spark), n=5, one_task=0).count() == 0


def test_counts_show_absent_and_unexpected_statuses(spark):
    t = table(spark, BASE + [("z", "odd", 0)])
    assert {r["status"]: r["n"] for r in fr.status_counts_zero(t).collect()} == {
        "waiting": 3, "processing": 0, "completed": 1, "failed": 1, "odd": 1
    }
    assert sum(r["n"] for r in fr.status_counts_zero(fr.empty_frontier(spark)).collect()) == 0


def test_latest_status_of_a_hot_link(spark):
    log = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 40)).alias("link"),
        F.when(F.col("id") % 2 == 0, "failed").otherwise("completed").alias("status"),
        ((F.col("id") * 7919) % 5000).alias("seq"),
    )
    want = {}
    for r in log.collect():
        want[r["link"]] = max(want.get(r["link"], (-1, "")), (r["seq"], r["status"]))
    assert {r["link"]: r["status"] for r in fr.latest_status(log).collect()} == {l: s for l, (_, s) in want.items()}


def test_timing_percentiles_stay_within_their_rank(spark):
    samples = spark.range(1, 100_001).select(F.lit("success").alias("outcome"), F.col("id").cast("double").alias("ms"))
    row = metrics.outcome_timing(samples, "outcome", "ms", percentiles=(0.5, 0.95)).first()
    assert row["n"] == 100_000 and row["mean_ms"] == 50_000.5
    assert abs(row["p50_ms"] - 50_000) <= 20 and abs(row["p95_ms"] - 95_000) <= 20


def test_update_with_a_repeated_link_keeps_one_row(spark):
    got = fr.update(table(spark, BASE), spark.createDataFrame([("a", "failed"), ("a", "completed")], "link STRING, status STRING"))
    assert state(got)["a"] == ("failed", 0)


def test_update_takes_the_last_status_by_sequence(spark):
    table = spark.createDataFrame([("a", "waiting", 0), ("b", "waiting", 0)], "link STRING, status STRING, round INT")
    log = spark.createDataFrame([("a", "completed", 1), ("a", "waiting", 2), ("b", "completed", 5), ("b", "processing", 4)], "link STRING, status STRING, seq INT")
    by_seq = {r.link: r.status for r in fr.update(table, log, ("seq",)).collect()}
    assert by_seq == {"a": "waiting", "b": "completed"}
    assert {r.link: r.status for r in fr.update(table, log).collect()} == {"a": "completed", "b": "completed"}
