"""Tables in and out."""

from pathlib import Path

from pyspark.sql import functions as F

from linkloom.functions.records import record_bytes
from linkloom.operators import frontier as fr
from linkloom.sources import captures, records, snapshots


def test_snapshots_replace_each_other_and_keep_history(spark, tmp_path):
    root = str(tmp_path)
    assert snapshots.read_links(spark, root).count() == 0
    new = spark.createDataFrame([("a",), ("b",)], "link STRING")
    assert snapshots.write_snapshot(fr.insert(snapshots.read_links(spark, root), new), root) == 0
    assert snapshots.write_snapshot(fr.claim(snapshots.read_links(spark, root)), root) == 1
    assert {r["status"] for r in snapshots.read_links(spark, root).collect()} == {"processing"}
    assert {r["status"] for r in snapshots.read_links(spark, root, 0).collect()} == {"waiting"}


def test_unfinished_snapshot_is_not_seen(spark, tmp_path):
    root = str(tmp_path)
    links = spark.createDataFrame([("a", "waiting", 0)], fr.LINKS_SCHEMA)
    snapshots.write_snapshot(links, root)
    links.limit(0).write.parquet(f"{root}/links/snapshot=1")  # written, never pointed at
    assert snapshots.read_links(spark, root).count() == 1
    assert snapshots.write_snapshot(links, root) == 1


def test_record_lines_have_the_bytes_counted(spark, tmp_path):
    df = spark.createDataFrame([('{"a":"é"}',), ('{"a":"x"}',), (None,)], "record STRING")
    records.append_records(df, f"{tmp_path}/r")
    records.append_records(df, f"{tmp_path}/r")
    on_disk = sum(p.stat().st_size for p in Path(f"{tmp_path}/r").glob("*.txt"))
    assert on_disk == 2 * df.agg(F.sum(record_bytes(F.col("record")))).first()[0]
    assert sorted(r["a"] for r in records.read_records(spark, f"{tmp_path}/r", "a STRING").collect()) == ["x", "x", "é", "é"]


def test_captures_of_any_format_conform(spark, tmp_path):
    few = spark.createDataFrame([("http://h/", "<p>")], "url STRING, html STRING")
    few.write.parquet(f"{tmp_path}/p")
    few.write.orc(f"{tmp_path}/o")
    few.write.json(f"{tmp_path}/j")
    want = ("http://h/", "http://h/", "<p>")
    for fmt, folder in (("parquet", "p"), ("orc", "o"), ("json", "j")):
        row = captures.read_responses(spark, f"{tmp_path}/{folder}", fmt).first()
        assert (row["url"], row["final_url"], row["html"]) == want and row["location"] is None
