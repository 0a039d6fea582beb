import duckdb
import pytest
from pyspark.sql import functions as F

from linkloom.llm import mixing
from linkloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["op5_mixing"](spark, SF)
    sql = con.sql(ORACLES["op5_mixing"])
    at = [sql.columns.index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in sql.fetchall())


def test_marginals_are_met(spark):
    rows = [("a", "x", "t", 600.0), ("a", "y", "u", 200.0), ("b", "x", "u", 100.0), ("b", "y", "t", 100.0)]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, observed double")
    got = mixing.rake(cells, keep=0.3, temper=0.5, rounds=40, shares={"lang": {"x": 0.5, "y": 0.5}}).collect()
    by = {}
    for r in got:
        assert 0 <= r.fitted <= r.observed
        for d in ("_source", "_lang", "_topic"):
            by[d, r[d]] = by.get((d, r[d]), 0) + r.fitted
    a = 0.8**0.5 / (0.8**0.5 + 0.2**0.5)
    t = 0.7**0.5 / (0.7**0.5 + 0.3**0.5)
    assert by["_source", "a"] == pytest.approx(300 * a, rel=1e-4) and by["_lang", "x"] == pytest.approx(150, rel=1e-4)
    assert by["_topic", "t"] == pytest.approx(300 * t, rel=1e-4)


def test_sample_follows_the_probabilities(spark):
    text = F.concat(F.lit("some words "), F.when(F.col("id") % 5 == 0, "license").otherwise("here"))
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("source")
    )
    drawn = mixing.drawn(docs).agg(F.sum("_probability"), F.sum(F.col("_kept").cast("int")), F.count("*")).first()
    assert abs(drawn[0] - drawn[1]) < 4 * drawn[0] ** 0.5 and drawn[2] == 4000
    assert mixing.sample(docs).count() == drawn[1]


def test_odd(odd_docs, no_docs):
    got = mixing.drawn(odd_docs)
    assert got.count() == odd_docs.count()
    assert got.where("_probability is null or _probability < 0 or _probability > 1").count() == 0
    assert mixing.sample(odd_docs).columns == odd_docs.columns
    kept = [r.doc_id for r in mixing.sample(odd_docs).collect()]
    assert kept.count(5) in (0, 3)  # repeated rows share a draw
    assert mixing.sample(no_docs).collect() == []


def test_table_without_words_is_kept_whole(spark, collect):
    docs = spark.createDataFrame([(1, None, "en", "s"), (2, "", "de", "s"), (2, " ", "de", None)], "doc_id long, text string, lang string, source string")
    rows = collect(mixing.drawn(docs))
    assert len(rows) == 3 and all(r["_kept"] and r["_probability"] == 1 for r in rows)
    assert mixing.sample(docs).count() == 3


def test_report_tells_targets_that_cannot_be_met(docs):
    fitted = mixing.rake(mixing.cells(docs), rounds=30)
    for r in mixing.report(fitted).collect():
        assert r.reached <= r.available + 1e-6
    wanted = {d.dimension for d in mixing.report(fitted).collect()}
    assert wanted == set(mixing.DIMENSIONS)
    shares = {"lang": {"en": 1e-9}}  # all tokens are wanted of the others, more than they have
    short = [r for r in mixing.report(mixing.rake(mixing.cells(docs), shares=shares, rounds=8), shares=shares).collect() if r.dimension == "lang" and r.target > r.available]
    assert short and all(r.value != "en" for r in short)
