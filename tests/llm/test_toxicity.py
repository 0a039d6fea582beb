import zlib

import numpy as np

from linkloom.llm import toxicity

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    own = toxicity.training_rows(docs, labels, 50).collect()
    assert len(own) == 50 and not any(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in own)


def test_ngrams_are_distinct():
    a = toxicity.ngrams("Some text, some TEXT")
    assert len(a) == len(set(a.tolist())) and (a >= 0).all() and (a < 1 << toxicity.BITS).all()
    assert set(toxicity.ngrams("SOME TEXT").tolist()) == set(toxicity.ngrams("some text").tolist())
    assert len(toxicity.ngrams("")) == len(toxicity.ngrams(None)) == 0


def test_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(i, 1, int(i in (5, 7))) for i in range(9)] + [(None, 1, 1), (3, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int"
    )
    got = toxicity.scored(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()
    none = labels.limit(0)
    assert all(r.score < 1e-6 and r.predicted == 0 for r in toxicity.scored(odd_docs, none).collect())
    assert toxicity.scored(no_docs, labels).collect() == []
    one_class = toxicity.fit(odd_docs, labels.where("toxic = 0"))
    assert not one_class.weights.any() and one_class.score("x") < 0.5


def test_fit_is_linear_in_scaled_features():
    grams = [np.array([1, 2], np.int32), np.array([2, 3], np.int32)] * 20
    model = toxicity.fit_rows(grams, np.array([1, 0] * 20), steps=60)
    assert model.weights[1] > 0 > model.weights[3] and model.squares[2] < 1e-9


def test_null_ids_are_not_held_out(odd_docs, spark, collect):
    labels = spark.createDataFrame([(5, 1), (6, 0), (None, 1)], "doc_id long, toxic int")
    rows = collect(toxicity.scored(odd_docs, labels))
    assert all(r["held_out"] in (True, False) for r in rows)
    assert all(not r["held_out"] for r in rows if r["doc_id"] != r["doc_id"] or r["doc_id"] is None)


def test_bounds_of_the_fit(docs, spark):
    """Labels without a document take no place; texts past the bound of characters are left out."""
    labels = spark.range(1_000_000, 1_000_500).selectExpr("id AS doc_id", "1 AS toxic")
    own = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")
    got = toxicity.training_rows(docs, own.unionByName(labels), 40).collect()
    assert len(got) == 40
    few = toxicity.training_rows(docs, own, 40, max_chars=20_000).collect()
    assert 0 < len(few) < 40 and sum(len(r.text) for r in few) <= 20_000
