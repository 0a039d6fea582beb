"""The pipeline's stages against brute force on what each was given."""

from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from linkloom.llm import mixing, toxicity
from linkloom.llm.common import written
from linkloom.llm.queries import ORACLES, QUERIES

from .test_simhash import plain_groups, plain_print

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    given, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, given, SF), "test-stage")
        seen.append((name, given, out))
        given = out
    assert [n for n, _, _ in seen] == ["toxicity", "simhash near-dedup", "mixing", "packing"]
    assert all(out.schema == docs.schema for _, _, out in seen[:3])

    def rows(df):
        return {r.doc_id: r for r in df.collect()}

    (_, a, b), (_, _, c), (_, _, d), (_, _, e) = seen
    model = toxicity.fit(docs, labels)
    assert set(rows(b)) == {i for i, r in rows(a).items() if model.score(r.text) < 0.5}
    own = sorted(rows(b).items())
    group = plain_groups([plain_print(r.text) for _, r in own])
    assert set(rows(c)) == {own[g][0] for g in group}
    chosen = {r.doc_id for r in mixing.drawn(c).where("_draw < _probability").select("_doc.doc_id").collect()}
    assert set(rows(d)) == chosen
    assert {r.doc_id for r in e.collect()} == chosen
    final = corpus_pipeline.run(spark, SF)
    assert Counter(map(tuple, final.collect())) == Counter(map(tuple, e.collect()))


def test_registered():
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_odd(spark, odd_docs, no_docs):
    for df in (odd_docs, no_docs):
        given = df
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, given, SF), "test-stage")
            assert out.columns == df.columns or name == "packing"
            given = out
    assert given.count() == 0
