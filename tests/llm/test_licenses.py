import duckdb

from linkloom.llm import licenses

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark, docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = licenses.scan(docs)
    names = got.columns
    sql = con.sql(licenses.oracle())
    assert sorted(sql.columns) == sorted(names)
    want = sorted(repr(tuple(r[sql.columns.index(c)] for c in names)) for r in sql.fetchall())
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_planted(spark):
    filler = " ".join(f"word{i}" for i in range(200))
    texts = [
        f"{filler} Permission is hereby granted, free of charge, to any person obtaining a copy {filler}",
        f"{filler} Permission is granted, free of charge, to a person obtaining any copy {filler}",
        f"{filler} permission charge {filler} person copy obtaining any hereby",
        "The MIT-License\nand the Apache license; General (public) LICENSE. mit license",
        "mit. licenses",
        "All Rights\tReserved",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].labels for i in range(6)] == ["mit-terms", "mit-terms", "", "apache,gpl,mit", "", "all-rights-reserved"]
    assert got[0].score == 1.0 and 0.8 <= got[1].score < 1 and got[2].score == 0
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].n_words) == (4, 1, 10, 12)
    assert got[4].first_word is None and got[4].base_labels == ""


def test_odd(odd_docs, no_docs):
    got = licenses.scan(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got}
    assert (by_id[0].n_words, by_id[0].score, by_id[0].labels) == (0, 0.0, "")
    assert by_id[8].base_labels == "mit" and by_id[8].first_word == 0 and by_id[9].n_words == 60_000
    assert licenses.scan(no_docs).collect() == []
