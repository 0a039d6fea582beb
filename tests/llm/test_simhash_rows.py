from linkloom.llm import simhash

A = "one two three four five six seven eight"
B = "alpha beta gamma delta epsilon zeta eta theta"
C = "red orange yellow green blue indigo violet black"


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return sorted(simhash.keep_one(df).collect(), key=str)


def test_one_id_on_different_texts(spark):
    """Each group keeps a row, though both are named by one id."""
    assert {(r.doc_id, r.text) for r in kept(spark, [(7, A, "x"), (7, B, "x"), (8, A, "x")])} == {(7, A), (7, B)}


def test_the_leader_is_of_its_own_group(spark):
    """Id 3 names the group of A; its row with text B is not kept in place of 2, which names B's."""
    assert [(r.doc_id, r.text) for r in kept(spark, [(3, A, "x"), (3, B, "x"), (2, B, "x")])] == [(2, B), (3, A)]


def test_null_ids_are_decided_too(spark):
    rows = [(None, A, "x"), (None, A, "y"), (None, A, "x"), (None, B, "x"), (5, B, "x"), (None, C, "x"), (None, C, "x")]
    got = kept(spark, rows)
    assert sorted(r.text for r in got) == sorted([A, B, C])
    assert [r.doc_id for r in got if r.text == B] == [5]


def test_the_same_row_each_time(spark):
    rows = [(1, A, c) for c in "pqrstuvw"]
    assert kept(spark, rows) == kept(spark, rows[::-1]) and len(kept(spark, rows)) == 1
