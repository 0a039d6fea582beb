import numpy as np

from linkloom.llm import pivots

SF = "/root/testdata/sf0.01"


def brute(ids, vectors):
    unit = np.array(vectors, np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.array(ids)
    while True:
        low = np.minimum(label, np.where(near, label[None, :], label.max() + 1).min(axis=1))
        if (low == label).all():
            return near.sum(axis=1), label
        label = low


def check(got, ids, vectors, recall=0.9):
    links, label = brute(ids, vectors)
    got = {r.vec_id: r for r in got}
    n = np.array([got[i].n_links for i in ids])
    assert (n <= links).all() and n.sum() >= recall * links.sum()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    if n.sum() == links.sum():
        assert [got[i].component_id for i in ids] == label.tolist()


def test_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    check(pivots.near_duplicates(df).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 0.99)


def test_recall_at_the_threshold(spark):
    """Pairs at cosines from 0.9 up, and one dense group over several tiles."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 32))
    side = rng.normal(size=base.shape)
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    side -= (side * unit).sum(axis=1)[:, None] * unit
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.901, 1, 300)[:, None]
    vectors = np.concatenate([unit, cosine * unit + np.sqrt(1 - cosine**2) * side, unit[:1] + 0.01 * rng.normal(size=(120, 32))])
    data = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    check(pivots.near_duplicates(df, n_pivots=64, tile=25).collect(), list(range(len(data))), vectors)


def test_odd(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 0.0], [2.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0]]
    bad = [None, [], [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [1.0], [-0.0, 0.0]]
    data = [(i, v, None, "x", "y") for i, v in enumerate(good + bad)] + [(4, [1.0, 0.0], 1, "x", "y"), (None, [0.0, 1.0], 1, "x", "y")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int, class string, list string")
    got = pivots.near_duplicates(df).collect()
    assert len(got) == len(data)
    by_id = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by_id[0] == (5, 0, True) and by_id[1] == (5, 0, False) and by_id[4] == (5, 0, False)
    assert by_id[3] == (1, 3, True) and by_id[None] == (1, 3, False)
    assert all(by_id[i] == (0, i, True) for i in range(6, 14))
    assert pivots.near_duplicates(df.limit(0)).collect() == []
    assert len(pivots.near_duplicates(df.where("vec_id = 6")).collect()) == 1
