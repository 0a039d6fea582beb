import random

from linkloom.llm.common import components


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(300, 360)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    other = [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    edges = chain + star + other + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    alone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in root if x not in alone}
    assert components(spark.createDataFrame([], "a long, b long"), "test").collect() == []
