import hashlib
import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from linkloom.llm import sharding


def plain_shard(doc_id, tree):
    """Descends by the least draw, one document at a time."""
    text, path, node, first = "" if doc_id is None else str(doc_id), "", tree, 0
    while isinstance(node, list):
        draws = []
        for i, child in enumerate(node):
            u = (int(hashlib.md5(f"{text}/{path}{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            draws.append((-math.log(u) / sharding._weight(child), i))
        pick = min(draws)[1]
        first += sum(len_leaves(c) for c in node[:pick])
        path, node = f"{path}{pick}.", node[pick]
    return first


def len_leaves(node):
    return sum(map(len_leaves, node)) if isinstance(node, list) else 1


def check(df, rows):
    tree = sharding.even_tree()
    got = sharding.assign(df).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r.shard == plain_shard(r.doc_id, tree) and r.grown_shard == plain_shard(r.doc_id, sharding.grown(tree))
        assert r.grown_shard in (r.shard, 40) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want


def test_against_plain(docs):
    check(docs, docs.collect())


def test_odd(odd_docs, no_docs):
    check(odd_docs, odd_docs.collect())
    assert sharding.assign(no_docs).collect() == []


def moves(spark, old, new):
    ids = spark.range(3000).withColumnRenamed("id", "doc_id")
    both = sharding.with_shard(sharding.with_shard(ids, old, "a"), new, "b")
    return {(r.a, r.b): r.n for r in both.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n")).collect()}


def test_movement_stays_where_weights_change(spark):
    old = [[[1, 1], [1, 1]], [[1, 1], [1, 1]]]
    assert moves(spark, old, old) == {}
    within = moves(spark, old, [[[1, 1], [1.5, 0.5]], [[1, 1], [1, 1]]])  # the rack's total stays
    assert set(within) == {(3, 2)}
    racks = moves(spark, old, [[[1, 1], [1, 1]], [[1.5, 1.5], [0.5, 0.5]]])  # the region's total stays
    assert racks and all(a >= 6 and b in (4, 5) for a, b in racks)
    regions = moves(spark, old, [[[2, 2], [2, 2]], [[1, 1], [1, 1]]])
    assert regions and all(a >= 4 and b < 4 for a, b in regions)


def test_weights_are_followed(spark):
    ids = spark.range(6000).withColumnRenamed("id", "doc_id")
    tree = [[[3, 1]], [[2]]]
    n = {r.s: r.n for r in sharding.with_shard(ids, tree, "s").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert abs(n[0] - 3000) < 250 and abs(n[1] - 1000) < 250 and abs(n[2] - 2000) < 250
