import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from linkloom.llm import merkle

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, more=0):
    n = None if row["n_chars"] is None else row["n_chars"] + more
    values = [row["doc_id"], row["source"], row["lang"], n, row["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """The top of a list of digests, and the siblings of each, from the bottom up, with their sides."""
    at = [[i] for i in range(len(nodes))]
    siblings = [[] for _ in nodes]
    while len(nodes) > 1:
        pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        for k, members in enumerate(at):
            for m in members:
                other = nodes[k ^ 1] if k ^ 1 < len(nodes) else None
                siblings[m].append((k & 1, other))
        at = [sum(at[i : i + 2], []) for i in range(0, len(at), 2)]
        nodes = [sha("".join(p)) for p in pairs]
    return nodes[0], siblings


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, own = [], []
    for g in names:
        groups[g].sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
        top, siblings = climb([leaf for leaf, _ in groups[g]])
        tops.append(top)
        own.append(siblings)
    root, above = climb(tops)
    out = []
    for k, g in enumerate(names):
        for (leaf, r), siblings in zip(groups[g], own[k]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = leaf_of(r, int(hit))
            for side, other in siblings + above[k]:
                h = sha(h if other is None else other + h if side else h + other)
            proof = sha("".join(o for _, o in siblings + above[k] if o))
            out.append((r["doc_id"], leaf, tops[k], root, proof, h, h == root))
    return out


def keyed(rows):
    return sorted(map(tuple, rows), key=repr)


def test_against_plain_and_sql(docs):
    got = keyed(merkle.checked(docs).collect())
    assert got == keyed(plain([r.asDict() for r in docs.collect()]))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == keyed(con.sql(merkle.oracle()).fetchall())
    assert {r[-1] for r in got} == {True, False}


def test_odd(odd_docs, no_docs):
    rows = [r.asDict() for r in odd_docs.collect()]
    got = merkle.checked(odd_docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert keyed(got.collect()) == keyed(plain(rows))
    assert merkle.checked(no_docs).collect() == []
    one = odd_docs.where("doc_id = 5").limit(1)
    (row,) = merkle.checked(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")


@pytest.mark.parametrize("n", [255, 256, 257, 513])
def test_block_bounds(spark, n):
    """Groups that fill blocks, just miss them or just pass them; a tiny one beside; a repeated id."""
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    rows = rows.unionByName(spark.createDataFrame([(7, "de"), (7, "de"), (7, None)], "doc_id long, lang string"))
    docs = rows.select("doc_id", F.lit("s").alias("source"), "lang", F.lit(3).cast("long").alias("n_chars"), F.lit("abc").alias("text"))
    got = keyed(merkle.checked(docs.repartition(5)).collect())
    assert got == keyed(plain([r.asDict() for r in docs.collect()]))


def test_largest_counts(spark):
    """Counts that one more takes past 64 bits, null counts, empty texts."""
    docs = spark.range(100).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 3).cast("string").alias("lang"),
        F.when(F.col("id") % 5 > 0, F.lit((1 << 63) - 1) - F.col("id") % 2).alias("n_chars"), F.lit("").alias("text"),
    )
    want = keyed(plain([r.asDict() for r in docs.collect()]))
    assert keyed(merkle.checked(docs).collect()) == want


def test_other_changes_are_found(docs):
    rows = merkle.proofs(docs, {"text": F.upper("text")})
    found = rows.select((merkle.folded("changed") == F.col("root")).alias("same"), (F.col("changed") == F.col("leaf")).alias("equal"))
    assert found.where("same <> equal").count() == 0 and found.where("NOT same").count() > 0
