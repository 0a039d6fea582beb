"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child draws ``-ln(u) / weight``, with ``u`` hashed from the id and the child's path,
and the least draw wins; a document descends from the root to a shard. A child whose weight grows only
attracts, one whose weight shrinks only gives, and below a node whose children keep their weights
nothing moves: movement stays within subtrees whose weights change. A new shard comes as a branch of its
own (``grown``), so it takes rows only into itself. The law is ``key``: id and tree decide.

Slots number a shard's rows by id from 0: rows are range-sorted by shard and id over all partitions and
numbered from one total per partition, so no shard is gathered in one task.

Null texts have no bytes; null ids draw like an empty string and come first. Repeated rows share a
shard and get slots of their own. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import in_order, part_offsets, written

LAW = "key"
OVERHEAD = 16
Tree = list  # regions, each a list of racks, each a list of shard weights


def even_tree(regions: int = 2, racks: int = 4, shards: int = 5) -> Tree:
    return [[[1.0] * shards for _ in range(racks)] for _ in range(regions)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, on a branch of its own."""
    return [*tree, [[weight]]]


def _weight(node) -> float:
    return float(node) if isinstance(node, (int, float)) else sum(map(_weight, node))


def _descend(children: str, path: str) -> str:
    """Spark SQL: the number of the child with the least draw; ``children`` is an array of their weights."""
    digest = f"substring(md5(concat(coalesce(cast(doc_id as string), ''), '/', {path}, i)), 1, 13)"
    draw = f"-ln((cast(conv({digest}, 16, 10) as bigint) + 0.5D) / {1 << 52}D) / w"
    return f"array_min(transform({children}, (w, i) -> struct({draw} AS draw, i AS i))).i"


def with_shard(docs: DataFrame, tree: Tree, out: str) -> DataFrame:
    """Adds the shard number of ``doc_id``; shards are numbered in tree order."""
    first, numbers = 0, []
    for racks in tree:
        numbers.append([])
        for shards in racks:
            numbers[-1].append(first)
            first += len(shards)

    def fixed(value, kind: str) -> str:
        return f"from_json('{json.dumps(value)}', '{kind}')"

    regions = fixed([_weight(r) for r in tree], "array<double>")
    racks = fixed([[_weight(k) for k in r] for r in tree], "array<array<double>>")
    shards = fixed([[list(map(float, k)) for k in r] for r in tree], "array<array<array<double>>>")
    start = fixed(numbers, "array<array<int>>")
    step = docs.withColumn("_region", F.expr(_descend(regions, "''")))
    step = step.withColumn("_rack", F.expr(_descend(f"{racks}[_region]", "_region, '.'")))
    leaf = _descend(f"{shards}[_region][_rack]", "_region, '.', _rack, '.'")
    return step.withColumn(out, F.expr(f"{start}[_region][_rack] + {leaf}")).drop("_region", "_rack")


def assign(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row."""
    tree = tree or even_tree()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit(LAW).alias("law"),
    )
    rows = with_shard(with_shard(rows, tree, "shard"), grown(tree), "grown_shard")
    placed = in_order(rows, ["shard", "doc_id"], "shards")
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = written(part_offsets(parts, "_n"), "shard-parts")  # one row per partition
    numbered = placed.join(F.broadcast(before), "_part").withColumn("_place", F.col("_before") + F.col("_row"))
    firsts = numbered.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row per shard
    out = numbered.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_place") - F.col("_first"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
