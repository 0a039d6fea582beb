"""Embedding near-duplicates: a pivot-permutation index, retrieved by shared-pivot counts and verified.

Up to ``n_pivots`` reference points are taken, farthest first, from a sample of ``SAMPLE`` times as many
vectors (those of the smallest hash); all vectors are indexed. Each is described by its ``nearest``
reference points in order and listed under every choice of ``shared`` of them, so two vectors that share
at least that many meet in an inverted list. A pair counts in the first list that the two share. Cosines
are verified in double precision.

Equal vectors are one class and make no pairs. Lists of one class are dropped before vectors move. A
longer list is cut into tiles of ``TILE`` members, each pair of tiles a task's work of bounded size:
tiles are multiplied as blocks, and what leaves is each member's number of links and a spanning forest,
never all pairs. Links are joined to groups by star contraction over written tables.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
vectors of another length than the reference points (the most frequent length). Repeated rows are
copies of one class, each counted. Components are named by their smallest ``vec_id``; null ids are
counted as vectors but name nothing. An empty table gives no rows. Labels are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import components, written

TILE = 1024
SAMPLE = 8  # vectors looked at for each reference point


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Unit rows in double precision."""
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _can_link():
    """Whether ``embedding`` is a vector that can link: never null."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: F.coalesce(x, F.lit(0.0)) != 0)
    return F.coalesce(F.col("embedding").isNotNull() & ~bad & some, F.lit(False))


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the one least like those taken before: a dense group does not fill the reference points."""
    taken, closest = [0], sample @ sample[0]
    while len(taken) < min(n, len(sample)):
        nxt = int(np.argmin(closest))
        if closest[nxt] > 1 - 1e-9:
            break
        taken.append(nxt)
        closest = np.maximum(closest, sample @ sample[nxt])
    return sample[taken]


def describe(classes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """``class, pivots``: the numbers of the nearest reference points, nearest first."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # n_pivots rows at most

    def run(batches):
        points = shared.value
        for batch in batches:
            if batch.num_rows:
                likeness = _matrix(batch.column("embedding")) @ points.T
                order = np.argsort(-likeness, axis=1, kind="stable")[:, :nearest].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("class"), lists], ["class", "pivots"])

    return classes.select("class", "embedding").mapInArrow(run, "class long, pivots array<int>")


def _key(chosen: np.ndarray) -> np.ndarray:
    """One number for each row of ascending pivot numbers (below 2 ** 20)."""
    key = np.zeros(len(chosen), np.int64)
    for column in chosen.T:
        key = (key << 20) | (column + 1)
    return key


def _own_keys(lists: pa.ListArray, shared: int) -> np.ndarray:
    """Per row the ascending keys of all choices of ``shared`` pivots."""
    own = np.sort(lists.flatten().to_numpy().reshape(len(lists), -1), axis=1)
    picks = list(combinations(range(own.shape[1]), shared))
    return np.sort(np.stack([_key(own[:, list(p)]) for p in picks], axis=1), axis=1)


def _with_lists(described: DataFrame, shared: int) -> DataFrame:
    """``class, list``: one row per inverted list that a class stands in."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = _own_keys(batch.column("pivots"), shared)
                owner = np.repeat(np.arange(len(keys)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("class").take(pa.array(owner)), pa.array(keys.ravel())], ["class", "list"])

    return described.mapInArrow(run, "class long, list long")


def _met(threshold: float, shared: int):
    """Rows ``(a, b, links)`` of tiles sorted by ``list, x, y``: links of a class counted here (b null), or a link of the forest."""

    def tile(rows: pa.Table):
        unit = _matrix(rows.column("embedding").combine_chunks())
        keys = _own_keys(rows.column("pivots").combine_chunks(), shared)
        this = rows.column("list")[0].as_py()
        ids, size = rows.column("class").to_numpy(), rows.column("size").to_numpy()
        side = rows.column("side").to_numpy()
        x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
        left = np.flatnonzero(side == x)
        right = left if x == y else np.flatnonzero(side == y)
        links, root, out = np.zeros(len(ids), np.int64), np.arange(len(ids)), ([], [])

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for at in range(0, len(left), 256):
            rows_in = left[at : at + 256]
            near = unit[rows_in] @ unit[right].T >= threshold
            i, j = np.nonzero(near)
            i, j = rows_in[i], right[j]
            if x == y:
                i, j = i[i < j], j[i < j]
            first = np.ones(len(i), bool)  # is this the first list that the two share?
            for k in range(keys.shape[1]):
                own = keys[i, k]
                seen = (keys[j] == own[:, None]).any(axis=1) & (own < this)
                first &= ~seen
            i, j = i[first], j[first]
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            for a, b in zip(i.tolist(), j.tolist()):
                p, q = find(a), find(b)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out[0].append(ids[a])
                    out[1].append(ids[b])
        some = np.flatnonzero(links)
        a = np.concatenate([ids[some], np.array(out[0], np.int64)])
        b = pa.array([None] * len(some) + [int(v) for v in out[1]], pa.int64())
        n = np.concatenate([links[some], np.zeros(len(out[0]), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], ["a", "b", "links"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if not len(held):
                continue
            key = np.stack([held.column(c).to_numpy() for c in ("list", "x", "y")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if b - a > 1:
                    yield tile(held.slice(a, b - a))
            held = held.slice(int(starts[-1]))
        if held is not None and len(held) > 1:
            yield tile(held)

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, n_pivots: int = 256, nearest: int = 7, shared: int = 2, tile: int = TILE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = own.where(_can_link())
    widths = good.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 0
    good = good.where(F.size("embedding") == width)
    equal = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = written(equal.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    points = classes.select("embedding").orderBy(F.xxhash64("embedding"), "class").limit(SAMPLE * n_pivots).toArrow()
    if len(points):
        pivots = spread(_matrix(points.column("embedding").combine_chunks()), n_pivots)
        nearest, shared = min(nearest, len(pivots)), min(shared, len(pivots))
        described = written(describe(classes, pivots, nearest), "vector-pivots")
        lists = written(_with_lists(described, shared), "pivot-lists")
        long = lists.groupBy("list").agg(F.count("*").alias("n")).where("n > 1")
        tiles = F.ceil(F.col("n") / tile).cast("int")
        # A member of tile s meets every tile: it goes to (s, y) for y >= s and to (x, s) for x < s.
        placed = lists.join(long, "list").withColumn("tiles", tiles).withColumn("side", F.expr("cast(pmod(class, tiles) as int)"))
        dealt = placed.select(
            "list", "class", "side", F.expr("explode(sequence(0, tiles - 1))").alias("other")
        ).select("list", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "class", "side")
        full = classes.select("class", "embedding", "size").join(described, "class")
        met = dealt.join(full, "class").repartition("list", "x", "y").sortWithinPartitions("list", "x", "y")
        columns = ["list", "x", "y", "side", "class", "size", "embedding", "pivots"]
        met = written(met.select(*columns).mapInArrow(_met(threshold, shared), "a long, b long, links long"), "vector-links")
        counts = met.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
        roots = components(met.where("b is not null").select("a", "b"), "vector-groups").withColumnRenamed("node", "class")
    else:
        empty = classes.select("class", F.lit(0).cast("long").alias("links"), F.col("class").alias("root"))
        counts, roots = empty.select("class", "links"), empty.select("class", "root")
    rooted = classes.select("class", "least", "size").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(names, "root").join(counts, "class", "left").select(
        "class", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
    )
    linked = good.join(classes.select("embedding", "class"), "embedding").join(known, "class").select("vec_id", "n_links", "component_id")
    other = own.where(~(_can_link() & (F.coalesce(F.size("embedding"), F.lit(-1)) == width)))
    rest = other.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

