"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint has 64 bits: bit ``i`` is set when more than half of the shingle hashes have it. Two
fingerprints at most ``max_bits`` bits apart differ in at most ``max_bits`` of their eight bytes, so
they agree in at least ``8 - max_bits`` byte positions. The index lists fingerprints under every
choice of that many positional bytes (for 4 bits: 70 lists each), so each pair that reaches the
minimum meets in a list; its shared bytes are tallied there, it counts in the first list that the
two share only, and its bit distance is verified.

Distinct fingerprints are indexed, not documents, so copies make no pairs. Lists are read as a sorted
stream. Short ones yield their verified pairs; longer ones a spanning forest of their links, at most
one row per member; and lists of more than ``LONG_LIST`` members are dealt out again by half-bytes of
what still differs, where a list holds at most 65,536 distinct values. Every link is thus followed,
and no list yields all its pairs. Links are joined to groups by star contraction over written tables.

Null and empty texts have fingerprint zero and link like any other. Repeated rows fall in one class.
An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not read. Components are
named by the smallest ``doc_id``; null ids count only where a component has no other. ``keep_one`` keeps
one row of every component, of null ids too.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import components, tidy, written

SHORT_LIST, LONG_LIST = 32, 8192
SALTS = 32


def simhash(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of one text: A-Z lowered, words between ASCII white space, XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every whole text."""

    def run(batches):
        for batch in batches:
            got = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(tidy(run), "doc_id long, fp long")


def _choices(unit: int, places: list[int], take: int) -> list[tuple[int, int]]:
    """``(mask, bit set of places)`` of every choice of ``take`` places of ``unit`` bits each."""
    out = []
    for chosen in combinations(places, take):
        mask = sum(((1 << unit) - 1) << (unit * p) for p in chosen)
        out.append((mask - (1 << 64) if mask >> 63 else mask, sum(1 << p for p in chosen)))
    return out


def _runs(batches, long_list: int | None):
    """``(rows, is_long)`` of a stream sorted by ``list`` columns: arrays that hold whole lists, or parts of a long one."""
    held, long_key = None, None
    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        if long_key is not None:
            more = int(np.argmax((rows[:, :2] != long_key).any(axis=1))) if (rows[-1, :2] != long_key).any() else len(rows)
            if more:
                yield rows[:more], True
            rows = rows[more:]
            if not len(rows):
                continue
            long_key = None
        if held is not None:
            rows = np.concatenate([held, rows])
        last = int(np.argmax((rows[:, :2] == rows[-1, :2]).all(axis=1)))
        if last:
            yield rows[:last], False
        held = rows[last:]
        if long_list and len(held) > long_list:
            yield held, True
            held, long_key = None, held[0, :2].copy()
    if held is not None:
        yield held, False


def _bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))


def _forest(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct ``values``: at most one link per value."""
    left, right, rest = [], [], values
    while len(rest) > 1:
        reached, rest = rest[:1], rest[1:]
        while len(reached) and len(rest):
            at, reached = reached[:256], reached[256:]
            near = _bits_apart(at[:, None], rest[None, :]) <= max_bits
            hit = near.any(axis=0)
            if hit.any():
                left.append(at[near[:, hit].argmax(axis=0)])
                right.append(rest[hit])
                reached, rest = np.concatenate([reached, rest[hit]]), rest[~hit]
    none = np.empty(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _compare(max_bits: int, firsts: np.ndarray | None, long_list: int | None):
    """Rows ``(a, b, overflow)`` of a stream of ``(choice, bits, fp)``: verified links, or members of long lists."""

    def run(batches):
        for rows, is_long in _runs(batches, long_list):
            if is_long:
                fp = rows[:, 2]
                yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(rows[:, 1]), pa.array(rows[:, 0])], ["a", "b", "overflow"])
                continue
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            starts = np.concatenate([[0], new])
            sizes = np.diff(np.append(starts, len(rows)))
            choice, fp = rows[:, 0], np.ascontiguousarray(rows[:, 2])
            a, b = [], []
            left = np.repeat(starts + sizes, sizes) - np.arange(len(rows)) - 1  # members after this one
            left[np.repeat(sizes > SHORT_LIST, sizes)] = 0
            at, step = np.flatnonzero(left), 1
            while len(at):
                x, y = fp[at], fp[at + step]
                near = _bits_apart(x, y) <= max_bits
                if firsts is not None:  # tally the equal bytes; the pair counts in its first list
                    equal = ((x ^ y).view(np.uint8).reshape(-1, 8) == 0) @ (1 << np.arange(8))
                    near &= firsts[equal] == choice[at]
                a.append(x[near])
                b.append(y[near])
                step += 1
                at = at[left[at] >= step]
            for k in np.flatnonzero(sizes > SHORT_LIST):
                x, y = _forest(fp[starts[k] : starts[k] + sizes[k]], max_bits)
                a.append(x)
                b.append(y)
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.full(len(x), -1))], ["a", "b", "overflow"])

    return run


def links(distinct: DataFrame, max_bits: int = 4, long_list: int = LONG_LIST) -> DataFrame:
    """``a, b``: links among distinct fingerprints ``fp`` that keep all groups of fingerprints joined."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must lie between 0 and 7")
    take = 8 - max_bits
    choices = _choices(8, list(range(8)), take)
    firsts = np.full(256, -1)
    for places in range(256):
        firsts[places] = next((i for i, (_, s) in enumerate(choices) if s & places == s), -1)

    lists = distinct.select(
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m, _ in choices])).alias("choice", "bits"), "fp"
    ).select(F.col("choice").cast("long").alias("choice"), "bits", "fp")
    met = _sorted(lists, "choice", "bits").mapInArrow(_compare(max_bits, firsts, long_list), "a long, b long, overflow long")
    met = written(met, "simhash-links")
    found, long = met.where("overflow < 0").select("a", "b"), met.where("overflow >= 0")
    if long.isEmpty():
        return found
    # Long lists: the same once more, by half-bytes of the positions that the list has not fixed.
    ladders = []
    for _, fixed in choices:
        free = [h for p in range(8) if not fixed >> p & 1 for h in (2 * p, 2 * p + 1)]
        ladders.append([m for m, _ in _choices(4, free, max(0, len(free) - max_bits))])
    wide = max(map(len, ladders))
    table = F.array(*[F.array(*[F.lit(m) for m in ladder]) for ladder in ladders])
    again = long.select(
        F.col("overflow"), F.col("b").alias("own"), F.col("a").alias("fp"), F.posexplode(table[F.col("overflow").cast("int")]).alias("k", "m")
    ).select(
        (F.col("overflow") * wide + F.col("k")).alias("choice"), F.col("own").bitwiseOR(F.col("fp").bitwiseAND(F.col("m"))).alias("bits"), "fp"
    )
    more = _sorted(again, "choice", "bits").mapInArrow(_compare(max_bits, None, None), "a long, b long, overflow long")
    return found.unionByName(written(more.select("a", "b"), "simhash-links"))


def _sorted(lists: DataFrame, *keys: str) -> DataFrame:
    return lists.repartition(*keys).sortWithinPartitions(*keys, "fp")


def _named(prints: DataFrame, max_bits: int) -> DataFrame:
    """``fp, root, component_id`` of each distinct fingerprint: its component's root and smallest id."""
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp"), max_bits), "simhash-groups").withColumnRenamed("node", "fp")
    rooted = written(classes.join(roots, "fp", "left"), "simhash-rooted")
    alone = rooted.where("root IS NULL").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    linked = rooted.where("root IS NOT NULL")
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    # One component may hold a third of all fingerprints: its members meet copies of its name.
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(names, ["root", "salt"])
    return alone.unionByName(met.select("fp", "root", "component_id"))


def groups(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` per row: its fingerprint and the smallest id its links reach."""
    prints = written(fingerprints(docs, shingle), "simhash")
    return prints.join(_named(prints, max_bits), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each group: that of its smallest ``doc_id``, a null id last.

    Rows of one id are told apart by fingerprint, then by a hash of the whole row, so that the choice does not
    change between runs; rows equal in all of these are alike, and one of them stays.
    """
    hashed = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]  # maps have no hash
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(*hashed).alias("tie"))
    prints = written(_keyed(rows, shingle), "simhash")
    named = _named(prints.select("doc_id", "fp"), max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "fp", "tie")
    leaders = prints.join(named.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("first"))
    met = rows.join(leaders.select(F.col("first.tie").alias("tie")), "tie", "left_semi")
    return met.dropDuplicates(["tie"]).select("doc.*")


def _keyed(rows: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, tie, fp`` of every row."""

    def run(batches):
        for batch in batches:
            got = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            columns = [batch.column("doc_id"), batch.column("tie"), pa.array(got.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "fp"])

    narrow = rows.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "tie", F.col("doc.text").cast("string").alias("text"))
    return narrow.mapInArrow(tidy(run), "doc_id long, tie long, fp long")
