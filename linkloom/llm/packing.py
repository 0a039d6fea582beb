"""Packing documents into sequences: best-fit decreasing over a segment tree of remaining capacities.

A document's ids are cut into full windows and one shorter rest. Full windows are sequences of their
own; the rests are packed longest first, each into the open sequence with the least room that still
holds it. The rests are dealt round-robin into groups of about ``group_rows`` (narrow rows, no ids),
each packed by one task, so that no group grows with the input, nor with a repeated document.

Null and empty texts are documents of the end id alone. Repeated rows are packed as often as they
occur. An empty table gives no rows. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import small_batches, tidy, written
from linkloom.llm.tokens import little_endian, task_encoder, vocabulary_text

CAPACITY = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


class OpenSequences:
    """Open sequences by remaining room; a segment tree over the rooms tells which are not empty."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.at[room].append(sequence)
        node = self.leaves + room
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of ``need`` or more that an open sequence has."""
        node = self.leaves + need
        while not self.any[node]:
            while node & 1:  # a right child: what is larger lies right of an ancestor
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, room: int) -> int:
        sequence = self.at[room].pop()
        node = self.leaves + room
        if not self.at[room]:
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return sequence


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """``(sequence, offset)`` of each piece; ``lengths`` from long to short, none above ``capacity``."""
    rooms, made = OpenSequences(capacity), 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in enumerate(lengths.tolist()):
        room = rooms.tightest(need)
        if room is None:
            room, s, made = capacity, made, made + 1
        else:
            s = rooms.take(room)
        sequence[i], offset[i] = s, capacity - room
        if room > need:
            rooms.add(room - need, s)
    return sequence, offset


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Each document's ids cut into full windows and a rest; ``with_ids`` adds the ids of each piece."""
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))
    schema = PIECES + ", ids array<int>" * with_ids

    def cut(batches):
        encoder = task_encoder(vocab.value)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for first, ids, offsets in encoder.slices(batch.column("text")):
                docs_in = np.diff(offsets)
                n = -(-docs_in // capacity)
                row = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * capacity
                length = np.minimum(capacity, docs_in[row] - start)
                at = offsets[:-1][row] + start
                data = little_endian(ids)
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                columns = [doc_ids.take(pa.array(first + row)), start, length, pa.array(crc, pa.int64()), docs_in[row]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:  # pieces follow each other in the ids of the slice
                    bounds = np.append(at, len(ids)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(cut), schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, group_rows: int = 50_000) -> DataFrame:
    """Every piece with its sequence and place there. Sequence ids are unique, not gapless."""
    with small_batches(docs.sparkSession, 4_000):
        cut = written(pieces(docs, capacity, vocabulary), "pieces")
    rests = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rests.count() // group_rows))

    def fill(batches):
        from pyspark import TaskContext

        got = list(batches)
        if not got:
            return
        rows = pa.Table.from_batches(got)
        rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "start", "ids_crc32"))])
        sequence, offset = best_fit_decreasing(rows.column("length").to_numpy(), capacity)
        sequence += TaskContext.get().partitionId() << 32
        rows = rows.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from rows.to_batches()

    full = cut.where(F.col("length") == capacity).withColumns(
        {"sequence_id": F.monotonically_increasing_id() + F.lit(1 << 62), "offset": F.lit(0).cast("long")}
    )
    # Round-robin after a local sort: a task that runs again gets the same rows.
    return full.unionByName(rests.repartition(groups).mapInArrow(tidy(fill), PACKED))


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, pad: int = 0) -> DataFrame:
    """``sequence_id, ids, used``: the ids of each packed sequence, padded to ``capacity``."""
    own = pieces(docs, capacity, vocabulary, with_ids=True).select("doc_id", "start", "ids_crc32", "ids")
    # A repeated document has the same pieces as often; any of them will do.
    own = own.dropDuplicates(["doc_id", "start", "ids_crc32"])
    match = packed["doc_id"].eqNullSafe(own["doc_id"]) & (packed["start"] == own["start"]) & (packed["ids_crc32"] == own["ids_crc32"])
    parts = packed.join(own, match).groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("used")
    )
    ids = F.flatten(F.col("parts.ids"))
    padding = F.array_repeat(F.lit(pad), (F.lit(capacity) - F.col("used")).cast("int"))
    return parts.select("sequence_id", F.concat(ids, padding).alias("ids"), "used")
