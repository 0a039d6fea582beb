"""Token ids as Parquet files of list columns, in ascending document order.

``write`` sorts the documents over all files, encodes them and has Spark's Parquet writer store one
row per document: ``doc_id, part, row_start, n_tokens, ids``. ``part`` numbers the files in document
order and ``row_start`` counts the ids before the document in its file, so a place in the whole
stream is found from one small total per file. Ids are dictionary or delta encoded; row group size
and rows per page are set, and the writer adds page indexes, so a filter on ``doc_id`` or
``row_start`` reads the pages that hold it, and metadata is read without the ids.

Null and empty texts are documents of the end id alone; null ids come first; repeated rows are kept
(ties stand in the order they were read from). An empty table gives an empty data set. Columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import small_batches, tidy
from linkloom.llm.tokens import little_endian, task_encoder, vocabulary_text

STORED = "doc_id long, part int, row_start long, n_tokens long, ids array<int>"
MAX_FILES = 100_000


def write(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    encoding: str = "dictionary",
    rows_per_file: int = 16_384,
    row_group_bytes: int = 32 << 20,
    rows_per_page: int = 1_000,
    codec: str = "zstd",
) -> None:
    """Writes the data set. ``encoding``: ``dictionary``, or ``delta`` (differences bit-packed)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    vocab = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary))
    files = min(MAX_FILES, max(1, -(-docs.count() // rows_per_file)))

    def encode(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        encoder = task_encoder(vocab.value)
        for batch in batches:
            for first, ids, offsets in encoder.slices(batch.column("text")):
                n = np.diff(offsets)
                columns = [
                    batch.column("doc_id").slice(first, len(n)),
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(before + offsets[:-1]),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ]
                before += int(offsets[-1])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "row_start", "n_tokens", "ids"])

    # The place a row was read from breaks ties, so that one repeated id spreads over files.
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    ordered = narrow.repartitionByRange(files, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    options = {
        "compression": codec,
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": rows_per_page,
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
    }
    with small_batches(docs.sparkSession, 4_000):
        ordered.select("doc_id", "text").mapInArrow(tidy(encode), STORED).write.options(**options).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows with ``start``, the ids before the document in the whole stream. Select only what is needed."""
    rows = spark.read.schema(STORED).parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # One row per file, MAX_FILES at most.
    before = "sum(_n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    bases = totals.select("part", F.coalesce(F.expr(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("_base") + F.col("row_start")).drop("_base")


def tokens_between(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """``doc_id, position, id`` of stream places ``low`` to ``high - 1``; only rows that hold some are expanded."""
    rows = read(spark, path).where((F.col("start") < high) & (F.col("start") + F.col("n_tokens") > low))
    each = rows.select("doc_id", "start", F.posexplode("ids").alias("at", "id"))
    placed = each.select("doc_id", (F.col("start") + F.col("at")).alias("position"), "id")
    return placed.where(F.col("position").between(low, high - 1))


def checksums(rows: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of ``read`` rows: the checksum of the ids that were read back."""

    def crc(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets = (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
            data = little_endian(lists.values.to_numpy(zero_copy_only=False))
            got = [zlib.crc32(data[a:b]) for a, b in zip(offsets, offsets[1:])]
            kept = [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(got, pa.int64())]
            yield pa.RecordBatch.from_arrays(kept, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        tidy(crc), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
