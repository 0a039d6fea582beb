"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch is the sorted array of the ``K`` smallest distinct 32-bit shingle hashes of a text (all of them
if there are fewer). Sketches of parts merge by union and cut. Two sketches estimate the resemblance of
their texts, the containment of one in the other, and each text's number of distinct shingles.

Shingles are five words (between ASCII white space) as written; a shorter text is one shingle, a text
without words has none. Two empty sketches resemble by 1. Equal texts have equal sketches.

``with_next`` hands each row the text of the next document in descending id. Blocks of consecutive ids
are cut at quantiles, so that the texts are shuffled once and no block grows with the input; the first
document of each block is also sent to the block above it. Ties in the id stand in the order of a text
hash, null ids come last. Null texts are empty. An empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import written

K, SHINGLE = 128, 5
RANGE = float(1 << 32)
BLOCK_ROWS, MAX_BLOCKS = 512, 1 << 16


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Adds the sketch of column ``text``."""
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    step = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    each = F.expr(f"transform(sequence(0, greatest(size(_words) - {shingle}, 0)), i -> shiftrightunsigned(xxhash64(slice(_words, i + 1, {shingle})), 32))")
    hashes = F.when(F.size("_words") > 0, each).otherwise(F.array().cast("array<bigint>"))
    return step.withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop("_words")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """The number of distinct shingles: exact below ``k``."""
    n = F.size(a)
    return F.when(n < k, n.cast("double")).otherwise((k - 1) * F.lit(RANGE) / (F.element_at(a, -1) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of the first text's shingles that the second has."""
    own, both = distinct_shingles(a, k), distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * both / own))


def hex_text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _block(bounds: list[int]) -> Column:
    """The number of ``bounds`` at or below ``doc_id``, found among every m-th bound and then among m."""
    m = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + m] for i in range(0, len(bounds), m)]
    coarse = f"from_json('{json.dumps([r[0] for r in rows[1:]])}', 'array<bigint>')"
    fine = f"from_json('{json.dumps(rows)}', 'array<array<bigint>>')"
    at = f"size(filter({coarse}, x -> x <= doc_id))"
    return F.expr(f"{at} * {m} + size(filter({fine}[{at}], x -> x <= doc_id))")


def with_next(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``doc_id, text, _block, _guest, _hash`` with ``next_text``; rows with ``_guest`` only stand for the block below."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = own.count()
    blocks = min(MAX_BLOCKS, max(1, rows // block_rows))
    cuts = [i / blocks for i in range(1, blocks)]
    bounds = (own.agg(F.percentile_approx("doc_id", cuts, max(10_000, 4 * blocks)).alias("b")).first()["b"] or []) if cuts else []
    bounds = sorted(set(bounds))
    block = _block(bounds) if bounds else F.lit(0)
    own = own.withColumns({"_block": block, "_hash": F.xxhash64("text")})
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("_hash")).alias("minus"))
    heads = own.groupBy("_block").agg(F.max(order).alias("_head"))
    # One row per block, MAX_BLOCKS at most: a head goes to the block of the next higher ids, the highest to the lowest.
    above = F.coalesce(F.lead("_block").over(Window.orderBy("_block")), F.first("_block").over(Window.orderBy("_block")))
    heads = written(heads.select("_block", "_head", above.alias("_to")), "sketch-heads").select(
        "_block", F.col("_head.doc_id").alias("_id"), (-F.col("_head.minus")).alias("_h"), "_to"
    )
    is_head = (own["_block"] == heads["_block"]) & own["doc_id"].eqNullSafe(heads["_id"]) & (own["_hash"] == heads["_h"])
    sent = own.join(F.broadcast(heads), is_head, "left").select(
        own["doc_id"],
        "text",
        "_hash",
        F.explode(
            F.when(F.col("_to").isNull(), F.array(F.struct(own["_block"].alias("b"), F.lit(False).alias("g")))).otherwise(
                F.array(
                    F.struct(own["_block"].alias("b"), F.lit(False).alias("g")), F.struct(F.col("_to").alias("b"), F.lit(True).alias("g"))
                )
            )
        ).alias("_at"),
    ).select("doc_id", "text", "_hash", F.col("_at.b").alias("_block"), F.col("_at.g").alias("_guest"))
    return sent.withColumn("next_text", F.lead("text").over(in_block()))


def in_block():
    return Window.partitionBy("_block").orderBy("_guest", F.col("doc_id").desc_nulls_last(), "_hash")


def compared(docs: DataFrame, k: int = K) -> DataFrame:
    """Each document's sketch, that of its edited text, and what they and the next document's resemble by."""
    rows = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    edited = F.expr(
        "concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(coalesce(next_text, ''), 1, cast(n_chars div 2 as int)))"
    )
    rows = rows.withColumn("_edited", edited).drop("next_text")
    rows = with_sketch(with_sketch(rows, "text", "_own", k), "_edited", "_changed", k)
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256)).drop("text", "_edited")
    rows = rows.withColumn("_next", F.lead("_own").over(in_block())).where(~F.col("_guest"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hex_text(F.col("_own")).alias("fingerprint"),
        hex_text(F.col("_changed")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_changed"), k).alias("near_edited"),
        resemblance(F.col("_own"), F.col("_next"), k).alias("near_next"),
        distinct_shingles(F.col("_own"), k).alias("distinct_shingles"),
        containment(F.col("_own"), F.col("_changed"), k).alias("contained_in_edited"),
    )
