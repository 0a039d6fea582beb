"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct hashed character n-grams of a text (case folded, a space before and after).
Each is scaled by the log of its smoothed share among toxic over that among clean training texts, the
vector is brought to length one, and a logistic regression is fitted on top by mini-batch descent.

The fit uses at most ``max_rows`` labelled documents (those of the smallest hash of ``doc_id``) of at most
``max_chars`` characters in all; they alone come to the driver, as feature numbers (12 bytes a character at
most). N-grams are hashed into ``2 ** BITS`` features. Scoring is map-only over whole texts.

A text without n-grams scores by the bias. With no training row every score is 0; with one class the
features are zero and the bias decides. Null labels are not learned from; a document labelled more
than once is toxic if any label says so. Repeated rows score alike. Null ids are never learned from and not
held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import give_back, tidy

LOW, HIGH, BITS = 3, 5, 18
HELD_OUT_MOD = 5
MAX_CHARS = 32_000_000


def is_held_out(doc_id: Column, mod: int = HELD_OUT_MOD) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % mod == 0, F.lit(False))


def ngrams(text: str | None) -> np.ndarray:
    """The distinct hashed character n-grams of a text, as feature numbers."""
    chars = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed, found = chars * np.uint64(0x9E3779B97F4A7C15), []
    for n in range(2, HIGH + 1):
        if len(chars) < n:
            break
        mixed = mixed[: len(chars) - n + 1]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + chars[n - 1 :] * np.uint64(0x94D049BB133111EB)
        if n >= LOW:
            found.append((mixed >> np.uint64(64 - BITS)).astype(np.int32))
    every = np.concatenate(found) if found else np.empty(0, np.int32)
    # Keep the last place of each feature: linear time, without a sort.
    place = np.arange(len(every), dtype=np.int32)
    last = np.zeros(1 << BITS, np.int32)
    last[every] = place
    return every[last[every] == place]


@dataclass(frozen=True)
class Model:
    """``weights`` include the log-count ratios; ``squares`` are the squared ratios, for the length."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at = ngrams(text)
        length = np.sqrt(self.squares[at].sum()) if len(at) else 0.0
        z = self.bias + (float(self.weights[at].sum()) / length if length > 0 else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, mod: int = HELD_OUT_MOD, max_chars: int = MAX_CHARS) -> DataFrame:
    """``doc_id, toxic, text`` of labelled documents outside the held-out part, within both bounds.

    Labels without a document do not count. Documents are taken by hash while their texts fit together.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id"), mod))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max("toxic").alias("toxic"))
    own = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sizes = own.groupBy("_doc").agg(F.max(F.length("text")).alias("_size"))
    chosen = known.join(sizes, "_doc").orderBy(F.xxhash64("_doc"), "_doc").limit(max_rows)
    # max_rows bounds the window and the broadcast side; texts stay where they are scanned.
    so_far = "sum(_size) OVER (ORDER BY xxhash64(_doc), _doc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    chosen = chosen.withColumn("_so_far", F.expr(so_far)).where(F.col("_so_far") <= max_chars).select("_doc", "toxic")
    met = own.join(F.broadcast(chosen), "_doc")
    return met.groupBy("_doc", "toxic").agg(F.min("text").alias("text")).withColumnRenamed("_doc", "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, steps: int = 300, mod: int = HELD_OUT_MOD) -> Model:
    def features(batches):
        for batch in batches:
            rows = [ngrams(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows)], ["doc_id", "toxic", "grams"])

    rows = training_rows(docs, labels, max_rows, mod).select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
    got = rows.mapInArrow(tidy(features), "doc_id long, toxic int, grams binary").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    grams = [g for chunk in got.column("grams").chunks for g in _views(chunk)]
    model = fit_rows([grams[i] for i in order], got.column("toxic").to_numpy()[order], steps)
    del got, grams
    pa.default_memory_pool().release_unused()
    return model


def _views(chunk: pa.BinaryArray) -> list[np.ndarray]:
    """Each value as feature numbers, without a copy."""
    offsets = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] // 4
    data = np.frombuffer(chunk.buffers()[2] or b"", np.int32)
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def fit_rows(grams: list[np.ndarray], toxic: np.ndarray, steps: int, batch: int = 256, rate: float = 0.05, decay: float = 1e-5) -> Model:
    size = 1 << BITS
    truth = (toxic > 0).astype(np.float64)
    n, n_toxic = len(truth), int(truth.sum())
    if not 0 < n_toxic < n:
        bias = -500.0 if not n else float(np.log((n_toxic + 0.5) / (n - n_toxic + 0.5)))
        return Model(np.zeros(size), np.zeros(size), bias)
    in_toxic, in_clean = np.full(size, 0.5), np.full(size, 0.5)
    for g, t in zip(grams, truth):
        (in_toxic if t else in_clean)[g] += 1
    ratio = np.log(in_toxic / (n_toxic + 1)) - np.log(in_clean / (n - n_toxic + 1))
    lengths = np.array([np.sqrt((ratio[g] ** 2).sum()) or 1.0 for g in grams])
    weights, bias = np.zeros(size), 0.0
    mean, square, mean_b, square_b, step = np.zeros(size), np.zeros(size), 0.0, 0.0, 0
    order = np.random.default_rng(7)
    batches = max(1, n // batch)
    for _ in range(-(-steps // batches)):
        for rows in np.array_split(order.permutation(n), batches):
            at = np.concatenate([grams[i] for i in rows])
            each = np.array([len(grams[i]) for i in rows])
            owner = np.repeat(np.arange(len(rows)), each)
            values = ratio[at] / lengths[rows][owner]
            z = np.bincount(owner, values * weights[at], len(rows)) + bias
            off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - truth[rows]
            slope = np.bincount(at, values * off[owner], size) / len(rows) + decay * weights
            slope_b = off.mean()
            step += 1
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            mean_b, square_b = 0.9 * mean_b + 0.1 * slope_b, 0.99 * square_b + 0.01 * slope_b**2
            weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
            bias -= rate * (mean_b / (1 - 0.9**step)) / (np.sqrt(square_b / (1 - 0.99**step)) + 1e-6)
    return Model((weights * ratio).astype(np.float64), ratio**2, float(bias))


def score(text: Column, model: Model, docs: DataFrame) -> Column:
    """The probability that a text is toxic. The model's size is fixed (2 x 2 MB), so it is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.squares, model.bias))

    def run(texts: pd.Series) -> pd.Series:
        own = Model(*shared.value)
        out = texts.map(lambda t: own.score(t if isinstance(t, str) else None)).astype("float64")
        give_back()
        return out

    return F.pandas_udf(run, "double")(text)


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000, mod: int = HELD_OUT_MOD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = fit(docs, labels, max_rows, mod=mod)
    own = docs.select("doc_id", is_held_out(F.col("doc_id"), mod).alias("held_out"), score(F.col("text"), model, docs).alias("score"))
    return own.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 6_000) -> DataFrame:
    """``docs`` without the rows the model calls toxic. The score alone decides."""
    model = fit(docs, labels, max_rows)
    return docs.where(score(F.col("text"), model, docs) < 0.5)
