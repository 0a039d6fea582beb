"""Queries ``opN_<name>``: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import collocations, fingerprints, licenses, lm, merkle, mixing, packing, pii, pivots, sharding, simhash, token_files, toxicity
from linkloom.llm.common import small_batches, table, written
from linkloom.session import fresh_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9, n_pivots=256, nearest=7, shared=2)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return rows.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.drawn(table(spark, sf_dir, "documents"))
    return rows.select(
        "_doc.doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.round("_probability", 6).alias("probability"),
        F.col("_kept").alias("kept"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.even_tree(2, 4, 5))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"), burn_in=1, samples=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), max_rows=6_000)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "llm-token-files")
    token_files.write(table(spark, sf_dir, "documents"), path)
    with small_batches(spark):
        return written(token_files.checksums(token_files.read(spark, path)), "token-checksums")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pii.fitted(docs, sample_docs=20_000, per_kind=1_000, steps=500)
    with small_batches(spark):
        return written(pii.summary(pii.find(docs, model)), "pii")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"), min_count=10, inside_percent=50, top=2_000)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_licenses": op2_licenses,
    "op3_pivots": op3_pivots,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_fingerprints": op7_fingerprints,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_toxicity": op9_toxicity,
    "op10_token_files": op10_token_files,
    "op11_pii": op11_pii,
    "op12_merkle": op12_merkle,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op2_licenses": licenses.oracle(),
    "op5_mixing": mixing.oracle(),
    "op12_merkle": merkle.oracle(),
    "op13_collocations": collocations.oracle(),
}
