import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
# Columns that no operator reads, named like columns that operators make.
CLASHES = (
    "_row row _part _tie fp words _words length start shard slot law _block _hash _guest next_text class list n_tokens "
    "_doc _source _lang _topic _tokens _probability _draw _kept _leader _toxicity probability score size c p0 word root node"
).split()
LONG = " ".join(f"w{i % 997} of the" for i in range(20_000))
TEXTS = [None, "", " ", "one", "One two\tthree  four", "a b c d e f g", "a b c d e f g", "Ünï cödé 日本 text.", "MIT License\nx", LONG]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and repeated ids, null, empty, equal and very long texts, null attributes, clashing extra columns."""
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else "src0", None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "a lost id", "de", "src1", 9), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def rows_of(df):
    return df.toPandas().to_dict("records")


@pytest.fixture(scope="session")
def collect():
    return rows_of
