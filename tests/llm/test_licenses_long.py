import pytest

from linkloom.llm import licenses

BODY = " ".join(f"term{i} of the" for i in range(70))  # 210 words, 72 distinct
MIDDLE = " ".join(f"clause{i}" for i in range(30))
LONGER = " ".join(f"part{i}" for i in range(400))


def labels(spark, texts, templates):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in sorted(licenses.scan(df, templates=templates).collect(), key=lambda r: r.doc_id)]


def test_full_license_text(spark):
    filler = " ".join(f"word{i}" for i in range(300))
    texts = [f"{filler} {BODY} {filler}", BODY, f"{filler} {LONGER}", filler, " ".join(BODY.split()[:100])]
    assert labels(spark, texts, {"body": BODY, "longer": LONGER}) == ["body", "body", "longer", "", ""]


@pytest.mark.parametrize("words", [MIDDLE, " ".join(f"{w} added" for w in MIDDLE.split())])
def test_passages_at_every_offset(spark, words):
    """A passage, and one with as many words added, wherever it starts."""
    texts = [" ".join(["x"] * at + [words] + ["y"] * 90) for at in range(80)]
    assert labels(spark, texts, {"middle": MIDDLE}) == ["middle"] * 80


def test_shipped_notices_at_every_offset(spark):
    for label, notice in licenses.TEMPLATES.items():
        texts = [" ".join(["x"] * at + [notice] + ["y"] * 40) for at in range(33)]
        assert all(label in got.split(",") for got in labels(spark, texts, licenses.TEMPLATES))


def test_a_template_without_words_is_refused(spark):
    with pytest.raises(ValueError):
        labels(spark, ["a"], {"none": " "})
