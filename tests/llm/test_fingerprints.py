import hashlib
import re

import pytest
from pyspark.sql import functions as F

from linkloom.llm import fingerprints as fp


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def check(rows, got):
    """``rows`` in descending id order."""
    texts = [r.text or "" for r in rows]
    errors = []
    for i, r in enumerate(rows):
        own, after = texts[i], texts[(i + 1) % len(texts)]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        g = got[r.doc_id]
        assert g.n_chars == len(own) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((g.near_edited, edited), (g.near_next, after)):
            true = likeness(shingles(own), shingles(other))
            errors.append(abs(value - true))
            if len(shingles(own) | shingles(other)) <= fp.K:
                assert value == pytest.approx(true)
        n = len(shingles(own))
        assert g.distinct_shingles == n if n < fp.K else abs(g.distinct_shingles / n - 1) < 0.5
    assert sum(errors) / len(errors) < 0.04


@pytest.mark.parametrize("block_rows", [7, 512])
def test_against_plain(docs, block_rows, monkeypatch):
    monkeypatch.setattr(fp.with_next, "__defaults__", (block_rows,))
    got = {r.doc_id: r for r in fp.compared(docs).collect()}
    rows = sorted(docs.collect(), key=lambda r: -r.doc_id)
    assert len(got) == len(rows)
    check(rows, got)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text, set()).add(got[r.doc_id].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_odd(odd_docs, no_docs):
    got = fp.compared(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert sum(r.doc_id == 5 for r in got) == 3 and all(r.near_next is not None for r in got)
    plain = odd_docs.where("doc_id is not null and doc_id < 9").dropDuplicates(["doc_id"])
    rows = sorted(plain.collect(), key=lambda r: -r.doc_id)
    check(rows, {r.doc_id: r for r in fp.compared(plain).collect()})
    assert fp.compared(no_docs).collect() == []
    assert len(fp.compared(odd_docs.where("doc_id = 9")).collect()) == 1


def test_sketches_merge(spark):
    halves = [" ".join(f"w{i}" for i in range(600)), " ".join(f"w{i}" for i in range(596, 1200))]
    df = spark.createDataFrame([(*halves, halves[0] + " " + " ".join(halves[1].split()[4:]))], "a string, b string, whole string")
    for c in df.columns:
        df = fp.with_sketch(df, c, f"s_{c}")
    row = df.select(
        (fp.merged(F.col("s_a"), F.col("s_b")) == F.col("s_whole")).alias("same"),
        fp.containment(F.col("s_a"), F.col("s_whole")).alias("inside"),
        fp.containment(F.col("s_whole"), F.col("s_a")).alias("half"),
    ).first()
    assert row.same and row.inside > 0.7 and 0.3 < row.half < 0.7
