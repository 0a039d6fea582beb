import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from linkloom.llm import lm


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [""]


def held(doc_id):
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check(rows, got):
    count = Counter(w for r in rows if not held(r.doc_id) for w in tokens(r.text))
    total, distinct = sum(count.values()), len(count)
    want = []
    for r in rows:
        own = tokens(r.text)
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in own)
        want.append((r.doc_id, held(r.doc_id), len(own), sum(count[w] > 0 for w in own), total, pytest.approx(base, rel=1e-9)))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    seen = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    assert seen == sorted(want, key=key)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_counts_and_perplexity(docs):
    scored = lm.scores(docs)
    got = scored.collect()
    check(docs.collect(), got)
    ours = {r.held_out: r.perplexity for r in lm.perplexity(scored).collect()}
    base = {r.held_out: r.perplexity for r in lm.perplexity(scored, "base_score").collect()}
    assert ours[True] < base[True] and ours[False] < base[False]


def test_odd(odd_docs, no_docs):
    got = lm.scores(odd_docs).collect()
    check(odd_docs.collect(), got)
    assert len({round(r.base_score, 9) for r in got if r.doc_id == 5}) == 1
    assert lm.scores(no_docs).collect() == []


def test_scores_do_not_depend_on_partitions(docs):
    few = docs.limit(60)
    a, b = ({r.doc_id: r.score for r in lm.scores(few.repartition(n)).collect()} for n in (1, 5))
    assert a.keys() == b.keys() and all(a[d] == pytest.approx(b[d], rel=1e-9) for d in a)


def test_draws_are_those_of_their_keys():
    keys = np.arange(20_000)
    every = lm.Draws(1, 2, keys)
    first, some = every.uniform(), lm.Draws(1, 2, keys[500:700]).uniform()
    assert (first[500:700] == some).all() and abs(first.mean() - 0.5) < 0.01 and abs(every.uniform().mean() - 0.5) < 0.01
    assert not (first == lm.Draws(2, 2, keys).uniform()).any()
    for shape in (0.3, 1.0, 2.5, 40.0, 1e6):
        got = lm.Draws(3, 1, keys).gamma(np.full(len(keys), shape))
        assert got.mean() == pytest.approx(shape, rel=0.03) and got.var() == pytest.approx(shape, rel=0.06)
        assert (got[:9] == lm.Draws(3, 1, keys[:9]).gamma(np.full(9, shape))).all()


def test_log_gamma(spark):
    from pyspark.sql import functions as F

    values = [0.05, 0.5, 1.0, 2.5, 30.0, 1e6]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.orderBy("x").select(lm.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(v) for v in values], rel=1e-8, abs=1e-8)
