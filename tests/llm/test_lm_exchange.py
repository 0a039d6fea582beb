import random
from pathlib import Path

import numpy as np
import pytest

from linkloom.llm import lm
from linkloom.session import shared_folder


def texts(docs, size, seed=3):
    """Rows of words whose frequencies fall slowly, so that most pairs are rare; every fifth row twice."""
    rng = random.Random(seed)
    rows = [(i, " ".join(f"w{int(20_000 * rng.random() ** 3)}" for _ in range(size))) for i in range(docs)]
    return rows + rows[::5]


def test_numbers_are_packed_and_unpacked():
    for values in ([], [0], [5, -1, 1 << 62, 3], range(1000)):
        assert lm.unpacked(lm.packed(np.array(values, np.int64))).tolist() == list(values)
    words = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 500, np.uint64, endpoint=False))
    assert (lm.hashes(lm.rising(words)) == words).all() and len(lm.packed(np.arange(10_000) % 9)) < 10_000


def test_what_is_written_stays_small(spark):
    """All tables that a run writes, by the tokens of its texts: 13 bytes a token, 29 when each pair was a row."""
    rows = texts(600, 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    root = Path(shared_folder(spark).removeprefix("file://"))
    before = set(root.iterdir())
    assert lm.scores(docs).count() == len(rows)
    size = sum(f.stat().st_size for new in set(root.iterdir()) - before for f in new.rglob("*.parquet"))
    assert size < 20 * 301 * len(rows)


def test_scores_do_not_depend_on_how_pairs_are_dealt(spark, monkeypatch):
    rows = [*texts(60, 40), (7, None), (None, "w1 w2"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score)
    plain = sorted(lm.scores(docs, burn_in=0, samples=2).collect(), key=key)
    for name, value in {"SLICE_BYTES": 2_000, "CELL_TOKENS": 400, "BUCKET_TOKENS": 700, "HOT_TOKENS": 30, "COMMON": 20, "OFTEN": 2}.items():
        monkeypatch.setattr(lm, name, value)
    dealt = sorted(lm.scores(docs, burn_in=0, samples=2).collect(), key=key)
    assert len(plain) == len(dealt) == len(rows)
    for a, b in zip(plain, dealt):
        assert a[:5] == b[:5] and b.base_score == pytest.approx(a.base_score) and b.score == pytest.approx(a.score, rel=1e-9)
