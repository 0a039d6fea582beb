import re
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import collocations as C

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    """Counts of all phrases of one to three words per language."""
    f = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                f[lang or "und" if lang != "" else ""].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f


def plain(rows, min_count, top):
    out = []
    for lang, f in counted(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = []
        for p, a in f.items():
            if len(p) == 1 or a < min_count:
                continue
            longer = [c for q, c in f.items() if len(q) == 3 and c >= min_count and p in (q[:2], q[1:])] if len(p) == 2 else []
            if any(100 * c >= 50 * a for c in longer):
                continue
            cuts = [(1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in C.mined(df, **kw).collect())


def test_against_sql(docs):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = mined(docs)
    assert got == sorted(con.sql(C.oracle()).fetchall()) and got


@pytest.mark.parametrize("range_tokens", [300, 2_000_000])
def test_against_plain(docs, range_tokens, monkeypatch):
    """Many small shards, prefix ranges cut by hash, low counts, a cut-off list."""
    few = docs.limit(60)
    monkeypatch.setattr(C, "REQUESTS", 50)
    rows = [(r.lang, r.text) for r in few.collect()]
    got = mined(few.repartition(4), min_count=3, top=40, range_tokens=range_tokens)
    assert got == plain(rows, 3, 40)


def test_odd(odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert mined(odd_docs, min_count=2) == plain(rows, 2, 2000)
    assert mined(no_docs) == []
    assert mined(odd_docs.where("text IS NULL OR text = ''")) == []


def test_one_pair_holds_most_rows(spark):
    """A hot pair before many words, and a hot phrase, over shares of one range."""
    texts = [f"hot pair w{i % 90} tail" for i in range(900)] + ["hot pair hot pair hot"] * 50 + ["ends hot pair"] * 20
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(6)
    assert mined(docs, min_count=10, range_tokens=200) == plain([("en", t) for t in texts], 10, 2000)


def test_rare_pairs_of_a_frequent_word_stay_in_their_cells(spark, monkeypatch):
    """A word over several shares: of its pairs only those met often enough, and pieces of hot ones, leave the cells."""
    made, kept = C.written, {}
    monkeypatch.setattr(C, "written", lambda df, label, *a: kept.setdefault(label, made(df, label, *a)))
    texts = [f"hot w{i}" for i in range(1500)] + ["hot pair"] * 12 + [f"hot third v{i % 150}" for i in range(300)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").repartition(4)
    got = mined(docs, min_count=10, range_tokens=200)
    assert got == plain([("en", t) for t in texts], 10, 2000) and len(got) == 2
    pairs = kept["phrase-counts"].where("w3 IS NULL")
    assert {(r.w1, r.w2) for r in pairs.collect()} == {("hot", "pair"), ("hot", "third")}
    assert pairs.where("whole").count() == 1 and pairs.count() > 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAb ,.\t\né ", max_size=25), max_size=6))
def test_windows_and_union(texts):
    parts = [C.Transducer.counted(*C.windows(pa.array(t, pa.string()))) for t in (texts[:3], texts[3:])]
    t = C.Transducer.union([C.Transducer.from_bytes(p.to_bytes()) for p in parts])
    want = counted([("x", x) for x in texts])["x"]
    got, labels = Counter(), t.labels.to_pylist()
    for a, b, c, w in zip(*(x.tolist() for x in t.entries())):
        full = (labels[a], labels[b], labels[c])
        for k in (1, 2, 3):
            if full[k - 1]:
                got[full[:k]] += w
    assert got == want


def test_states_are_shared():
    words = [f"w{i} same end" for i in range(50)]
    t = C.Transducer.counted(*C.windows(pa.array(words)))
    a, *_ = t.entries()
    assert len(a) == 52 and len(t.first[0]) - 1 == 3 and len(t.second[0]) - 1 == 2


def test_composition(docs):
    texts = pa.array([r.text for r in docs.limit(40).collect()])
    t = C.Transducer.counted(*C.windows(texts))
    a, b, c, w = t.entries()
    asked = [t.labels.take(pa.array(x)) for x in (a, b, c)]
    assert (t.weights_of(asked) == w).all()
    strange = [pa.array(["no such word"] * 2), pa.array(["", "the"]), pa.array(["", ""])]
    assert (t.weights_of(strange) == 0).all()
    empty = C.Transducer.counted(*C.windows(pa.array([], pa.string())))
    assert (empty.weights_of(strange) == 0).all()


def test_many_words_are_sorted_without_packing():
    codes = [np.array([3, 1, 3, 1]), np.array([0, 2, 0, 1]), np.array([0, 0, 0, 5])]
    small, same = C._sorted(codes, 10)
    large, same2 = C._sorted(codes, 1 << 40)
    assert small.tolist() == large.tolist() == [3, 1, 0, 2] and same.tolist() == same2.tolist() == [False, False, False, True]


def calls(run):
    """What ``run`` returns, and how many functions were called meanwhile."""
    n = [0]

    def count(frame, event, arg):
        n[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        return run(), n[0]
    finally:
        sys.setprofile(None)


def test_cells_cost_little_by_number():
    """On a large table a shard meets thousands of ranges: cutting it and reading its pieces must not work cell by cell."""
    texts = pa.array([f"w{i % 1900} x{i % 7} y{i % 11} z. w{i % 300} zz w{i * 31 % 1900}" for i in range(4000)])
    t = C.Transducer.counted(*C.windows(texts))
    entries = t.entries()
    took = []
    for cells in (20, 1500):
        key = entries[0].astype(np.int64) * cells // len(t.labels)
        (rows, letters, numbers), n = calls(lambda: t.cut(key, entries))
        assert len(rows) > 0.7 * cells and key[rows].tolist() == sorted(set(key.tolist()))
        one = C.Transducer.side_by_side(letters.slice(3, 1), numbers.slice(3, 1)).entries()
        assert one[3].tolist() == entries[3][key == key[rows[3]]].tolist()
        parts = [C.Transducer.side_by_side(x, y) for x, y in ((letters[::2], numbers[::2]), (letters[1::2], numbers[1::2]))]
        back, m = calls(lambda: C.Transducer.union(parts))
        assert back.labels.equals(t.labels) and all((x == y).all() for x, y in zip(back.entries(), entries))
        took.append((n, m))
    assert took[1][0] < 2 * took[0][0] + 1000 and took[1][1] < 2 * took[0][1] + 1000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.integers(0, 1 << 62), max_size=4), min_size=3, max_size=3), max_size=5))
def test_packed_numbers(groups):
    arrays = [np.array([x for g in groups for x in g[k]], np.int64) for k in range(3)]
    sizes = [np.array([len(g[k]) for g in groups], np.int64) for k in range(3)]
    got, counts = C.unpacked(C.packed(arrays, sizes), 3)
    assert [x.tolist() for x in got] == [x.tolist() for x in arrays] and [x.tolist() for x in counts] == [x.tolist() for x in sizes]
