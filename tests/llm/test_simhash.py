import re

import numpy as np
import pytest
import xxhash

from linkloom.llm import simhash


def plain_print(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Group number of each fingerprint, by all pairs."""
    group = list(range(len(prints)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                group[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check(rows, texts):
    ids = [r.doc_id for r in rows]
    prints = [plain_print(t) for t in texts]
    assert [r.fp & (2**64 - 1) for r in rows] == prints
    group = plain_groups(prints)
    for i, r in enumerate(rows):
        members = [ids[j] for j in range(len(ids)) if group[j] == group[i] and ids[j] is not None]
        assert r.component_id == (min(members) if members else None)


def test_against_all_pairs(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = simhash.groups(docs).collect()
    assert len(rows) == len(text)
    check(rows, [text[r.doc_id] for r in rows])


def test_odd(odd_docs, no_docs):
    rows = sorted(simhash.groups(odd_docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(rows) == odd_docs.count()
    named = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    check([r for r in rows if r.doc_id is not None], [named[r.doc_id] for r in rows if r.doc_id is not None])
    assert {r.component_id for r in rows if r.fp == 0} == {0}
    assert simhash.groups(no_docs).collect() == []
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert ids == [0, 3, 4, 5, 7, 8, 9]  # 1, 2 equal 0; 6 and the repeats equal 5
    assert simhash.keep_one(no_docs).collect() == []


@pytest.mark.parametrize("long_list", [6, 40, 8192])
def test_links_join_what_all_pairs_join(spark, long_list):
    """Balls of near values, so that short, long and re-dealt lists all occur."""
    rng = np.random.default_rng(5)
    prints = set()
    for center in rng.integers(0, 2**63, 4):
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            prints.add(int(center) ^ sum(1 << int(b) for b in flips))
    prints |= {int(x) for x in rng.integers(0, 2**63, 60)} | {0, 2**64 - 1, 15, 31}
    values = sorted(prints)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, long_list).collect()
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in links)
    from linkloom.llm.common import components

    got = {r.node: r.root for r in components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long"), "t").collect()}
    want = plain_groups([v & (2**64 - 1) for v in signed])
    for i in range(len(signed)):
        for j in range(i):
            assert (got.get(signed[i], signed[i]) == got.get(signed[j], signed[j])) == (want[i] == want[j])
