import numpy as np
import pytest

from linkloom.llm import lm


def stirling(n, d):
    """``log S(n, t)`` of all ``t``, by recursion."""
    row, places = np.full(n + 1, -np.inf), np.arange(n + 1)
    row[0] = 0.0
    for i in range(n):
        with np.errstate(divide="ignore"):
            stay = row + np.log(np.maximum(i - d * places, 0))
        row = np.logaddexp(stay, np.concatenate([[-np.inf], row[:-1]]))
    return row


def test_order_of_words_counts(spark):
    """A text of known word pairs scores higher than the same words in an order never seen."""
    learned = [(i, "a b c d e f g h") for i in range(40) if not lm.zlib.crc32(str(i).encode()) % 7 == 2]
    held = [i for i in range(100, 200) if lm.zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [*learned, (held[0], "a b c d e f g h"), (held[1], "h f d b g e c a")]
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text, salad = got[held[0]], got[held[1]]
    assert text.base_score == pytest.approx(salad.base_score) and text.n_known == salad.n_known == 9
    assert text.score > salad.score + 5


def test_small_corpus_against_the_sum_over_seatings(spark):
    """Scores of production code, averaged over many sweeps, against sums over all tables of all restaurants."""
    import itertools
    import math

    held = next(str(i) for i in range(50) if lm.zlib.crc32(str(i).encode()) % 7 == 2)
    texts = {i: t for i, t in zip((i for i in range(9) if lm.zlib.crc32(str(i).encode()) % 7 != 2), ["a a b", "a a", "b a a"])}
    rows = [*texts.items(), (int(held), "a b")]
    got = {r.doc_id: r.score for r in lm.scores(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), burn_in=3, samples=40).collect()}
    pairs, words = {}, {}
    for t in texts.values():
        own = t.split() + [""]
        for u, w in zip(["", *own], own):
            pairs[u, w] = pairs.get((u, w), 0) + 1
            words[w] = words.get(w, 0) + 1
    ones = lambda values: (sum(v == 1 for v in values), sum(v == 2 for v in values))
    d = lm._estimated(*ones(pairs.values()))
    tables_of = lambda t: {w: sum(k for (u, x), k in t.items() if x == w) for w in words}
    root = lm._estimated(*ones(tables_of({p: 1 for p in pairs}).values()))  # as production has it: one table per pair
    share, total, want = 1 / (len(words) + 1), 0.0, {k: 0.0 for k, _ in rows}
    rising = lambda s, x, n: sum(math.log(s + x * k) for k in range(1, n))
    for choice in itertools.product(*[range(1, n + 1) for n in pairs.values()]):
        t = dict(zip(pairs, choice))
        c = tables_of(t)
        low = sum(stirling(n, d)[t[p]] for p, n in pairs.items())
        for u in {u for u, _ in pairs}:
            low += rising(lm.WORD_STRENGTH, d, sum(k for (x, _), k in t.items() if x == u))
        high = -sum(math.log(lm.ROOT_STRENGTH + k) for k in range(1, sum(c.values())))
        for seats in itertools.product(*[range(1, n + 1) for n in c.values()]):
            s = dict(zip(c, seats))
            weight = low + high + sum(stirling(n, root)[s[w]] for w, n in c.items()) + rising(lm.ROOT_STRENGTH, root, sum(seats)) + sum(seats) * math.log(share)
            weight = math.exp(weight)
            q = {w: (c[w] - root * s[w] + (lm.ROOT_STRENGTH + root * sum(seats)) * share) / (lm.ROOT_STRENGTH + sum(c.values())) for w in words}
            total += weight
            for k, text in rows:
                own, p = text.split() + [""], 1.0
                for u, w in zip(["", *own], own):
                    n, customers = pairs.get((u, w), 0), sum(v for (x, _), v in pairs.items() if x == u)
                    opened = sum(v for (x, _), v in t.items() if x == u)
                    p *= (n - d * t.get((u, w), 0) + (lm.WORD_STRENGTH + d * opened) * q[w]) / (lm.WORD_STRENGTH + customers)
                want[k] += weight * p
    for k, score in got.items():
        assert score == pytest.approx(math.log10(want[k] / total), abs=0.08)


@pytest.mark.parametrize("d", [0.3, 0.85])
def test_stirling_numbers(d):
    n, t = 1200, np.array([1, 2, 5, 30, 300, 900, 1190])
    assert lm.log_stirling(np.full(len(t), n), t, d) == pytest.approx(stirling(n, d)[t], abs=0.1)
    assert lm.log_stirling(np.full(3, 40), np.array([0, 40, 41]), d).tolist() == [-np.inf, 0.0, -np.inf]
    assert lm.log_stirling(np.full(39, 40), np.arange(1, 40), d) == pytest.approx(stirling(40, d)[1:40])


@pytest.mark.parametrize("n, weight", [(6, 0.7), (200, 3.0), (900, 2.0)])
def test_steps_keep_the_law(n, weight):
    d, runs = 0.6, 2000
    law = stirling(n, d)[1:] + np.arange(1, n + 1) * np.log(weight)
    law = np.exp(law - law.max()) / np.exp(law - law.max()).sum()
    mean = law @ np.arange(1, n + 1)
    t = np.ones(runs, np.int64)
    for sweep in range(20):
        t = lm.resample(lm.Draws(1, sweep, np.arange(runs)), np.full(runs, n), t, np.full(runs, weight), d)
    assert t.mean() == pytest.approx(mean, rel=0.03)


def test_sweeps_of_a_restaurant_are_gibbs():
    """Two dishes whose tables far exceed the number of dishes: mean tables against the sum over all seatings."""
    d, strength, n, p = 0.5, 1.0, np.array([30, 12]), np.array([0.6, 0.4])
    a, b = np.meshgrid(np.arange(1, 31), np.arange(1, 13), indexing="ij")
    opened = np.array([sum(np.log(strength + k * d) for k in range(1, t)) for t in range(43)])
    law = stirling(30, d)[a] + stirling(12, d)[b] + a * np.log(p[0]) + b * np.log(p[1]) + opened[a + b]
    law = np.exp(law - law.max())
    want = np.array([(law * a).sum(), (law * b).sum()]) / law.sum()
    rng, runs = np.random.default_rng(6), 1000
    t, total = np.ones((runs, 2), np.int64), np.zeros(2)
    for sweep in range(60):
        g = rng.gamma(strength / d + t.sum(axis=1))
        weight = d * g[:, None] * p
        t = lm.resample(lm.Draws(2, sweep, np.arange(2 * runs)), np.tile(n, runs), t.ravel(), weight.ravel(), d).reshape(runs, 2)
        if sweep >= 20:
            total += t.mean(axis=0) / 40
    assert total == pytest.approx(want, rel=0.02)
