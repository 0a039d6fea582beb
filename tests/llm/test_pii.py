import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkloom.llm import pii
from linkloom.llm.tagger import N_CLASSES, Tagger

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in re.findall("[0-9]+", m.group())),
                "card": 14 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.-+1209 ()é\n%", max_size=60))
def test_base_spans_follow_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_of_whole_texts(docs):
    texts = [r.text for r in docs.collect()]
    texts += ["4111 1111 1111 1111", "x@y", "a@b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8", "300.1.1.1 1.1.1.300", "+1 (017) 555-7713)", "é" * 30 + "1.2.3.4"]
    assert [pii.base_spans(t) for t in texts] == [plain_base(t) for t in texts]
    assert sum(len(pii.base_spans(t)) for t in texts) > 8


def test_base_spans_of_long_runs_take_linear_time():
    long = 300_000
    for text in ("1" * long, "1." * long, "a" * long + "@", "+1" + "(" * long, "@" * long, "1 " * long):
        pii.base_spans(text)
        pii.read_windows(text, [])


def every_path(model, e):
    n, labels = len(e), model.n_labels
    paths = list(itertools.product(range(labels), repeat=n))
    score = [
        model.p["first"][p[0]] + sum(e[t, 0, p[t]] for t in range(n)) + sum(model.p["move"][a, b] for a, b in zip(p, p[1:])) for p in paths
    ]
    return paths, np.array(score)


def test_decoding_and_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    model = Tagger(3, hidden=4)
    model.p["move"], model.p["first"] = rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    e = model.emissions(rng.integers(0, N_CLASSES, (1, 5)).astype(np.int8))
    paths, score = every_path(model, e)
    assert tuple(model.best(e)[0]) == paths[int(score.argmax())]
    probability, _, _, total = model.marginals(e)
    weight = np.exp(score - score.max())
    assert np.isclose(total[0], np.log(weight.sum()) + score.max())
    for t, label in itertools.product(range(5), range(3)):
        want = weight[[p[t] == label for p in paths]].sum() / weight.sum()
        assert np.isclose(probability[t, 0, label], want)


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    model = Tagger(3, hidden=3)
    model.p["move"] = rng.normal(0, 0.5, (3, 3))
    x, y = rng.integers(0, N_CLASSES, (2, 6)).astype(np.int8), rng.integers(0, 3, (2, 6)).astype(np.int8)
    _, g = model._gradients(x, y)
    for name, values in model.p.items():
        flat = values.reshape(-1)
        for i in np.flatnonzero(np.abs(g[name].reshape(-1)) > 1e-6)[:6]:
            kept = flat[i]
            flat[i] = kept + 1e-5
            up = model._gradients(x, y)[0]
            flat[i] = kept - 1e-5
            down = model._gradients(x, y)[0]
            flat[i] = kept
            assert np.isclose((up - down) / 2e-5, g[name].reshape(-1)[i], rtol=1e-3, atol=1e-6)


@pytest.fixture(scope="module")
def model(docs):
    return pii.fitted(docs, per_kind=600, steps=350)


def test_written_forms_are_found_in_unseen_windows(docs, model):
    rng, single = np.random.default_rng(99), model.single()
    texts = [r.text for r in docs.collect()]
    plain = [t[i : i + pii.WINDOW] for t in texts for i in (300, 900) if len(t) > i + 100 and not pii.CUE.search(t, i, i + pii.WINDOW)]
    found, clean, n = {k: 0 for k in range(-1, 4)}, 0, 0
    for i in range(500):
        kind = i % 5 - 1
        text, labels = pii.with_form(plain[i % len(plain)], kind, rng, ["house", "river", "peter"])
        base = pii.base_spans(text)
        got = base + pii.added(single, [text], [base])[0]
        at = np.flatnonzero(labels)
        found[kind] += (int(at[0]), kind, int(at[-1]) + 1) in got if kind >= 0 else not got
    assert found[-1] >= 98 and all(found[k] >= 85 for k in range(4)), found
    added = pii.added(single, plain, [[] for _ in plain])
    assert not any(added)


def test_overlapping_windows_agree_with_the_place_of_a_span(docs, model):
    """A form is found wherever it stands in a long text, once, also across the edges of windows."""
    single, lead = model.single(), "the old house by the river and "
    for n in range(0, 140, 7):
        text = (lead * 8)[: 100 + n].rstrip() + " call (017) 555-7713 now. " + lead * 4
        at = text.index("(017)")
        assert pii.added(single, [text], [pii.base_spans(text)]) == [[(at, 3, at + 14)]]


def test_reconciled_takes_the_heaviest_free_set():
    rng = np.random.default_rng(5)
    for _ in range(200):
        spans = {}
        for _ in range(int(rng.integers(0, 7))):
            a = int(rng.integers(0, 20))
            spans[(a, int(rng.integers(0, 4)), a + int(rng.integers(1, 8)))] = float(rng.integers(1, 50))
        base = [(8, 0, 10)] if rng.random() < 0.5 else []
        got = pii.reconciled(spans, base)
        free = [s for s in spans if all(s[2] <= b[0] or s[0] >= b[2] for b in base)]
        best = 0.0
        for k in range(len(free) + 1):
            for some in itertools.combinations(sorted(free), k):
                if all(x[2] <= y[0] for x, y in zip(some, some[1:])):
                    best = max(best, sum(spans[s] for s in some))
        assert sum(spans[s] for s in got) == best and set(got) <= set(free)
        assert all(x[2] <= y[0] for x, y in zip(got, got[1:]))


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_summary(odd_docs, no_docs, model, collect):
    rows = {r.text for r in odd_docs.collect()}
    got = collect(pii.summary(pii.find(odd_docs, model)))
    assert len(got) == odd_docs.count() and None in rows
    for r in got:
        assert [r[f"n_{k}"] for k in pii.KINDS] == [0, 0, 0, 0] and r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == ""
    assert collect(pii.summary(pii.find(no_docs, model))) == []


def test_summary_of_documents(docs, model, collect):
    got = {r["doc_id"]: r for r in collect(pii.summary(pii.find(docs, model)))}
    for r in docs.collect():
        base = plain_base(r.text)
        out = got[r.doc_id]
        assert [out[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        assert out["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest()
        assert set(joined(base).split(",")) <= set(out["spans"].split(","))


def test_fit_on_no_documents(no_docs):
    assert pii.fitted(no_docs, per_kind=20, steps=2).n_labels == pii.LABELS


def test_fit_does_not_depend_on_partitions(docs):
    few = docs.limit(50)
    a, b = (pii.fitted(few.repartition(n), per_kind=20, steps=3) for n in (1, 4))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)
