"""Personal data in whole texts: base patterns, and spans that a character tagger adds to them.

The tagger (``tagger.Tagger``: bidirectional LSTM with CRF transitions) learns from labelled windows: base
spans of a bounded sample of documents, and written forms of the four kinds (made by rule) set into
windows of that sample. It reads a text in windows of 96 characters every 48, so a span of up to 48
characters lies whole in one. Spans of overlapping windows are reconciled over the whole text: those that
touch no base span and are well formed (``well_formed``) compete, and the non-overlapping set with the
largest sum of label probabilities is added. Base spans always stay.

A span holds a digit, an at sign or a bracketed "at"; windows without one outside the base spans can add
nothing and are not read. Starts and ends count code points, ends exclusive.

Null and empty texts have no spans; repeated rows and null ids have rows of their own; an empty table
gives no rows (the tagger then learns from the made forms alone). Columns other than ``doc_id`` and
``text`` are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import small_batches, written
from linkloom.llm.tagger import PAD, Tagger, classes

# --- fixed values: kinds in their order, and the base patterns' parts ------------------------------
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Digits may not stand before an address: a match from within a run of digits ends where one from its start does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUE = re.compile(r"[0-9@]+|[(\[{]\s?[aA][tT]\s?[)\]}]")
# ---------------------------------------------------------------------------------------------------
WINDOW, STRIDE = 96, 48
LABELS = 1 + 2 * len(KINDS)  # none, then first and later character of each kind
DECODED = 2_048  # windows decoded at once
FOUND = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
SAMPLE = "kind string, window string, labels binary"
Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """All matches of the base patterns by start, kind and end; linear in the text."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        if (tail := DOMAIN.match(text, at)) is not None:
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                free = tail.end()
                out.append((start, 0, free))
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 38 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_AT = r"\s?(?:@|[(\[{]\s?at\s?[)\]}])\s?"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|\.)\s?[)\]}]\s?|\sdot\s|\spoint\s)"
_FORMS = (
    re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I),
    re.compile(r"[0-9]{1,3}(?:(?:\s?\.\s?|[\[({]\.[\])}])[0-9]{1,3}){3}"),
    re.compile(r"[0-9](?:[ ./_-]{0,3}[0-9])+"),
    re.compile(r"\(?\+?[0-9(][0-9 ()./-]+[0-9]"),
)


def well_formed(text: str, start: int, kind: int, end: int) -> bool:
    """Whether a tagged span can be what it is tagged as; it may not stand inside a word or a number."""
    span = text[start:end]
    if not _FORMS[kind].fullmatch(span) or text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum():
        return False
    digits = _digits(span)
    if kind == 1:
        return all(map(_small, re.findall("[0-9]+", span)))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:  # as a rule written in groups
        return 9 <= len(digits) <= 15 and len(re.findall("[0-9]+", span)) >= 3
    return True


def reconciled(candidates: dict[Span, float], base: list[Span]) -> list[Span]:
    """The candidates of largest total weight that overlap neither each other nor a base span."""
    free = []
    for s in sorted(candidates, key=lambda s: (s[2], s[0], s[1])):
        if all(s[2] <= b[0] or s[0] >= b[2] for b in base):
            free.append(s)
    ends, best = [s[2] for s in free], [(0.0, -1, 0)]  # weight so far, last span taken, best before it
    for i, s in enumerate(free):
        before = int(np.searchsorted(ends[:i], s[0], "right"))
        take = best[before][0] + candidates[s]
        best.append((take, i, before) if take > best[-1][0] else best[-1][:2] + (best[-1][2],))
    out, k = [], len(free)
    while k and best[k][1] >= 0:
        _, i, before = best[k]
        out.append(free[i])
        k = before
    return sorted(out)


def read_windows(text: str, base: list[Span]) -> list[int]:
    """Starts of the windows that hold a cue outside the base spans."""
    last, wanted = max(0, -(-(len(text) - WINDOW) // STRIDE)), set()
    for m in CUE.finditer(text):
        low, high = m.span()
        if any(b[0] <= low and high <= b[2] for b in base):
            continue
        wanted.update(range(min(last, max(0, low // STRIDE - 1)), min(last, (high - 1) // STRIDE) + 1))
    return [STRIDE * k for k in sorted(wanted)]


def rows_of(text: str, starts: list[int]) -> np.ndarray:
    """The classes of a text's windows, padded."""
    codes = classes(text)
    out = np.full((len(starts), WINDOW), PAD, np.int8)
    for row, s in zip(out, starts):
        row[: len(piece)] = (piece := codes[s : s + WINDOW])
    return out


def window_spans(model: Tagger, x: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """Per window its spans and the sum of their labels' probabilities."""
    e = model.emissions(x)
    labels = model.best(e)
    some = np.flatnonzero(labels.any(axis=1))
    out: list[list] = [[] for _ in x]
    if not len(some):
        return out
    probability = model.marginals(e[:, some])[0]
    for k, row in enumerate(some.tolist()):
        y, spans = labels[row].tolist(), []
        sure = probability[np.arange(len(y)), k, y].tolist()
        for i, label in enumerate(y):
            if label and spans and label % 2 == 0 and y[i - 1] in (label, label - 1) and i:
                start, kind, _, weight = spans[-1]
                spans[-1] = (start, kind, i + 1, weight + sure[i])
            elif label:
                spans.append((i, (label - 1) // 2, i + 1, sure[i]))
        out[row] = spans
    return out


def added(model: Tagger, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """What the model adds to the base spans of each text."""
    jobs = [(i, s) for i, (t, b) in enumerate(zip(texts, bases)) for s in read_windows(t, b)]
    found: list[dict] = [{} for _ in texts]
    for at in range(0, len(jobs), DECODED):
        some = jobs[at : at + DECODED]
        starts: dict[int, list] = {}
        for i, s in some:
            starts.setdefault(i, []).append(s)
        x = np.concatenate([rows_of(texts[i], own) for i, own in starts.items()])
        for (i, s), spans in zip(some, window_spans(model, x)):
            text = texts[i]
            for low, kind, high, weight in spans:
                if (low == 0 and s) or (high == WINDOW and s + high < len(text)):
                    continue  # cut by the window's edge: the next window has it whole
                low, high = low + s, min(high + s, len(text))
                while low < high and not (text[low].isalnum() or text[low] in "+("):
                    low += 1
                while low < high and not (text[high - 1].isalnum() or text[high - 1] == ")"):
                    high -= 1
                if low < high and well_formed(text, low, kind, high):
                    key = (low, kind, high)
                    found[i][key] = max(weight, found[i].get(key, 0.0))
    return [reconciled(f, b) for f, b in zip(found, bases)]


def made_form(kind: int, rng: np.random.Generator, words: list[str]) -> str:
    """One way of writing a value of the kind; kind -1: text with digits or signs that is no personal data."""

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    word = lambda: pick(*words).lower()
    if kind == 0:
        at = pick("@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ", "{at}", " {at} ")
        dot = "." if at == "@" else pick(".", "(dot)", " (dot) ", "[dot]", " [dot] ", " dot ", "[.]")
        name = pick(word(), f"{word()}.{digits(2)}", f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{digits(3)}", f"{word()}+{word()}")
        host = pick("mail", "web", "post", "example", word()) + pick("", digits(1), "-" + word())
        return name + at + host + dot + pick("", word() + dot, "example" + dot) + pick("com", "org", "net", "de", "es", "fr", "io", "edu")
    if kind == 1:
        return pick(".", ".", "[.]", "(.)", " . ").join(str(int(n)) for n in rng.integers(0, 256, 4))
    if kind == 2:
        n = pick(13, 14, 15, 16, 16, 16, 16, 19)
        number = digits(n - 1)
        number += next(d for d in "0123456789" if luhn(number + d))
        mark = pick("", "", " ", "-", ".", "/", "_")
        groups = pick([4] * 5, [4, 6, 9]) if mark else [n]
        cuts = np.cumsum([0, *groups])
        return mark.join(number[a:b] for a, b in zip(cuts, cuts[1:]) if number[a:b])
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        mark = pick("-", " ", ".", "/")
        return pick(
            f"+{digits(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}{mark}{c}", f"{a}{mark}{b}{mark}{c}", f"0{digits(2)}{mark}{b}{mark}{c}",
            f"00{digits(2)} {digits(2)} {b} {c}", f"+{digits(2)} {digits(2)} {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}", f"0{a}/{b} {c}",
        )
    return pick(
        digits(int(rng.integers(1, 9))), f"{digits(1)}.{digits(1)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}",
        f"1{digits(1)}/0{digits(1)}/20{digits(2)}", f"1{digits(1)}:{digits(2)}", f"{digits(3)},{digits(3)}.{digits(2)}", f"@{word()}", f"{digits(2)}%",
        "".join(pick(*"0123456789abcdef") for _ in range(int(rng.integers(12, 40)))), f"{digits(4)}-{digits(4)}", f"[{digits(1)}]", f"({digits(2)})",
        f"{word()}{digits(2)}", f"{digits(3)}.{digits(3)}", f"{word()} @ {word()}", f"#{digits(5)}", f"{digits(2)}-{digits(2)}", f"20{digits(2)}",
    )


def with_form(window: str, kind: int, rng: np.random.Generator, words: list[str]) -> tuple[str, np.ndarray]:
    """A window with a made form set between two of its words, and the labels."""
    form = made_form(kind, rng, words)
    spaces = [i for i, c in enumerate(window[: WINDOW - len(form) - 1]) if c in " \n"] or [0]
    at = spaces[int(rng.integers(len(spaces)))]
    lead = ["", " ", " (", ": ", "\n", ' "', ", "][int(rng.integers(7))] if at else ""
    if lead == "":
        lead = " " if at else ""
    tail = {" (": ") ", ' "': '" '}.get(lead, [" ", ". ", ", ", "\n", "; "][int(rng.integers(5))])
    text = (window[:at] + lead + form + tail + window[at + 1 :])[:WINDOW]
    labels = np.zeros(WINDOW, np.int8)
    if kind >= 0:
        low = at + len(lead)
        labels[low : low + len(form)] = 2 + 2 * kind
        labels[low] = 1 + 2 * kind
    return text, labels


def training_windows(docs: DataFrame, sample_docs: int, per_kind: int) -> list:
    """Distinct windows of a sample of about ``sample_docs`` documents, ``per_kind`` at most of each kind.

    Kinds: ``span`` (holds base spans, labelled), ``cue`` (digits or signs outside them), ``plain``. Texts
    and windows are chosen by their hashes, so copies count once and partitions do not matter.
    """
    n = docs.count()
    bound = min(1 << 20, -(-(sample_docs << 20) // max(1, n)))
    chosen = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text") != "")
    chosen = chosen.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < bound)

    def cut(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                place = zlib.crc32(text[:200].encode("utf-8", "surrogatepass"))
                for start, _, end in base[:8]:
                    low = max(0, start - place % max(1, WINDOW - (end - start)))
                    own = [b for b in base if low <= b[0] and b[2] <= low + WINDOW]
                    if not any(b[0] < low < b[2] or b[0] < low + WINDOW < b[2] for b in base):
                        labels = np.zeros(WINDOW, np.int8)
                        for s, kind, e in reversed(own):  # of overlapping kinds the one listed first
                            labels[s - low : e - low] = 2 + 2 * kind
                            labels[s - low] = 1 + 2 * kind
                        rows.append(("span", text[low : low + WINDOW], labels.tobytes()))
                for low in read_windows(text, base)[:4]:
                    if all(b[2] <= low or b[0] >= low + WINDOW for b in base):
                        rows.append(("cue", text[low : low + WINDOW], bytes(WINDOW)))
                low = place % max(1, len(text) - WINDOW)
                if not CUE.search(text, low, low + WINDOW):
                    rows.append(("plain", text[low : low + WINDOW], bytes(WINDOW)))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "window", "labels"])

    with small_batches(docs.sparkSession):
        windows = written(chosen.mapInArrow(cut, SAMPLE), "pii-sample").dropDuplicates(["window"])
    keyed = windows.withColumn("_key", F.xxhash64("window"))
    out = []
    for kind in ("span", "cue", "plain"):
        out += keyed.where(F.col("kind") == kind).orderBy("_key", "window").limit(per_kind).collect()
    return out


def fitted(docs: DataFrame, sample_docs: int = 20_000, per_kind: int = 1_000, steps: int = 500, seed: int = 11) -> Tagger:
    """The tagger, trained on at most ``3 * per_kind`` windows of the sample and as many with made forms."""
    rng = np.random.default_rng(seed)
    rows = training_windows(docs, sample_docs, per_kind)
    x = [(r.window, np.frombuffer(r.labels, np.int8)) for r in rows if r.kind != "plain"]
    plain = [r.window for r in rows if r.kind == "plain"] or ["some words stand here and some more words stand there so that it is long enough"]
    words = sorted({w for t in plain for w in re.findall("[a-z]{2,9}", t)})[:: max(1, len(plain) // 100)] or ["name", "box", "post"]
    for i in range(3 * per_kind):
        x.append(with_form(plain[i % len(plain)], max(-1, i % 6 - 2), rng, words))
    model = Tagger(LABELS)
    texts = np.concatenate([rows_of(t, [0]) for t, _ in x])
    model.fit(texts, np.stack([y for _, y in x]), steps=steps, seed=seed)
    return model


def find(docs: DataFrame, model: Tagger) -> DataFrame:
    """``doc_id, spans``: per row all spans by start, kind and end; ``base`` marks those of the base patterns."""
    known = docs.sparkSession.sparkContext.broadcast(model.single())
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def tag(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            bases = [base_spans(t) for t in texts]
            more = added(known.value, texts, bases)
            out = []
            for base, new in zip(bases, more):
                every = sorted([(*s, True) for s in base] + [(*s, False) for s in new])
                out.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in every])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tag, FOUND)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, the hash of the base spans, and all spans."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
