"""Phrase collocations from counts of word windows kept in weighted acyclic automata.

A shard (one slice of texts of one language) takes the window of every word: the word and the two after
it in its piece, an end mark where the piece ends. The sorted distinct windows build a ``Transducer``
state by state: as the sorted prefix moves on, its state is frozen and looked up among the frozen ones,
so equal suffixes are stored once. A prefix weighs what all windows under it weigh, so one automaton has
the counts of words, pairs and triples.

Shards are cut by prefix range: ranges of first words of about ``range_tokens`` words each, found from
exact word counts; where a word (or all ranges, once their number is at its bound) holds more, the range
is cut further by a hash of the second word, and for pairs with many windows of the third word too. A shard
meets the more ranges the larger the table, so all its pieces are made at once and packed side by side,
and all pieces of a range are read at once. Automata of one range are united, weights summed. Phrases of
``min_count`` or more are the candidates; their parts are looked up by composing them with
automata of the parts, again by prefix range, requests of a hot range being spread over salted copies.

A null language is ``und``; null and empty texts have no words; repeated rows count as often as they
occur; ties are ranked by count, then phrase. An empty table gives no rows. Columns other than ``lang``
and ``text`` are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import give_back, in_order, part_offsets, small_batches, tidy, written

NO_LANG = "und"
END = ""  # stands for "no further word of the piece"; no word is empty
BLANKS, CUTS = b" \t", b".,;:!?\n\x0b\x0c\r"
SLICE_BYTES = 3 << 19
RANGE_TOKENS = 700_000
MAX_RANGES = 50_000  # bounds sent to every task; ranges of more tokens are cut by hash, so tasks do not grow
SOME_TASKS = 2_000  # tasks that unite cells: one per cell up to so many, or as many as Spark is set to
REQUESTS = 500_000  # part lookups of one range that one task answers
CELLS = "range int, share int, lang string, letters binary, automaton binary"
COUNTED = "lang string, w1 string, w2 string, w3 string, a long, whole boolean"

HEAD = np.dtype([("n", "<u4"), ("width", "u1")])

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(CUTS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def windows(texts: pa.Array) -> tuple[pa.Array, list[np.ndarray]]:
    """The words of the texts, sorted after the end mark, and per word the numbers of its window."""
    wide = pa.large_string()
    joined = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(wide), pa.scalar("\n", wide), pa.scalar("", wide))
    raw, _ = _letters(joined)
    kind = np.concatenate([[np.uint8(2)], _KIND[raw], [np.uint8(2)]])
    inside = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    letters = _LOWER[raw[inside[1:-1]]]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters))
    labels, first = numbered([pa.array([END], pa.large_string()), words])
    first = first[1:]
    piece = np.searchsorted(np.flatnonzero(kind == 2), starts, "right")
    codes = [first]
    for ahead in (1, 2):
        later = np.zeros_like(first)
        later[:-ahead] = np.where(piece[ahead:] == piece[:-ahead], first[ahead:], 0)
        codes.append(later)
    return labels, codes


class Transducer:
    """Three words to a weight: arcs from the root, from first-level and from second-level states.

    ``labels`` are sorted and start with the end mark. A state's arcs lie between its two offsets; equal
    states of a level are one.
    """

    def __init__(self, labels: pa.Array, root: list, first: list, second: list):
        self.labels = labels
        self.root, self.first, self.second = root, first, second  # (label, state), (offsets, label, state), (offsets, label, weight)

    @classmethod
    def build(cls, labels: pa.Array, codes: list[np.ndarray], weights: np.ndarray) -> Transducer:
        """From sorted distinct windows."""
        a, b, c = codes
        states, offsets, at = _frozen(_changes(a, b), c, weights)
        second = [offsets, c[at], weights[at]]
        pairs = _changes(a, b)
        a, b = a[pairs], b[pairs]
        heads = _changes(a)
        firsts, offsets, at = _frozen(heads, b, states)
        return cls(labels, [a[heads], firsts], [offsets, b[at], states[at]], second)

    @classmethod
    def counted(cls, labels: pa.Array, codes: list[np.ndarray], weights: np.ndarray | None = None) -> Transducer:
        """From windows in any order; the weights of equal ones (1 each by default) are summed."""
        order, same = _sorted(codes, len(labels))
        heads = np.flatnonzero(~same)
        weights = np.ones(len(order), np.int64) if weights is None else weights[order]
        summed = np.add.reduceat(weights, heads, dtype=np.int64) if len(heads) else weights.astype(np.int64)
        return cls.build(labels, [c[order[heads]] for c in codes], summed)

    @classmethod
    def union(cls, parts: list[Transducer]) -> Transducer:
        """One automaton whose weights are the sums over all parts, each one automaton or many side by side.

        ``parts`` is emptied on the way, so that few are held twice.
        """
        labels, new = numbered([p.labels for p in parts])
        base, codes, weights = len(new), [], []
        while parts:
            p = parts.pop()
            *own, weight = p.entries()
            base -= len(p.labels)
            codes.append([new[base + c] for c in own])
            weights.append(weight)
        return cls.counted(labels, [np.concatenate(c) for c in zip(*codes)], np.concatenate(weights))

    def entries(self) -> list[np.ndarray]:
        """All windows in order, and their weights."""
        (a, s), (offsets, label, state), (offsets2, label2, weight) = self.root, self.first, self.second
        at, n = _gather(offsets, s)
        a, b, t = np.repeat(a, n), label[at], state[at]
        at, n = _gather(offsets2, t)
        return [np.repeat(a, n), np.repeat(b, n), label2[at], weight[at]]

    def pairs(self) -> list[np.ndarray]:
        """All pairs in order, and the number of windows of each."""
        (a, s), (offsets, label, state) = self.root, self.first
        at, n = _gather(offsets, s)
        return [np.repeat(a, n), label[at], np.diff(self.second[0])[state[at]]]

    def weights_of(self, phrases: list[pa.Array]) -> np.ndarray:
        """Composition with three-word phrases (end marks included): the weight of each, 0 if unknown."""
        codes = [pc.index_in(p.cast(pa.large_string()), value_set=self.labels) for p in phrases]
        known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in codes])
        a, b, c = (pc.fill_null(x, 0).to_numpy().astype(np.int64) for x in codes)
        out, wide = np.zeros(len(a), np.int64), np.int64(len(self.labels) + 1)
        if not len(self.root[0]):
            return out
        state, found = _arc(self.root[0], self.root[1], a)
        known &= found
        for (offsets, label, target), word in ((self.first, b), (self.second, c)):
            source = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            state, found = _arc(source * wide + label, target, state * wide + word)
            known &= found
        out[known] = state[known]
        return out

    def cut(self, key: np.ndarray, entries: list[np.ndarray]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """The automata of the entries of each key, with the labels they use: a row of each key, and their letters and numbers.

        All are built as one, each with labels of its own, so that no state is shared between two: the work
        grows with the entries and hardly with the number of keys.
        """
        order = np.argsort(key, kind="stable")
        heads, wide = _changes(key[order]), np.int64(len(self.labels))
        base = np.repeat(np.arange(len(heads)) * wide, np.diff(np.append(heads, len(order))))
        *codes, weights = (e[order] for e in entries)
        places = [base + c for c in codes]
        used = np.sort(np.concatenate([np.arange(len(heads)) * wide, *places]))
        used = used[_changes(used)]
        labels = self.labels.take(pa.array(used % wide))
        own = Transducer.build(labels, [np.searchsorted(used, p) for p in places], weights)
        return order[heads], *own.apart(np.bincount(used // wide))

    def apart(self, n: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Letters and numbers of automata that stand side by side, with ``n`` labels each."""
        letters, ends = _letters(self.labels)
        (a, s), (offsets, label, state), (offsets2, label2, weight) = self.root, self.first, self.second
        n1, n2, first = np.diff(offsets), np.diff(offsets2), _offsets(n)
        arc = np.repeat(np.arange(len(n)), np.diff(np.searchsorted(a, first)))  # the automaton of each arc and state
        state1, state2 = np.empty(len(n1), np.int64), np.empty(len(n2), np.int64)
        state1[s] = arc
        arc1 = np.repeat(state1, n1)
        state2[state] = arc1
        arc2 = np.repeat(state2, n2)
        owners = [np.repeat(np.arange(len(n)), n), arc, arc, state1, arc1, arc1, state2, arc2, arc2]
        sizes = [np.bincount(o, minlength=len(n)) for o in owners]
        low, low1, low2 = first[:-1], _offsets(sizes[3])[:-1], _offsets(sizes[6])[:-1]
        numbers = [np.diff(ends), a - low[arc], s - low1[arc], n1, label - low[arc1], state - low2[arc1], n2, label2 - low[arc2], weight]
        cuts = ends[first]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(letters)]), packed(numbers, sizes)

    @classmethod
    def side_by_side(cls, letters: pa.Array, numbers: pa.Array) -> Transducer:
        """Automata that were set apart as one: labels, states and arcs of each follow those of the one before."""
        (lengths, a, s, n1, label1, state1, n2, label2, weight2), sizes = unpacked(numbers, 9)
        low, low1, low2 = (_offsets(sizes[k])[:-1] for k in (0, 3, 6))
        for values, k, base in ((a, 1, low), (s, 2, low1), (label1, 4, low), (state1, 5, low2), (label2, 7, low)):
            values += np.repeat(base.astype(values.dtype), sizes[k])
        bytes_of, _ = _letters(letters.cast(pa.large_binary()))
        labels = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(_offsets(lengths)), pa.py_buffer(bytes_of))
        return cls(labels, [a, s], [_offsets(n1), label1, state1], [_offsets(n2), label2, weight2])

    def to_bytes(self) -> bytes:
        letters, ends = _letters(self.labels)
        arrays = [np.diff(ends), letters, self.root[0], self.root[1]]
        for offsets, label, target in (self.first, self.second):
            arrays += [np.diff(offsets), label, target]
        # Each array in the smallest type that holds it.
        small = [x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8) for x in arrays]
        head = np.array([[len(x), x.itemsize] for x in small], "<i8")
        return head.tobytes() + b"".join(x.tobytes() for x in small)

    @classmethod
    def from_bytes(cls, blob: bytes) -> Transducer:
        head, at, arrays = np.frombuffer(blob, "<i8", 20).reshape(10, 2), 160, []
        for n, size in head.tolist():
            arrays.append(np.frombuffer(blob, f"<u{size}", n, at).astype(np.uint8 if len(arrays) == 1 else np.int64 if size > 3 else np.int32))
            at += n * size
        sizes, letters, a, s, n1, label1, state1, n2, label2, weight2 = arrays
        labels = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(_offsets(sizes)), pa.py_buffer(letters))
        return cls(labels, [a, s], [_offsets(n1), label1, state1], [_offsets(n2), label2, weight2])


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an array one after the other, and where each ends, 0 first."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _plain(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


def numbered(words: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words, sorted, and the number of each word of the arrays, one after the other."""
    coded = pa.concat_arrays(words).dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Places where a run of equal rows starts."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _sorted(codes: list[np.ndarray], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the windows, and which of them equal the one before."""
    if wide < 1 << 21:  # three numbers fit one of 64 bits
        key = (codes[0].astype(np.int64) * wide + codes[1]) * wide + codes[2]
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.concatenate([[False], key[1:] == key[:-1]])[: len(key)]
        return order, same
    order = np.lexsort(codes[::-1])
    rows = [c[order] for c in codes]
    same = np.logical_and.reduce([np.concatenate([[False], c[1:] == c[:-1]])[: len(c)] for c in rows])
    return order, same


def _gather(offsets: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The arcs of the given states one after the other, and how many each has."""
    n = offsets[states + 1] - offsets[states]
    return _spread(offsets[states], n), n


def packed(arrays: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    """A blob per group: its numbers of all arrays, each in as few bytes as hold the largest of group and array.

    An array lists the numbers of all groups one after the other, ``sizes`` tells how many of each.
    """
    head = np.zeros((len(sizes[0]), len(arrays)), HEAD)
    parts = []
    for k, (x, n) in enumerate(zip(arrays, sizes)):
        top, full = np.zeros(len(n), np.int64), n > 0
        top[full] = np.maximum.reduceat(x, (np.cumsum(n) - n)[full]) if full.any() else 0
        width = np.searchsorted(1 << 8 * np.arange(8), top, "right")
        head["n"][:, k], head["width"][:, k] = n, width
        wide = int(width.max(initial=0))
        bytes_of = x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :wide]
        parts.append(bytes_of[np.arange(wide) < np.repeat(width, n)[:, None]])
    # The bytes of one group stand together: its head, then its part of each array.
    lengths = np.concatenate([np.full((len(head), 1), HEAD.itemsize * len(arrays)), head["n"].astype(np.int64) * head["width"]], axis=1)
    offsets = _offsets(lengths.ravel())
    starts, out = offsets[:-1].reshape(lengths.shape), np.empty(offsets[-1], np.uint8)
    for k, part in enumerate([head.view(np.uint8).ravel(), *parts]):
        out[_spread(starts[:, k], lengths[:, k])] = part
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(head), [None, pa.py_buffer(offsets[:: lengths.shape[1]].copy()), pa.py_buffer(out)])


def unpacked(blobs: pa.Array, arrays: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The arrays and sizes that were packed."""
    raw, ends = _letters(blobs.cast(pa.large_binary()))
    head = raw[ends[:-1, None] + np.arange(HEAD.itemsize * arrays)].view(HEAD)
    at, out = ends[:-1] + HEAD.itemsize * arrays, []
    for k in range(arrays):
        n, width = head["n"][:, k].astype(np.int64), head["width"][:, k].astype(np.int64)
        wide = 4 if width.max(initial=0) < 4 else 8
        numbers = np.zeros((n.sum(), wide), np.uint8)
        numbers[np.arange(wide) < np.repeat(width, n)[:, None]] = raw[_spread(at, n * width)]
        out.append(numbers.view(f"<i{wide}").ravel())
        at = at + n * width
    return out, [head["n"][:, k].astype(np.int64) for k in range(arrays)]


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` places from each start on."""
    return np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


def _frozen(heads: np.ndarray, label: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Freezes runs of arcs as states: the state of each run, the states' offsets, the places of their arcs.

    A run that equals an earlier one becomes the same state; states are numbered as they come up. Runs of
    one arc are compared as numbers, longer ones by their bytes.
    """
    sizes = np.diff(np.append(heads, len(label)))
    first = np.arange(len(heads))  # the first run that equals each
    single = np.flatnonzero(sizes == 1)
    at = heads[single]
    wide = int(label.max(initial=0)) + 1
    _, pick, number = np.unique(target[at].astype(np.int64) * wide + label[at], return_index=True, return_inverse=True)
    first[single] = single[pick[number]]
    register: dict[bytes, int] = {}
    longer = np.flatnonzero(sizes > 1)
    arcs = np.stack([label, target], axis=1)
    first[longer] = [register.setdefault(arcs[low : low + n].tobytes(), run) for run, low, n in zip(longer.tolist(), heads[longer].tolist(), sizes[longer].tolist())]
    new = first == np.arange(len(first))
    kept = np.flatnonzero(new)
    places, _ = _gather(np.append(heads, len(label)), kept)
    return (np.cumsum(new) - 1)[first], _offsets(sizes[kept]), places


def _arc(keys: np.ndarray, targets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The target under each wanted key, and whether there is one. ``keys`` are sorted."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return targets[at], keys[at] == wanted


def shards(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``lang, automaton``: one row per slice of a partition's texts in one language, written."""
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("string").alias("text")
    )

    def build(batches):
        held: dict[str, list] = {}  # texts of each language that wait for more
        sizes: dict[str, int] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for lang in pc.unique(rows.column("lang")).to_pylist():
                texts = rows.filter(pc.equal(rows.column("lang"), lang)).column("text").combine_chunks()
                first, ends = 0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
                while first < len(texts):  # as many texts as fit, one at least
                    base = int(ends[first - 1]) if first else 0
                    room = slice_bytes - sizes.get(lang, 0)
                    stop = max(first + 1, int(np.searchsorted(ends, base + room, "right")))
                    held.setdefault(lang, []).append(texts.slice(first, stop - first))
                    sizes[lang] = sizes.get(lang, 0) + int(ends[stop - 1]) - base
                    first = stop
                    if sizes[lang] >= slice_bytes or first < len(texts):
                        yield from made(lang, held.pop(lang))
                        del sizes[lang]
            while sum(sizes.values()) > 4 * slice_bytes:
                lang = max(sizes, key=sizes.get)
                yield from made(lang, held.pop(lang))
                del sizes[lang]
        for lang, texts in held.items():
            yield from made(lang, texts)

    def made(lang, texts):
        labels, codes = windows(pa.concat_arrays(texts))
        if len(codes[0]):
            blob = Transducer.counted(labels, codes).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([blob], pa.binary())], ["lang", "automaton"])

    with small_batches(docs.sparkSession):
        return written(rows.mapInArrow(tidy(build), "lang string, automaton binary"), "phrase-shards", 8 << 20, "zstd")


def word_counts(made: DataFrame) -> DataFrame:
    """``lang, word, f`` over all shards, written."""

    def roots(batches):
        for batch in batches:
            for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("automaton")):
                t = Transducer.from_bytes(blob.as_py())
                first, *_, weight = t.entries()
                heads = _changes(first)
                words = t.labels.take(pa.array(first[heads])).cast(pa.string())
                f = pa.array(np.add.reduceat(weight, heads, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), words, f], ["lang", "word", "f"])

    with small_batches(made.sparkSession, 1):
        rows = made.mapInArrow(tidy(roots), "lang string, word string, f long")
        return written(rows.groupBy("lang", "word").agg(F.sum("f").alias("f")), "phrase-words")


class Ranges:
    """Prefix ranges of first words: where each starts, and into how many shares it is cut."""

    def __init__(self, starts: list[tuple[str, bytes]], shares: list[int]):
        self.starts, self.shares = starts, np.array(shares, np.int64)
        self.langs = [s[0] for s in starts]

    def of(self, lang: str, words: list[bytes]) -> np.ndarray:
        """The range of each of the sorted words of a language."""
        low = bisect_left(self.langs, lang.encode())
        high = low
        places = []
        while high < len(self.langs) and self.langs[high] == lang.encode():
            places.append(bisect_left(words, self.starts[high][1]))
            high += 1
        return np.maximum(low + np.searchsorted(np.array(places, np.int64), np.arange(len(words)), "right") - 1, 0)


def ranges(words: DataFrame, range_tokens: int = RANGE_TOKENS) -> Ranges:
    """Ranges of about ``range_tokens`` word occurrences, at most about ``MAX_RANGES``.

    Sizes are estimated from all frequent words and one in 64 of the rest, counted 64 times.
    """
    total = words.agg(F.sum("f")).first()[0] or 0
    step = max(range_tokens, -(-total // MAX_RANGES))
    frequent = F.col("f") >= step // 1000
    some = words.where(frequent | (F.pmod(F.xxhash64("lang", "word"), F.lit(64)) == 0))
    some = some.withColumn("f", F.when(frequent, F.col("f")).otherwise(64 * F.col("f")))
    placed = in_order(some, ["lang", "word"], "phrase-words-sorted")
    before = written(part_offsets(placed, "f"), "phrase-parts")
    own = "sum(f) OVER (PARTITION BY _part ORDER BY _row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    at = placed.withColumn("_own", F.coalesce(F.expr(own), F.lit(0))).join(before, "_part")
    at = at.withColumn("_at", F.col("_own") + F.col("_before")).withColumn("_range", F.floor(F.col("_at") / step))
    firsts = at.groupBy("_range").agg(F.min_by(F.struct("lang", "word", "_at"), "_at").alias("s")).orderBy("_range")
    rows = [r.s for r in firsts.collect()]  # MAX_RANGES rows at most
    end = at.agg(F.max(F.col("_at") + F.col("f"))).first()[0] or 0
    sizes = np.diff([r._at for r in rows] + [end])
    starts = [(r.lang.encode(), r.word.encode()) for r in rows]
    return Ranges(starts, [max(1, round(int(n) / range_tokens)) for n in sizes])


class HotPairs:
    """Pairs of words whose windows are too many for one share of a range."""

    def __init__(self, rows: list):
        self.of_lang: dict[str, list[pa.Array]] = {}
        for lang in {r.lang for r in rows}:
            own = [(r.w1, r.w2) for r in rows if r.lang == lang]
            self.of_lang[lang] = [pa.array(words, pa.large_string()) for words in zip(*own)]

    def among(self, lang: str, labels: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of label numbers are hot."""
        if lang not in self.of_lang:
            return np.zeros(len(a), bool)
        codes = [pc.index_in(words, value_set=labels) for words in self.of_lang[lang]]
        known = pc.and_(*(c.is_valid() for c in codes))
        first, second = (c.filter(known).to_numpy().astype(np.int64) for c in codes)
        return np.isin(a.astype(np.int64) * len(labels) + b, first * len(labels) + second)


def hot_pairs(made: DataFrame, bounds: Ranges, range_tokens: int = RANGE_TOKENS) -> HotPairs:
    """All pairs with half of ``range_tokens`` windows or more in ranges that are cut into shares, and none below a quarter.

    A shard names the pairs with more than the shards' share of a quarter: what it leaves out of a pair is less than
    a quarter over all shards. At most four pairs for each ``range_tokens`` windows come to the driver.
    """
    if (bounds.shares == 1).all():
        return HotPairs([])
    known = made.sparkSession.sparkContext.broadcast(bounds)
    least = max(1, range_tokens // (4 * made.count()))

    def named(batches):
        ranges = known.value
        for batch in batches:
            for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("automaton")):
                t = Transducer.from_bytes(blob.as_py())
                a, b, n = t.pairs()
                split = ranges.shares[ranges.of(lang, _plain(t.labels))] > 1
                at = np.flatnonzero((n >= least) & split[a])
                words = [t.labels.take(pa.array(x[at])).cast(pa.string()) for x in (a, b)]
                columns = [pa.array([lang] * len(at), pa.string()), *words, pa.array(n[at], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "w1", "w2", "windows"])

    with small_batches(made.sparkSession, 1):
        rows = made.mapInArrow(tidy(named), "lang string, w1 string, w2 string, windows long")
        large = rows.groupBy("lang", "w1", "w2").agg(F.sum("windows").alias("windows")).where(F.col("windows") >= range_tokens // 4)
        return HotPairs(large.select("lang", "w1", "w2").collect())


def counts(made: DataFrame, bounds: Ranges, min_count: int, range_tokens: int = RANGE_TOKENS) -> tuple[DataFrame, DataFrame]:
    """``lang, w1, w2, a`` and ``lang, w1, w2, w3, a`` of all pairs and triples met ``min_count`` times or more."""
    known = made.sparkSession.sparkContext.broadcast((bounds, hot_pairs(made, bounds, range_tokens)))

    def cut(batches):
        ranges, hot = known.value
        for batch in batches:
            for lang, blob in zip(batch.column("lang").to_pylist(), batch.column("automaton")):
                whole = Transducer.from_bytes(blob.as_py())
                words = _plain(whole.labels)
                entries = whole.entries()
                number = ranges.of(lang, words)[entries[0]]
                shares = ranges.shares[number]
                share = np.zeros(len(number), np.int64)
                if (split := shares > 1).any():
                    crc = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
                    third = np.where(hot.among(lang, whole.labels, *entries[:2]), crc[entries[2]], 0)
                    share[split] = (crc[entries[1][split]] * 31 + third[split]) % shares[split]
                rows, letters, automata = whole.cut(number * (int(shares.max()) + 1) + share, entries)
                columns = [pa.array(number[rows], pa.int32()), pa.array(share[rows], pa.int32()), pa.array([lang] * len(rows))]
                columns += [letters.cast(pa.binary()), automata.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["range", "share", "lang", "letters", "automaton"])

    def unite(rows: pa.Table) -> pa.Table:
        out, hot = [], known.value[1]
        for lang in pc.unique(rows.column("lang")).to_pylist():
            own = rows.filter(pc.equal(rows.column("lang"), lang)).select(["letters", "automaton"]).combine_chunks()
            t = Transducer.union([Transducer.side_by_side(*(c.combine_chunks() for c in own.columns))])
            a, b, c, weight = t.entries()
            heads = _changes(a, b)
            sums = np.add.reduceat(weight, heads, dtype=np.int64)
            # A pair is complete here, but for hot ones: their shares are summed later.
            cut_up = hot.among(lang, t.labels, a[heads], b[heads])
            pairs = (b[heads] > 0) & ((sums >= min_count) | cut_up)
            triples = (c > 0) & (weight >= min_count)
            for keep, at, f, whole in ((pairs, heads, sums, ~cut_up), (triples, np.arange(len(c)), weight.astype(np.int64), np.ones(len(c), bool))):
                at, f = at[keep], f[keep]
                words = [t.labels.take(pa.array(x[at])) for x in (a, b, c)]
                if keep is pairs:
                    words[2] = pa.nulls(len(at), pa.string())
                columns = [pa.array([lang] * len(at), pa.string()), *(w.cast(pa.string()) for w in words), pa.array(f)]
                out.append(pa.Table.from_arrays([*columns, pa.array(whole[keep])], ["lang", "w1", "w2", "w3", "a", "whole"]))
        give_back()
        return pa.concat_tables(out)

    tasks = max(int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(SOME_TASKS, int(bounds.shares.sum())))
    # About one shard to a batch of the first step, many cells to one of the second.
    with small_batches(made.sparkSession, 10_000, "1m"):
        cells = made.mapInArrow(tidy(cut), CELLS).repartition(tasks, "range", "share")
        found = written(cells.groupBy("range", "share").applyInArrow(unite, COUNTED), "phrase-counts")
    pairs = found.where("w3 IS NULL")
    summed = pairs.where("NOT whole").groupBy("lang", "w1", "w2").agg(F.sum("a").alias("a")).where(F.col("a") >= min_count)
    triples = found.where("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", "a")
    return pairs.where("whole").select("lang", "w1", "w2", "a").unionByName(summed), triples


def parts_looked_up(phrases: DataFrame, parts: DataFrame, bounds: Ranges, per_task: int = REQUESTS) -> DataFrame:
    """``phrases(lang, w1, w2, w3, a)`` with ``l1, r1`` (cut after one word) and ``l2, r2`` (after two, triples only).

    ``parts(lang, w1, w2, f)`` are the counted words (``w2`` empty) and pairs. Requests go to the range of
    their part's first word; a range with many gets as many copies of its parts.
    """
    known = phrases.sparkSession.sparkContext.broadcast(bounds)

    def ranged(batches):
        for batch in batches:
            number = np.empty(batch.num_rows, np.int32)
            langs, firsts = batch.column("lang").to_pylist(), batch.column("w1").to_pylist()
            of: dict[str, set] = {}
            for lang, word in zip(langs, firsts):
                of.setdefault(lang, set()).add(word.encode())
            numbers = {}
            for lang, some in of.items():
                some = sorted(some)
                numbers |= {(lang, w): n for w, n in zip(some, known.value.of(lang, some).tolist())}
            number = [numbers[lang, w.encode()] for lang, w in zip(langs, firsts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number, pa.int32())], [*batch.schema.names, "range"])

    single = F.col("w3").isNull()
    asked = {
        "l1": F.struct(F.col("w1").alias("p1"), F.lit(END).alias("p2")),
        "r1": F.struct(F.col("w2").alias("p1"), F.coalesce("w3", F.lit(END)).alias("p2")),
        "l2": F.when(~single, F.struct(F.col("w1").alias("p1"), F.col("w2").alias("p2"))),
        "r2": F.when(~single, F.struct(F.col("w3").alias("p1"), F.lit(END).alias("p2"))),
    }
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("slot"), p.alias("part")) for n, p in asked.items()))).alias("q")
    requests = phrases.select("lang", "w1", "w2", "w3", "a", each).where("q.part IS NOT NULL").select(
        "lang", F.col("q.part.p1").alias("w1"), F.col("q.part.p2").alias("w2"), F.struct("w1", "w2", "w3", "a").alias("phrase"), F.col("q.slot").alias("slot")
    )
    requests = written(requests.mapInArrow(tidy(ranged), "lang string, w1 string, w2 string, phrase struct<w1:string,w2:string,w3:string,a:long>, slot string, range int"), "phrase-requests")
    copies = requests.groupBy("range").agg(F.ceil(F.count("*") / per_task).cast("int").alias("copies"))
    copies = F.broadcast(written(copies, "phrase-copies"))  # MAX_RANGES rows at most
    salted = requests.join(copies, "range").withColumn("salt", F.pmod(F.xxhash64("lang", "phrase"), "copies").cast("int"))
    held = parts.mapInArrow(tidy(ranged), "lang string, w1 string, w2 string, f long, range int").join(copies, "range")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def compose(parts: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for lang in pc.unique(asked.column("lang")).to_pylist():
            own = parts.filter(pc.equal(parts.column("lang"), lang))
            rows = asked.filter(pc.equal(asked.column("lang"), lang))
            words = [own.column(c).combine_chunks().cast(pa.large_string()) for c in ("w1", "w2")]
            labels, codes = numbered([pa.array([END], pa.large_string()), *words])
            n = own.num_rows
            codes = [codes[1 : n + 1], codes[n + 1 :], np.zeros(n, np.int64)]
            t = Transducer.counted(labels, codes, own.column("f").to_numpy())
            ends = pa.array([END] * rows.num_rows, pa.large_string())
            f = t.weights_of([rows.column("w1").combine_chunks(), rows.column("w2").combine_chunks(), ends])
            out.append(rows.select(["lang", "phrase", "slot"]).append_column("f", pa.array(f)))
        give_back()
        return pa.concat_tables(out) if out else empty.empty_table()

    answer = "lang string, phrase struct<w1:string,w2:string,w3:string,a:long>, slot string, f long"
    words = [(n, pa.string()) for n in ("w1", "w2", "w3")]
    empty = pa.schema([("lang", pa.string()), ("phrase", pa.struct([*words, ("a", pa.int64())])), ("slot", pa.string()), ("f", pa.int64())])
    got = held.select("range", "salt", "lang", "w1", "w2", "f").groupBy("range", "salt").cogroup(
        salted.select("range", "salt", "lang", "w1", "w2", "phrase", "slot").groupBy("range", "salt")
    ).applyInArrow(compose, answer)
    slots = [F.max(F.when(F.col("slot") == n, F.col("f"))).alias(n) for n in asked]
    return got.groupBy("lang", "phrase").agg(*slots).select("lang", "phrase.*", *asked)


def mined(docs: DataFrame, min_count: int = 10, inside_percent: int = 50, top: int = 2_000, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """Each language's best phrases: ``lang, rank, phrase, a, l, r, n, score``."""
    made = shards(docs)
    words = word_counts(made)
    bounds = ranges(words, range_tokens)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    pairs, triples = counts(made, bounds, min_count, range_tokens)
    pairs = written(pairs, "phrase-pairs")
    parts = words.where(F.col("f") >= min_count).select("lang", F.col("word").alias("w1"), F.lit(END).alias("w2"), "f")
    parts = parts.unionByName(pairs.select("lang", "w1", "w2", F.col("a").alias("f")))
    longer = triples.select("lang", "a", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    longer = longer.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("_most"))
    left = pairs.join(longer, ["lang", "w1", "w2"], "left").where(
        F.col("_most").isNull() | (F.lit(100) * F.col("_most") < F.lit(inside_percent) * F.col("a"))
    )
    phrases = left.select("lang", "w1", "w2", F.lit(None).cast("string").alias("w3"), "a").unionByName(triples)
    found = parts_looked_up(phrases, parts, bounds)
    # Exact: products of counts have more than 64 bits; these types hold them up to 10^15 occurrences of a phrase.
    cut = "(1000000 * cast(a AS decimal(15,0)) * cast(a AS decimal(15,0))) div (cast({l} AS decimal(18,0)) * cast({r} AS decimal(18,0)))"
    one, two = (F.expr(cut.format(l=f"l{k}", r=f"r{k}")) for k in (1, 2))
    scored = found.withColumns({"_one": one, "_two": two}).withColumn("_second", F.coalesce(F.col("_two") < F.col("_one"), F.lit(False)))
    scored = scored.select(
        "lang",
        F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"),
        "a",
        F.when(F.col("_second"), F.col("l2")).otherwise(F.col("l1")).alias("l"),
        F.when(F.col("_second"), F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.when(F.col("_second"), F.col("_two")).otherwise(F.col("_one")).alias("score"),
    )
    # The best of each share of a language first, so that no language is ranked in one task as a whole.
    best = "row_number() OVER (PARTITION BY lang{share} ORDER BY score DESC, a DESC, phrase)"
    shared = scored.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    shared = shared.withColumn("_rank", F.expr(best.format(share=", _share"))).where(F.col("_rank") <= top)
    ranked = shared.withColumn("rank", F.expr(best.format(share="")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle() -> str:
    """The query's result as SQL over all words."""
    return f"""
WITH texts AS (SELECT row_number() OVER () AS id, coalesce(lang, '{NO_LANG}') AS lang,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM texts),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase, k
  FROM worded, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
counted AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT *, string_split(phrase, ' ') AS ws FROM counted WHERE k > 1 AND f >= 10),
inside AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(f) AS most
  FROM candidates, (SELECT unnest([1, 2]) AS i) WHERE k = 3 GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inside i ON c.k = 2 AND i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.most IS NULL OR 100 * i.most < 50 * c.f),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, x.cut, l.f AS l, r.f AS r,
    CAST(CAST(1000000 AS HUGEINT) * c.f * c.f // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM kept c JOIN (SELECT unnest([1, 2]) AS cut) x ON x.cut < c.k
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[:x.cut], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[x.cut + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
