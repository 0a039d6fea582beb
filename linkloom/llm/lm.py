"""Language-model scoring: a hierarchical Pitman-Yor model with preceding words as contexts.

Each word is a restaurant whose customers are the tokens that follow it in training texts (the first token
follows the end token); all of them share one parent, the corpus restaurant, over a uniform base (the training
words and one share for any other word). Every table of a word's restaurant seats a customer in the parent. A
document's score is the log of its probability token by token, each given the word before it; the probabilities
of the text, not their logarithms, are averaged over the kept sweeps. Perplexity follows from the scores.

The state is the number of tables of each (context, word), and it is kept from sweep to sweep. With a
restaurant's gamma variable ``g ~ Gamma(strength / discount + tables)`` its dishes are independent given the
parent's measure: ``t`` tables of ``n`` customers weigh ``S(n, t) (discount g p)^t``, with generalized Stirling
numbers ``S``. So a sweep draws ``g`` of every restaurant from its current tables, the corpus measure from its
Dirichlet posterior, and moves every ``t`` by Metropolis steps that leave that law as it is; all rows move at
once and no total is out of date. Two things are approximate: the part of the corpus measure that belongs to
no table is taken at its mean, the base, and Stirling numbers of more than ``EXACT`` customers come from a
contour integral.

On Spark: one scan turns the texts into slices (words as 64-bit XXH64, the order of tokens), and all later
steps exchange compressed arrays. Each slice deals its distinct pairs to cells; a cell unites them over all slices
and tells each slice how often its pairs occur. Words live in buckets by hash. In a sweep buckets draw the corpus
restaurant and answer the cells, which move their pairs' tables and send sums per word back; a pair that stands
once has one table, so sweeps move pairs of two customers or more only. At last each slice gets what its words
and pairs came to and scores its documents. A context with many tokens is dealt to all cells by its next words, so
no task holds a whole context; per word or document nothing comes to the driver but the ``COMMON`` most frequent
words, which have short numbers within rows and change no result.

Null and empty texts are the end token alone. Repeated rows are learned from and scored as often. A null
id counts as the text ``null``. Without training texts every word has the uniform share.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.llm.common import give_back, small_batches, tidy, written

HELD_MOD, HELD_AT = 7, 2
WORD_STRENGTH, ROOT_STRENGTH = 1.0, 1.0  # the discounts are estimated from dishes with one and two customers
EXACT, STEPS = 256, 16
SLICE_BYTES, GROUP = 16 << 20, 8 << 20
COMMON, OFTEN = 1 << 17, 8  # words with short numbers, and how often a slice has them
CELL_TOKENS, BUCKET_TOKENS, HOT_TOKENS = 2_000_000, 4_000_000, 2_000_000
SOME_TASKS = 2_000
ROW = "part long, kind int, key long, x double, y double, blobs array<binary>"
ROW_NAMES = [c.split()[0] for c in ROW.split(", ")]
SLICE, PAIRS, CELL, WORDS, ONCE, FIRST, TABLES, SUMS = range(8)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SCORED_NAMES = [c.split()[0] for c in SCORED.split(", ")]


class Draws:
    """Random numbers of rows: each row's depend on its keys and the purpose alone, not on its partition or batch."""

    def __init__(self, kind: int, sweep: int, *keys: np.ndarray):
        state = np.full(len(keys[0]), (kind << 40) + sweep, np.uint64)
        for k in keys:
            state = _mixed(state ^ np.ascontiguousarray(k, np.int64).view(np.uint64))
        self.state, self.drawn = state, 0

    def uniform(self) -> np.ndarray:
        """The next number of every row, within (0, 1)."""
        self.drawn += 1
        bits = _mixed(self.state + np.uint64(self.drawn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)

    def gamma(self, shape: np.ndarray) -> np.ndarray:
        """Gamma variables by squeezed normals (Marsaglia and Tsang); shapes below one by a power of a uniform."""
        shape = np.asarray(shape, np.float64)
        low = shape < 1
        power = np.where(low, self.uniform() ** (1 / np.maximum(shape, 1e-300)), 1.0)
        d = shape + low - 1 / 3
        c = 1 / np.sqrt(9 * d)
        out, left = np.zeros(len(d)), np.ones(len(d), bool)
        while left.any():
            x = np.sqrt(-2 * np.log(self.uniform())) * np.cos(2 * np.pi * self.uniform())
            v, u = (1 + c * x) ** 3, self.uniform()
            with np.errstate(invalid="ignore", divide="ignore"):
                good = left & (v > 0) & (np.log(u) < x * x / 2 + d - d * v + d * np.log(v))
            out[good], left = d[good] * v[good], left & ~good
        return out * power


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit number with all its bits mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _stirling_table(discount: float) -> np.ndarray:
    """``log S(n, t)`` for ``n, t <= EXACT``."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    places = np.arange(EXACT + 1)
    for n in range(EXACT):
        with np.errstate(divide="ignore"):
            stay = out[n] + np.log(np.maximum(n - discount * places, 0))
        out[n + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[n, :-1]]))
    return out


def log_stirling(n: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """``log S(n, t)``: weights of all seatings of ``n`` customers at ``t`` tables, minus infinity outside ``1 <= t <= n``."""
    n, t = np.asarray(n), np.asarray(t)
    out = np.full(n.shape, -np.inf)
    valid = (t >= 1) & (t <= n)
    low = valid & (n <= EXACT)
    out[low] = _stirling_table(discount)[n[low], t[low]]
    out[valid & (t == n)] = 0.0
    high = np.flatnonzero(valid & (n > EXACT) & (t < n))
    if len(high):
        # n!/t! d^-t times the coefficient of x^n in (1 - (1-x)^d)^t: an integral over x = e^-s along a parabola through the saddle.
        m, k = n[high].astype(float), t[high].astype(float)
        a, b = np.full(len(m), -700.0), np.full(len(m), -1e-12)  # log (1 - x)
        for _ in range(60):
            mid = (a + b) / 2
            slope = -np.expm1(mid) * discount * np.exp((discount - 1) * mid) / -np.expm1(discount * mid)
            big = slope > m / k
            a, b = np.where(big, mid, a), np.where(big, b, mid)
        saddle = np.maximum(-np.log(-np.expm1((a + b) / 2)), 4 / m)
        width = np.minimum(np.sqrt(40 / (m * saddle)), np.pi / (2 * saddle))
        turn = 1 + 1j * width[:, None] * np.linspace(0, 1, 129)
        s = saddle[:, None] * turn**2
        power = m[:, None] * s + k[:, None] * np.log(1 - (-np.expm1(-s)) ** discount)
        top = power[:, 0].real
        values = (np.exp(power - top[:, None]) * turn).real
        area = (values.sum(axis=1) - (values[:, 0] + values[:, -1]) / 2) * width / 128
        logs = top + np.log(np.maximum(area, 1e-300) * 2 * saddle / np.pi)
        out[high] = _log_factorial(m) - _log_factorial(k) - k * np.log(discount) + logs
    return out


def _log_factorial(n: np.ndarray) -> np.ndarray:
    up = n + 8.0  # Stirling's series of the gamma function at n + 8, brought down to n + 1
    down = np.log(np.multiply.reduce([n + i for i in range(1, 8)]))
    return (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - down


def resample(draws: Draws, n: np.ndarray, t: np.ndarray, weight: np.ndarray, discount: float, steps: int = STEPS) -> np.ndarray:
    """``t`` after Metropolis steps for the law ``S(n, t) weight^t``."""
    t, now = t.copy(), log_stirling(n, t, discount)
    log_weight = np.log(weight)
    reach = np.maximum(1, np.sqrt(n).astype(np.int64))
    for _ in range(steps):
        jump = 1 + (draws.uniform() * reach).astype(np.int64)
        jump = np.where(draws.uniform() < 0.5, -jump, jump)
        new = log_stirling(n, t + jump, discount)
        taken = np.log(draws.uniform()) < new - now + jump * log_weight
        t[taken] += jump[taken]
        now[taken] = new[taken]
    return t


def packed(values: np.ndarray) -> bytes:
    """Integers as compressed bytes: all lowest bytes, then all next ones, so that small numbers take little."""
    values = np.ascontiguousarray(values).astype("<i8", copy=False)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def unpacked(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel().astype(np.int64, copy=False)


def rising(values: np.ndarray) -> bytes:
    """Sorted integers (hashes as unsigned ones) by their differences."""
    return packed(np.diff(values, prepend=values.dtype.type(0)).view(np.int64))


def risen(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob))


def hashes(blob: bytes) -> np.ndarray:
    return risen(blob).view(np.uint64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows ``part, kind, key, x, y, blobs``."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary())]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ROW_NAMES)


def _each(df: DataFrame, make) -> DataFrame:
    """Rows made from each row: ``make(part, kind, key, blobs)`` yields them."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if rows := list(make(row["part"], row["kind"], row["key"], row["blobs"])):
                    yield _batch(rows)

    return df.select(*ROW_NAMES).mapInArrow(tidy(run), ROW)


def _grouped(frames: list[DataFrame], make, tasks: int, schema: str = ROW) -> DataFrame:
    """``make(part, by)`` for all rows of a part, in order of their keys: ``by[kind]`` lists ``(key, blobs)``.

    Rows are few bytes for their work, so the number of tasks follows the parts.
    """

    def run(table: pa.Table) -> pa.Table:
        by = defaultdict(list)
        kinds, keys, blobs = (table.column(c).to_pylist() for c in ("kind", "key", "blobs"))
        for i in np.lexsort((keys, kinds)):
            by[kinds[i]].append((keys[i], blobs[i]))
        part = table.column("part")[0].as_py()
        del table, blobs
        made = make(part, by)
        give_back()
        return made if schema != ROW else pa.Table.from_batches([_batch(list(made))])

    every = frames[0].select(*ROW_NAMES)
    for frame in frames[1:]:
        every = every.unionByName(frame.select(*ROW_NAMES))
    tasks = max(int(every.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(3 * tasks, SOME_TASKS))
    return every.repartition(tasks, "part").groupBy("part").applyInArrow(run, schema)


def slices(docs: DataFrame, held_mod: int = HELD_MOD, held_at: int = HELD_AT, slice_bytes: int | None = None) -> DataFrame:
    """A row per slice of a task's texts: its documents, its words and the order of its tokens; ``x`` counts tokens."""
    slice_bytes = slice_bytes or SLICE_BYTES

    def run(batches):
        for batch in batches:
            ids, numbers = batch.column("doc_id"), batch.column("row").to_numpy()
            texts = pc.fill_null(batch.column("text"), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < len(texts):
                stop = max(first + 1, int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + slice_bytes, "right")))
                yield _sliced(texts.slice(first, stop - first), int(numbers[first]), ids.slice(first, stop - first), held_mod, held_at)
                first = stop

    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return narrow.mapInArrow(tidy(run), ROW)


def _sliced(texts: pa.Array, number: int, ids: pa.Array, held_mod: int, held_at: int) -> pa.RecordBatch:
    from xxhash import xxh64_intdigest

    size = len(texts)
    held = [zlib.crc32(("null" if i is None else str(i)).encode()) % held_mod == held_at for i in ids.to_pylist()]
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    doc = np.repeat(np.arange(size), np.diff(lists.offsets.to_numpy().astype(np.int64)))
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves empty words
    coded = flat.dictionary_encode()
    named = np.fromiter(map(xxh64_intdigest, [*coded.dictionary.cast(pa.binary()).to_pylist(), b""]), np.uint64)
    codes, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[real], doc[real]
    tokens = np.bincount(doc, minlength=size) + 1
    # The end token stands for the empty word, once in each document and last.
    ends = np.cumsum(tokens) - 1
    own = np.full(len(codes) + size, len(named) - 1)
    own[np.delete(np.arange(len(own)), ends)] = codes
    words, of = np.unique(named, return_inverse=True)
    own = of[own]
    counts = np.bincount(own, minlength=len(words))
    words, own, counts = words[counts > 0], (np.cumsum(counts > 0) - 1)[own], counts[counts > 0]
    place = np.empty(len(words), np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(words))
    null = ids.is_null().to_numpy(zero_copy_only=False)
    blobs = [packed(pc.fill_null(ids, 0).to_numpy()), packed(null), packed(np.array(held)), packed(tokens), rising(words), packed(counts), packed(place[own])]
    return _batch([(number, SLICE, number, float(len(own)), 0.0, blobs)])


class Names:
    """How words are written and pairs dealt: short numbers of words that are common in some slice, cells of pairs.

    This is for size and balance alone: every other word goes by its hash, and pairs of a ``hot`` context are dealt by both words.
    """

    def __init__(self, common: list[tuple[int, int]], tokens: int):
        self.common = np.array([w for w, _ in common], np.int64).view(np.uint64)
        self.hot = np.sort(np.array([w for w, n in common if n > HOT_TOKENS], np.int64).view(np.uint64))
        self.cells, self.buckets = (max(1, -(-tokens // share)) for share in (CELL_TOKENS, BUCKET_TOKENS))

    @cached_property
    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.common)
        return self.common[order], order

    def refs(self, words: np.ndarray) -> np.ndarray:
        """The number of each of these sorted words: a common one's is that of all slices, the others follow in order."""
        ordered, order = self.sorted
        known = np.isin(words, ordered)
        out = len(self.common) + np.cumsum(~known) - 1
        out[known] = order[np.searchsorted(ordered, words[known])]
        return out

    def cell(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        mixed, hot = _mixed(u), np.isin(u, self.hot)
        mixed[hot] = _mixed(u[hot] ^ _mixed(w[hot]))
        return ((mixed >> np.uint64(32)) % np.uint64(self.cells)).astype(np.int64)

    def shares(self, words: np.ndarray):
        """``bucket, from, to`` of sorted words: ranges of hashes."""
        bucket = ((words >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(self.buckets + 1))
        return [(b, edges[b], edges[b + 1]) for b in range(self.buckets) if edges[b] < edges[b + 1]]


def naming(made: DataFrame) -> Names:
    """Short numbers for up to ``COMMON`` words: those with the most tokens among the words that a slice has ``OFTEN``."""
    least = OFTEN

    def frequent(batches):
        for batch in batches:
            for blobs in batch.column("blobs").to_pylist():
                words, counts = hashes(blobs[4]), unpacked(blobs[5])
                often = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(counts[often])], ["w", "n"])

    each = made.select("blobs").mapInArrow(tidy(frequent), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    each = written(each, "lm-common").withColumn("_step", F.floor(F.log2("n") * 8))
    # The driver gets the steps first, then the words of the highest ones that fit.
    left, lowest = COMMON, None
    for step, words in sorted(each.groupBy("_step").count().collect(), reverse=True):
        left -= words
        if left < 0:
            break
        lowest = step
    common = sorted(((w, n) for w, n in each.where(F.col("_step") >= F.lit(lowest)).select("w", "n").collect()), key=lambda r: (-r[1], r[0]))
    return Names(common, int(made.agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]))


class Slice:
    """A slice's tokens and their distinct pairs, by cell, context and word."""

    def __init__(self, blobs: list[bytes], names: Names):
        self.ids, self.null, self.held, self.sizes = map(unpacked, blobs[:4])
        self.words, counts = hashes(blobs[4]), unpacked(blobs[5])
        self.own = np.argsort(-counts, kind="stable")[unpacked(blobs[6])]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        before = np.concatenate([self.own[-1:], self.own[:-1]])  # the first token of each text follows an end token
        self.ref = names.refs(self.words)
        self.wide = len(names.common) + len(self.words)
        _, first, of = np.unique(self.ref[before] * self.wide + self.ref[self.own], return_index=True, return_inverse=True)
        u, w = before[first], self.own[first]
        cell = names.cell(self.words[u], self.words[w])
        order = np.argsort(cell, kind="stable")
        self.u, self.w, cell = u[order], w[order], cell[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.of = place[of]
        edges = np.searchsorted(cell, np.arange(names.cells + 1))
        self.cells = [(c, edges[c], edges[c + 1]) for c in range(names.cells) if edges[c] < edges[c + 1]]


def cut(made: DataFrame, names: Names) -> DataFrame:
    """Each slice's pairs and their training tokens, a row per cell."""
    known = len(names.common)

    def rows(part, kind, key, blobs):
        s = Slice(blobs, names)
        ns = np.bincount(s.of, weights=s.held[s.doc] == 0, minlength=len(s.u)).astype(np.int64)
        for cell, a, b in s.cells:
            u, w = s.ref[s.u[a:b]], s.ref[s.w[a:b]]
            both = np.unique(np.concatenate([s.u[a:b], s.w[a:b]]))
            rare = both[s.ref[both] >= known]
            refs = s.ref[rare]
            short = lambda r: np.where(r < known, r, known + np.searchsorted(refs, r))  # noqa: E731, B023
            heads, at = np.unique(short(u), return_inverse=True)
            yield cell, PAIRS, key, 0.0, 0.0, [rising(s.words[rare]), rising(heads), rising(at * (known + len(rare)) + short(w)), packed(ns[a:b])]

    return _each(made, rows)


def united(pieces: DataFrame, names: Names) -> DataFrame:
    """The pairs of each cell over all slices.

    ``PAIRS`` rows answer each slice: the tokens of its pairs, and places of those with two or more among the cell's.
    ``CELL`` rows hold these: words, contexts, words after them, tokens. ``WORDS`` rows go to the buckets of the words.
    ``x`` and ``y`` count pairs with one and with two tokens.
    """
    known = len(names.common)

    def make(cell, by):
        found = by.pop(PAIRS)
        rares = [hashes(blobs[0]) for _, blobs in found]
        rare = np.unique(np.concatenate(rares))
        wide, keys, tokens = known + len(rare), [], []
        for (_, blobs), own in zip(found, rares):
            at, w = np.divmod(risen(blobs[2]), known + len(own))
            to, heads = known + np.searchsorted(rare, own), risen(blobs[1])
            for refs in (heads, w):
                refs[refs >= known] = to[refs[refs >= known] - known]
            keys.append(heads[at] * wide + w)
            tokens.append(unpacked(blobs[3]))
        distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate(tokens)).astype(np.int64)
        several = n > 1
        place, first = np.cumsum(several) - 1, 0
        for (key, _), own in zip(found, tokens):
            mine = of[first : first + len(own)]
            first += len(own)
            yield cell, PAIRS, key, 0.0, 0.0, [packed(n[mine]), rising(place[mine[several[mine]]])]
        u, w = np.divmod(distinct, wide)
        name = np.concatenate([names.common, rare])
        order = np.argsort(name)
        sums = [
            np.bincount(w, weights=n, minlength=wide),
            np.bincount(u[n == 1], minlength=wide),
            np.bincount(w[n == 1], minlength=wide),
            np.bincount(u[several], minlength=wide),
            np.bincount(w[several], minlength=wide),
        ]
        learned = order[sum(sums)[order] > 0]
        words, sums = name[learned], [s[learned].astype(np.int64) for s in sums]
        asked = sums[3] + sums[4] > 0
        for bucket, a, b in names.shares(words):
            yield bucket, WORDS, cell, 0.0, 0.0, [rising(words[a:b]), *(packed(s[a:b]) for s in sums), packed(asked[a:b])]
        to = np.full(wide, -1)
        to[learned[asked]] = np.arange(asked.sum())
        pairs = [rising(words[asked]), packed(to[u[several]]), packed(to[w[several]]), packed(n[several])]
        yield cell, CELL, 0, float((n == 1).sum()), float((n == 2).sum()), pairs

    return _grouped([pieces], make, names.cells)


def vocabulary(cells: DataFrame, names: Names) -> DataFrame:
    """Words by bucket, with their training tokens and one table per pair.

    ``ONCE``: words that stand once, which keep one table as context and as dish. ``WORDS``: the others: words, tokens, pairs with one
    token by context and by word, customers and tables in the corpus restaurant, tables as context, then the cells that hold the
    word in a pair of several tokens and its places there. ``x`` and ``y`` are tokens and words, then customers and tables.
    """

    def make(bucket, by):
        found = by.pop(WORDS)
        lists = [hashes(blobs[0]) for _, blobs in found]
        words, of = np.unique(np.concatenate(lists), return_inverse=True)
        sums = [np.zeros(len(words), np.int64) for _ in range(5)]
        first, places = 0, []
        for (_, blobs), own in zip(found, lists):
            at = of[first : first + len(own)]
            first += len(own)
            for total, blob in zip(sums, blobs[1:6]):
                total[at] += unpacked(blob)
            places.append(at[unpacked(blobs[6]) > 0])
        count, su, sw, mu, mw = sums
        more = count > 1
        to = np.cumsum(more) - 1
        yield bucket, ONCE, 0, float((~more).sum()), float((~more).sum()), [rising(words[~more])]
        state = [rising(words[more]), *(packed(v[more]) for v in (count, su, sw, sw + mw, np.ones(len(words), np.int64), su + mu))]
        routes = [packed(np.array([c for c, _ in found])), *(rising(to[p]) for p in places)]
        yield bucket, WORDS, 0, float(count[more].sum()), float(more.sum()), [*state, *routes]
        ones, twos = (float(((sw + mw) == k).sum()) for k in (1, 2))
        yield bucket, FIRST, 0, ones, twos, []

    return _grouped([cells.where(F.col("kind") == WORDS)], make, names.buckets)


def _sums(df: DataFrame, kind: int) -> tuple[float, float]:
    return tuple(df.where(F.col("kind") == kind).agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first())


def corpus(words: DataFrame, once: DataFrame, sweep: int, distinct: int, discount: float) -> tuple[DataFrame, dict]:
    """``words`` with new tables in the corpus restaurant, and what a draw of its measure (``p``) and its mean (``q``) take."""
    share = 1 / (distinct + 1)

    def counted(part, kind, key, blobs):
        c, t = unpacked(blobs[4]), unpacked(blobs[5])
        yield part, kind, key, float(c.sum()), float(np.minimum(t, c).sum()), []

    singles = int(_sums(once, ONCE)[0])
    customers, tables = (int(v) + singles for v in _sums(_each(words, counted), WORDS))
    g = np.random.default_rng([1, sweep]).gamma(ROOT_STRENGTH / discount + tables)

    def seated(part, kind, key, blobs):
        w = hashes(blobs[0]).view(np.int64)
        if kind == ONCE:
            yield part, kind, key, float(len(w)), float(Draws(6, sweep, w).gamma(np.full(len(w), 1 - discount)).sum()), []
        else:
            c, t = unpacked(blobs[4]), unpacked(blobs[5])
            new = resample(Draws(2, sweep, w), c, np.minimum(t, c), np.full(len(c), discount * g * share), discount)
            drawn = Draws(6, sweep, w).gamma(c - discount * new)
            yield part, kind, key, float(new.sum()), float(drawn.sum()), [*blobs[:5], packed(new), *blobs[6:]]

    new = written(_each(words, seated), "lm-corpus", GROUP)
    sums = _sums(new, WORDS), _sums(_each(once, seated), ONCE)
    tables, mass = int(sums[0][0] + sums[1][0]), sums[0][1] + sums[1][1]
    rest = ROOT_STRENGTH + discount * tables
    free = np.random.default_rng([3, sweep]).gamma(rest)
    law = {"share": share, "sweep": sweep, "discount": discount, "rest": rest, "customers": customers, "mass": mass, "free": float(free)}
    return new, law


def sweep_pairs(cells: DataFrame, last: list[DataFrame], words: DataFrame, law: dict, sweep: int, discount: float, names: Names) -> DataFrame:
    """New tables of each cell's pairs (``TABLES``), given each context's gamma variable and the corpus measure, and their sums by word."""

    def answered(bucket, kind, key, blobs):
        c, t, rooms = (unpacked(b) for b in blobs[4:7])
        for cell, route in zip(unpacked(blobs[7]), blobs[8:]):
            if len(at := risen(route)):
                yield int(cell), WORDS, bucket, 0.0, 0.0, [packed(v[at]) for v in (c, t, rooms)]

    def make(cell, by):
        words, u, w, n = (f(b) for f, b in zip((hashes, unpacked, unpacked, unpacked), by[CELL][0][1]))
        if not len(n):
            return
        t = unpacked(by[TABLES][0][1][0]) if by[TABLES] else np.ones(len(n), np.int64)
        c, s, rooms = (np.concatenate([unpacked(blobs[i]) for _, blobs in by[WORDS]]) for i in range(3))
        keys = words.view(np.int64)
        drawn = Draws(6, law["sweep"], keys).gamma(c - law["discount"] * s)
        p = (drawn + law["free"] * law["share"]) / (law["mass"] + law["free"])
        g = Draws(4, sweep, keys).gamma(WORD_STRENGTH / discount + rooms)
        t = resample(Draws(5, sweep, keys[u], keys[w]), n, t, np.maximum(discount * g[u] * p[w], 1e-300), discount)
        yield cell, TABLES, sweep, 0.0, 0.0, [packed(t)]
        sums = [np.bincount(x, weights=t, minlength=len(words)).astype(np.int64) for x in (u, w)]
        for bucket, a, b in names.shares(words):
            yield bucket, SUMS, cell, 0.0, 0.0, [packed(v[a:b]) for v in sums]

    replies = _each(words, answered)
    return written(_grouped([cells.where(F.col("kind") == CELL), replies, *last], make, names.cells), "lm-pairs", GROUP)


def with_customers(words: DataFrame, swept: DataFrame, names: Names) -> DataFrame:
    """``words`` with the tables of all contexts as customers, and each context's tables."""

    def make(bucket, by):
        blobs = by[WORDS][0][1]
        routes = dict(zip(unpacked(blobs[7]).tolist(), blobs[8:]))
        rooms, c = unpacked(blobs[2]).copy(), unpacked(blobs[3]).copy()
        for cell, (tu, tw) in by[SUMS]:
            at = risen(routes[cell])
            rooms[at] += unpacked(tu)
            c[at] += unpacked(tw)
        yield bucket, WORDS, 0, 0.0, 0.0, [*blobs[:4], packed(c), blobs[5], packed(rooms), *blobs[7:]]

    return written(_grouped([words, swept.where(F.col("kind") == SUMS)], make, names.buckets), "lm-words", GROUP)


def of_words(made: DataFrame, once: DataFrame, kept: list[DataFrame], names: Names) -> DataFrame:
    """For each slice its words' training tokens and, for each kept sweep, customers and tables as dish and tables as context."""

    sweeps = len(kept)

    def asked(part, kind, key, blobs):
        words = hashes(blobs[4])
        for bucket, a, b in names.shares(words):
            yield bucket, SLICE, key, 0.0, 0.0, [rising(words[a:b])]

    def make(bucket, by):
        once = hashes(by[ONCE][0][1][0]) if by[ONCE] else np.zeros(0, np.uint64)
        words = hashes(by[WORDS][0][1][0]) if by[WORDS] else np.zeros(0, np.uint64)
        every = np.concatenate([words, once])
        order = np.argsort(every)
        every = every[order]
        values = []
        for i, (_, blobs) in enumerate(by[WORDS]):
            for b in ([blobs[1]] if i == 0 else []) + [blobs[4], blobs[5], blobs[6]]:
                values.append(np.concatenate([unpacked(b), np.ones(len(once), np.int64), [0]]))
        order = np.append(order, len(order))  # the last place is that of words without training tokens
        for key, (blob,) in by[SLICE]:
            own = hashes(blob)
            at = np.searchsorted(every, own)
            at[np.append(every, np.uint64(0))[at] != own] = len(every)
            at[at < len(every)] = order[at[at < len(every)]]
            yield key, WORDS, bucket, 0.0, 0.0, [packed(v[at]) for v in values] if values else [packed(np.zeros(len(own), np.int64))] * (1 + 3 * sweeps)

    states = [w.withColumn("key", F.lit(i).cast("long")) for i, w in enumerate(kept)]
    return _grouped([_each(made, asked), once.where(F.col("kind") == ONCE), *states], make, names.buckets)


def of_pairs(cells: DataFrame, kept: list[DataFrame], names: Names) -> DataFrame:
    """For each slice its pairs' training tokens and, for each kept sweep, the tables of those with several."""

    sweeps = len(kept)

    def make(cell, by):
        tables = [unpacked(blobs[0]) for _, blobs in by[TABLES]] or [np.zeros(0, np.int64)] * sweeps
        for key, (n, places) in by[PAIRS]:
            at = risen(places)
            yield key, PAIRS, cell, 0.0, 0.0, [n, *(packed(t[at]) for t in tables)]

    return _grouped([cells.where(F.col("kind") == PAIRS), *(t.where(F.col("kind") == TABLES) for t in kept)], make, names.cells)


def _estimated(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def log_gamma(x: Column) -> Column:
    """Natural log of the gamma function for positive ``x``: Stirling's series seven places up."""
    up = x + 7
    down = F.log(x) + F.log(x + 1) + F.log(x + 2) + F.log(x + 3) + F.log(x + 4) + F.log(x + 5) + F.log(x + 6)
    series = 1 / (12 * up) - 1 / (360 * up * up * up) + 1 / (1260 * up * up * up * up * up)
    return (up - 0.5) * F.log(up) - up + F.lit(float(0.5 * np.log(2 * np.pi))) + series - down


def scored(made: DataFrame, answers: list[DataFrame], names: Names, total: int, distinct: int, discount: float, laws: list[dict]) -> DataFrame:
    """Per document of each slice: tokens, known tokens, base score and the mean of the kept sweeps' probabilities as a logarithm."""

    def make(part, by):
        s = Slice(by[SLICE][0][1], names)
        count, *values = (np.concatenate([unpacked(blobs[i]) for _, blobs in by[WORDS]]) for i in range(1 + 3 * len(laws)))
        n = np.concatenate([unpacked(blobs[0]) for _, blobs in by[PAIRS]])
        size, logs = len(s.sizes), []
        for i, law in enumerate(laws):
            c, t, rooms = values[3 * i : 3 * i + 3]
            q = (c - law["discount"] * t + law["rest"] * law["share"]) / (ROOT_STRENGTH + law["customers"])
            tables = np.minimum(n, 1)
            tables[n > 1] = np.concatenate([unpacked(blobs[1 + i]) for _, blobs in by[PAIRS]])
            back = (WORD_STRENGTH + discount * rooms[s.u]) * q[s.w]
            chance = np.log((n - discount * tables + back) / (WORD_STRENGTH + count[s.u]))
            logs.append(np.bincount(s.doc, weights=chance[s.of], minlength=size))
        top = np.max(logs, axis=0)
        score = (top + np.log(np.mean(np.exp(np.array(logs) - top), axis=0))) / np.log(10)
        base = np.bincount(s.doc, weights=np.log10((count + 1) / (total + distinct + 1))[s.own], minlength=size)
        known = np.bincount(s.doc, weights=count[s.own] > 0, minlength=size).astype(np.int64)
        ids = pa.array(s.ids, mask=s.null > 0)
        columns = [ids, pa.array(s.held > 0), s.sizes, known, np.full(size, total, np.int64), base, score]
        return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=SCORED_NAMES)

    return _grouped([made, *answers], make, tasks=made.count(), schema=SCORED)


def scores(docs: DataFrame, burn_in: int = 1, samples: int = 2, held_mod: int = HELD_MOD, held_at: int = HELD_AT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row."""
    with small_batches(docs.sparkSession, 20_000, "12m"):
        made = written(slices(docs, held_mod, held_at), "lm-slices", GROUP)
    with small_batches(docs.sparkSession):
        names = naming(made)
        cells = written(united(cut(made, names), names), "lm-cells", GROUP)
        discount = _estimated(*map(int, _sums(cells, CELL)))
        words = written(vocabulary(cells, names), "lm-words", GROUP)
        root = _estimated(*map(int, _sums(words, FIRST)))
        once, words = (words.where(F.col("kind") == k) for k in (ONCE, WORDS))
        total, distinct = (int(a + b) for a, b in zip(_sums(once, ONCE), _sums(words, WORDS)))
        tables, kept, measures, laws = [], [], [], []
        for sweep in range(1, burn_in + samples + 1):
            words, law = corpus(words, once, sweep, distinct, root)
            swept = sweep_pairs(cells, tables, words, law, sweep, discount, names)
            tables = [swept.where(F.col("kind") == TABLES)]
            words = with_customers(words, swept, names)
            if sweep > burn_in:
                words, law = corpus(words, once, 1_000_000 + sweep, distinct, root)
                kept, measures, laws = [*kept, *tables], [*measures, words], [*laws, law]
        answers = [of_words(made, once, measures, names), of_pairs(cells, kept, names)]
        return written(scored(made, answers, names, total, distinct, discount, laws), "lm-scores")


def perplexity(scored: DataFrame, column: str = "score") -> DataFrame:
    """``held_out, perplexity`` per token."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))
