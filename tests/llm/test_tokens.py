import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linkloom.llm import packing, token_files, tokens
from linkloom.session import fresh_path

ODD = ["", " ", "a", " a", "a ", "a  b", "a\nb c", "a\n\nb. c", "x.\n", "don't 's  it's 's", None, "tab\t x", "é, ß. 1.5, 3! ok?!"]
ODD += ["a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|>. y", "\u3000a b", "a\u2028 b", "a b\x85", "ª µ º × ÷ ɐ ɏ"]
ODD += ["\n", "a \n b", "nb  sp", "日本 語。 か", "a" * 5000, "<|endoftext|> x<|endoftext|>", "a.\x1cb c", "x'll. y're,"]


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.vocabulary_text()


@pytest.fixture(scope="module")
def plain(vocabulary):
    t = Tokenizer.from_str(vocabulary)
    return lambda texts: [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(encoder, texts):
    out = []
    for first, ids, offsets in encoder.slices(pa.array(texts, pa.string())):
        assert first == len(out)
        out += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    return out


def test_words_give_the_ids_of_whole_texts(vocabulary, plain, docs):
    encoder = tokens.Encoder(vocabulary, keep=50, slice_bytes=64)
    texts = ODD + [r.text for r in docs.limit(60).collect()] + ODD
    assert encoded(encoder, texts) == plain(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab.,!? \n\té '1日", max_size=30), min_size=1, max_size=5))
def test_any_text(texts):
    vocabulary = tokens.vocabulary_text()
    t = Tokenizer.from_str(vocabulary)
    want = [t.encode(x, add_special_tokens=False).ids + [0] for x in texts]
    assert encoded(tokens.Encoder(vocabulary), texts) == want


def test_end_mark_in_a_text_is_its_token(vocabulary):
    assert encoded(tokens.Encoder(vocabulary), ["a <|endoftext|> b"]) == [[64, 220, 50256, 275, 0]]


def test_line_feeds_cut_words_too(vocabulary, plain):
    texts = ["a.\nb\nc d", "\na", "a\n", "a \nb", "a\n b", "a\n\nb\n\n\nc\n\n\n\nd", "a\n \nb", "a\n\tb", "a\t\nb", "a\u3000\nb", "a\r\nb", "\n", "a\n's b"]
    assert encoded(tokens.Encoder(vocabulary), texts) == plain(texts)


class Counting:
    """A tokenizer that notes the texts it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def __getattr__(self, name):
        def call(texts, **options):
            self.calls.append(texts)
            return getattr(self.tokenizer, name)(texts, **options)

        return call


def test_library_gets_little_at_a_time(vocabulary, plain):
    """Texts that are encoded whole go to the library in groups, words around line feeds not as one text."""
    encoder = tokens.Encoder(vocabulary)
    encoder.tokenizer = counting = Counting(encoder.tokenizer)
    texts = [f"odd  text {i} " + "lorem ipsum  " * 4000 for i in range(30)] + [f"end.\nStart{'x' * i} on" for i in range(50)]
    assert encoded(encoder, texts) == plain(texts)
    assert max(sum(map(len, c)) for c in counting.calls) <= tokens.WHOLE_BYTES
    assert not any("\nStart" in t for c in counting.calls for t in c)


def test_best_fit_decreasing_takes_the_tightest():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 64, 400))[::-1]
    sequence, offset = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for n, s, o in zip(lengths, sequence, offset):
        fits = [r for r in rooms if r >= n]
        if fits:
            assert 64 - o == min(fits) and rooms[s] == min(fits)
        else:
            assert s == len(rooms) and o == 0
            rooms.append(64)
        rooms[s] -= n
    assert packing.best_fit_decreasing(np.empty(0, np.int64))[0].size == 0


def check_packed(packed, ids_of):
    """Pieces cover each document, sequences are gapless and within capacity."""
    by_doc, by_sequence = {}, {}
    for r in packed:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        ids = np.array(ids_of[doc], "<u4")
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    return by_doc, by_sequence


def test_pack(docs, plain):
    rows = docs.collect()
    ids_of = dict(zip([r.doc_id for r in rows], plain([r.text for r in rows])))
    packed = [r.asDict() for r in packing.pack(docs, group_rows=60).collect()]
    by_doc, by_sequence = check_packed(packed, ids_of)
    assert set(by_doc) == set(ids_of)
    assert all(sum(r["length"] for r in by_doc[d]) == len(ids_of[d]) for d in ids_of)
    total = sum(map(len, ids_of.values()))
    assert len(by_sequence) <= total / 1024 * 1.05 + 4


def test_pack_odd(odd_docs, no_docs, plain):
    packed = packing.pack(odd_docs)
    got = [r.asDict() for r in packed.collect()]
    rows = odd_docs.select("doc_id", "text").collect()
    assert sum(r["length"] for r in got) == sum(map(len, plain([r.text for r in rows])))
    assert len([r for r in got if r["doc_id"] == 5]) == 3
    known = {r.doc_id: i for r, i in zip(rows, plain([r.text for r in rows])) if r.doc_id is not None}
    check_packed([r for r in got if r["doc_id"] is not None and r["length"] == 1024], known)
    assert packing.pack(no_docs).collect() == []
    whole = packing.sequences(odd_docs, packed).collect()
    assert all(len(r.ids) == 1024 for r in whole) and sum(r.used for r in whole) == sum(r["length"] for r in got)
    assert len(whole) == len({r["sequence_id"] for r in got})


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, plain, encoding):
    path = fresh_path(spark, "tokens")
    token_files.write(docs, path, encoding=encoding, rows_per_file=64, rows_per_page=10)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    ids = plain([r.text for r in rows])
    got = sorted(map(tuple, token_files.checksums(token_files.read(spark, path)).collect()))
    starts = np.cumsum([0, *map(len, ids)]).tolist()
    want = [(r.doc_id, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, s, i in zip(rows, starts, ids)]
    assert got == want
    stream = [x for i in ids for x in i]
    part = token_files.tokens_between(spark, path, 900, 2100).orderBy("position").collect()
    assert [r.id for r in part] == stream[900:2100] and [r.position for r in part] == list(range(900, 2100))
    import pyarrow.dataset as ds
    import pyarrow.parquet as pq

    files = [f for f in ds.dataset(path).files if pq.read_metadata(f).num_rows]
    assert len(files) > 2
    column = pq.read_metadata(files[0]).row_group(0).column(4)
    assert column.has_offset_index and column.has_column_index
    assert any("DICTIONARY" in e for e in column.encodings) == (encoding == "dictionary")
    assert any("DELTA_BINARY_PACKED" in e for e in column.encodings) == (encoding == "delta")


def test_token_files_odd(spark, odd_docs, no_docs, plain):
    path = fresh_path(spark, "tokens")
    token_files.write(odd_docs, path, rows_per_file=4)
    got = token_files.read(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == r.n_tokens
        at += r.n_tokens
    assert sorted(map(len, plain([r.text for r in odd_docs.collect()]))) == sorted(r.n_tokens for r in got)
    token_files.write(no_docs, empty := fresh_path(spark, "tokens"))
    assert token_files.checksums(token_files.read(spark, empty)).collect() == []
