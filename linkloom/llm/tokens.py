"""Whole texts to token ids with the tokenizers library, word by word.

The pre-tokenizer of these vocabularies always cuts before a single space that stands between two
characters that are no white space, and before line feeds after such a character. Texts are therefore
cut there first, each distinct word is encoded once, and the words' ids are put together by array
operations: the ids are those of encoding the whole text. A text with a space next to other white space,
at its start or its end, or that holds one of the vocabulary's added tokens is encoded whole.
"""

from __future__ import annotations

import gc
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0
# Words that the pre-tokenizer cuts into a line feed, if any, one run of letters, whose bytes go to the merges as they are, and the marks after it.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
SIMPLE = rf"^(?P<lead>\n?)(?P<stem> ?[{LETTERS}]+)(?P<tail>[.,;:!?]*)$"
# White space as str.isspace has it, at either end of a word, or no word at all. Words may start with line feeds where texts are cut before them.
_OTHER_SPACE = r"\x09\x0b-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD = rf"^[\n{_OTHER_SPACE}]|[\n{_OTHER_SPACE}]$|^$"
ODD_LINES = rf"^[{_OTHER_SPACE}]|[\n{_OTHER_SPACE}]$|^$"
WHOLE_BYTES = 1 << 18


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file, read by the driver; tasks get its text, so executors need no such file."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Encodes Arrow string arrays. Holds the ids of words met lately in flat arrays: ``keep`` words and those of one slice at most."""

    def __init__(self, vocabulary: str, keep: int = 600_000, slice_bytes: int = 4 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_chars = byte_chars()
        self.merges = Tokenizer(self.tokenizer.model)
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        if self._feed_joins():
            self.merges.pre_tokenizer = Split(self.byte_chars[10], "isolated")
        cut = self.tokenizer.pre_tokenizer
        self.lines = cut is not None and [x for x, _ in cut.pre_tokenize_str("a.\nb c\n\n.")] == ["a", ".", "Ċ", "b", "Ġc", "Ċ", "Ċ", "."]
        self.keep, self.slice_bytes = keep, slice_bytes
        self._forget()

    def _forget(self) -> None:
        """Known words; the ids of the word at ``i`` are ``flat[ends[i]:ends[i + 1]]``. The first word is empty."""
        self.words = pa.array([""], pa.string())
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(2, np.int64)

    def _feed_joins(self) -> bool:
        """Whether some token holds a line feed and (part of) a letter of stems, so that stems one line each could be merged across lines."""
        of_char = {c: b for b, c in self.byte_chars.items()}
        for token in self.tokenizer.get_vocab():
            if self.byte_chars[10] in token:
                rest = bytes(of_char.get(c, 255) for c in token if c != self.byte_chars[10]).decode("utf-8", "replace")
                if re.search(f"[{LETTERS}\ufffd]", rest):
                    return True
        return False

    def slices(self, texts: pa.Array):
        """``(first row, ids, offsets)`` of pieces of the array, each of about ``slice_bytes``; a null text is empty.

        ``ids[offsets[i]:offsets[i + 1]]`` are the ids of row ``first + i``, the end id last.
        """
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            base = sizes[first - 1] if first else 0
            stop = max(first + 1, int(np.searchsorted(sizes, base + self.slice_bytes, "right")))
            gc.disable()  # many strings and lists, none of them in a cycle
            try:
                coded = self._encode(pc.fill_null(texts.slice(first, stop - first), ""))
            finally:
                gc.enable()
            yield first, *coded
            first = stop

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.keep:
            self._forget()
        cut = texts
        if self.lines:  # a space before each run of line feeds; one that stood there already leaves an empty word
            cut = pc.replace_substring(cut, "\n", " \n")
            for _ in range(2):
                cut = pc.replace_substring(cut, "\n \n", "\n\n")
        lists = pc.split_pattern(cut, " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        starts = bounds[:-1]
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        odd = pc.match_substring_regex(words, ODD_LINES if self.lines else ODD).to_numpy(zero_copy_only=False)
        bad = np.maximum.reduceat(odd[codes], starts)
        for content in self.added:
            bad |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        # Words of texts encoded whole are passed over: they become the empty word.
        kept = np.zeros(len(words), bool)
        kept[codes[np.repeat(~bad, np.diff(bounds))]] = True
        firsts, first_of = np.unique(codes[starts[~bad]], return_inverse=True)
        spaced = words.filter(pa.array(kept))
        space = pc.if_else(pc.starts_with(spaced, "\n"), "", " ")
        spaced = pc.binary_join_element_wise(space, spaced, pa.scalar(""))
        place = self._places(pa.concat_arrays([spaced, words.take(pa.array(firsts))]))
        of_word = np.zeros(len(words), np.int64)
        of_word[kept] = place[: len(spaced)]
        at = of_word[codes]
        at[np.repeat(bad, np.diff(bounds))] = 0
        at[starts[~bad]] = place[len(spaced) :][first_of]
        whole = np.flatnonzero(bad)
        ids, sizes = self._whole(texts.take(pa.array(whole)).to_pylist())
        # After the known words: the texts encoded whole, then the end id.
        flat = np.concatenate([self.flat, ids, np.array([END_ID], np.int32)])
        ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.append(sizes, 1))])
        known = len(self.words)
        at[starts[whole]] = known + np.arange(len(whole))
        at = np.insert(at, bounds[1:], known + len(whole))
        each = (ends[at + 1] - ends[at]).astype(np.int32)
        after = np.cumsum(each)
        source = np.repeat((ends[at] - (after - each)).astype(np.int32 if after[-1] < 1 << 30 else np.int64), each)
        source += np.arange(len(source), dtype=source.dtype)
        stops = after[bounds[1:] + np.arange(len(starts))]
        return flat[source], np.concatenate([[0], stops])

    def _places(self, keys: pa.Array) -> np.ndarray:
        """The place of each word among the known ones; words not known yet are encoded and added.

        A word starts with its space or line feeds, if it has them.
        """
        place = pc.index_in(keys, value_set=self.words)
        missing = pc.is_null(place)
        out = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        if len(unknown := keys.filter(missing)):
            known = len(self.words)
            new = self._learned(unknown.unique())
            out[missing.to_numpy(zero_copy_only=False)] = known + pc.index_in(unknown, value_set=new).to_numpy()
        return out

    def _learned(self, new: pa.Array) -> pa.Array:
        """Adds new words, in the order returned. Line feed, letters and the marks after them are encoded apart."""
        cut = pc.extract_regex(new, SIMPLE)
        simple = pc.is_valid(cut)
        leads, stems, tails = (cut.field(i).filter(simple) for i in range(3))
        leads, stems, tails = pc.equal(leads, "\n").to_numpy(zero_copy_only=False), stems.dictionary_encode(), tails.dictionary_encode()
        others = new.filter(pc.invert(simple)).to_pylist()
        stem_flat, stem_sizes = self._stems(stems.dictionary)
        tail_flat, tail_sizes = self._whole(tails.dictionary.to_pylist())
        # Part 0 is empty, part 1 the line feed; the stems and the marks follow.
        flat = np.concatenate([np.array([self.feed], np.int32), stem_flat, tail_flat])
        ends = np.concatenate([[0, 0, 1], 1 + np.cumsum(np.concatenate([stem_sizes, tail_sizes]))])
        parts = np.stack([leads, 2 + stems.indices.to_numpy(), 2 + len(stem_sizes) + tails.indices.to_numpy()], axis=1).ravel()
        n = ends[parts + 1] - ends[parts]
        before = np.cumsum(n) - n
        ids = flat[np.repeat(ends[parts] - before, n) + np.arange(n.sum())]
        other_ids, other_sizes = self._whole(others)
        added = pa.concat_arrays([new.filter(simple), pa.array(others, pa.string())])
        sizes = np.concatenate([n.reshape(-1, 3).sum(axis=1), other_sizes])
        self.words = pa.concat_arrays([self.words, added])
        self.flat = np.concatenate([self.flat, ids, other_ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return added

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and their number for each, a group of texts at a time: the library's encodings take many times the bytes of a text."""
        flat, sizes, first = [np.empty(0, np.int32)], [], 0
        bounds = np.cumsum([0, *map(len, texts)])
        while first < len(texts):
            stop = max(first + 1, int(np.searchsorted(bounds, bounds[first] + WHOLE_BYTES, "right")) - 1)
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[first:stop], add_special_tokens=False)]
            flat.append(np.fromiter(chain.from_iterable(ids), np.int32))
            sizes += map(len, ids)
            first = stop
        return np.concatenate(flat), np.array(sizes, np.int64)

    def _stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of each run of letters: as characters that stand for bytes, many as the lines of one text."""
        bounds = np.append(np.arange(0, len(stems), 250), len(stems)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), stems), "\n").to_pylist() if len(stems) else []
        flat, sizes = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for first in range(0, len(lines), 64):
            shown = [f"{x}\n".encode().decode("latin-1").translate(self.byte_chars) for x in lines[first : first + 64]]
            for e in self.merges.encode_batch_fast(shown, add_special_tokens=False):
                ids = np.array(e.ids, np.int32)
                kept = ids != self.feed
                flat.append(ids[kept])
                sizes.append(np.diff(np.flatnonzero(~kept), prepend=-1) - 1)
        return np.concatenate(flat), np.concatenate(sizes)


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ENCODERS: dict[str, Encoder] = {}


def task_encoder(vocabulary: str) -> Encoder:
    """The encoder of this Python worker, made by the first task that asks and kept for the next ones."""
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def little_endian(ids: np.ndarray) -> memoryview:
    """The ids as little-endian unsigned 32-bit integers."""
    return memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
