"""Token ids of whole texts, with one encoding per distinct piece of a worker.

Texts are cut before single spaces, where the tokenizer's own pre-tokenisation cuts
too, and distinct chunks again between a letter and a punctuation mark. Only pieces a
worker has not met are given to the tokenizer; looking them up is done by Arrow. Texts
that hold an added token of the vocabulary are given to it whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The tasks of an executor already use all its cores; idle threads would only spin.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces and bytes remembered by a worker; beyond, those met once are forgotten.
REMEMBERED = 600_000
REMEMBERED_CHARS = 16 << 20

# What counts as white space.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# A space beside other white space, or the mark of a cut: such texts are encoded whole.
_MIXED = rf" {_WHITE}|{_WHITE} |\x00"

# Letters beside which chunks are cut, a subset of what the tokenizer takes for letters.
_LETTER = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}"

# A single new line before a letter, and a letter before a mark or a new line. Words never
# go on over either place, so that the parts have the ids that they have together.
_CUTS = ((rf"([!-~])\n([{_LETTER}])", "\\1\n\x00\\2"), (rf"([{_LETTER}])([,.;:!?\n])", "\\1\x00\\2"))


class WordTokenizer:
    """Byte-level pair encoding of texts through a cache of pieces."""

    def __init__(self, path: str, remembered: int = REMEMBERED, chars: int = REMEMBERED_CHARS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered, self.chars = remembered, chars
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        # One character of a byte-level token stands for one byte.
        self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)
        for name, number in names.items():
            self.bytes_of[number] = len(name)
        self.size = len(self.bytes_of)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.apart = "|".join([_MIXED, *map(re.escape, added)])
        self._empty()

    def _empty(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the pieces that were met again, if they are not too many."""
        keep = np.flatnonzero(self.met > 1)
        known, lengths, met = self.known.take(pa.array(keep)), self.lengths[keep], self.met[keep]
        ids = _gather(self.ids, (np.cumsum(self.lengths) - self.lengths)[keep], lengths)
        self._empty()
        if len(known) <= self.remembered // 2 and _bytes(known) <= self.chars // 2:
            self.known, self.ids, self.lengths, self.met = known, ids, lengths, met

    @property
    def held(self) -> int:
        """Bytes of the pieces remembered."""
        return _bytes(self.known)

    def _remember(self, pieces: pa.StringArray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, pieces])
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        self.met = np.concatenate([self.met, np.zeros(len(pieces), np.int64)])

    def _learn(self, pieces: pa.StringArray) -> None:
        """Encode new pieces: those that may stand side by side all in one text."""
        spaced = pc.starts_with(pieces, " ")
        letters = pc.match_substring_regex(pieces, f"^[{_LETTER}]+$")
        for chosen, before in ((spaced, ""), (letters, "\n")):
            some = pieces.filter(chosen)
            if len(some):
                self._learn_joined(some, before)
        rest = pieces.filter(pc.invert(pc.or_(spaced, letters)))
        if len(rest):
            self._learn_apart(rest)

    def _learn_apart(self, pieces: pa.StringArray) -> None:
        found = self.tokenizer.encode_batch_fast(pieces.to_pylist(), add_special_tokens=False)
        parts = [e.ids for e in found]
        self._remember(pieces, np.array([i for p in parts for i in p], np.uint32), np.array([len(p) for p in parts], np.int64))

    def _learn_joined(self, pieces: pa.StringArray, before: str) -> None:
        """``pieces`` as one text, ``before`` in front of each."""
        one = pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces)
        text = before + pc.binary_join(one, before)[0].as_py()
        ids = np.array(self.encode_whole(text), np.uint32)
        ends = np.cumsum(self.bytes_of[ids])
        sizes = pc.binary_length(pieces).to_numpy().astype(np.int64)
        # Where ids of a piece end, and where those before it do.
        stops = np.cumsum(sizes + len(before))
        last = np.searchsorted(ends, stops)
        first = np.searchsorted(ends, stops - sizes, side="right")
        straight = len(ids) > last.max() and np.array_equal(ends[last], stops)
        if not straight or not np.array_equal(first, np.r_[0, last[:-1] + 1] + len(before)):
            # Not cut where expected: one by one.
            self._learn_apart(pieces)
            return
        lengths = last - first + 1
        self._remember(pieces, _gather(ids, first, lengths), lengths)

    def encode_whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else []

    def _slots(self, keys: pa.StringArray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of the pieces of all keys one after another, and each key's first and number."""
        marked = keys
        for pattern, mark in _CUTS:
            marked = pc.replace_substring_regex(marked, pattern, mark)
        lists = pc.split_pattern(marked, "\x00")
        first = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        pieces = lists.flatten().dictionary_encode()
        names, codes = pieces.dictionary, pieces.indices.to_numpy().astype(np.int64)
        new = names.filter(pc.is_null(pc.index_in(names, value_set=self.known)))
        if len(new):
            self._learn(new)
        slots = pc.index_in(names, value_set=self.known).to_numpy().astype(np.int64)
        number = np.diff(first)
        self.met[slots] += np.bincount(codes, weights=np.repeat(times, number), minlength=len(slots)).astype(np.int64)
        return slots[codes], first[:-1], number

    def encode(self, texts: pa.StringArray | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of each text's ids."""
        plain = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if not len(plain):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.known) > self.remembered or self.held > self.chars:
            self._forget()
        apart = pc.match_substring_regex(plain, self.apart)
        mixed = np.flatnonzero(apart.to_numpy(zero_copy_only=False))
        whole = {i: self.encode_whole(plain[i].as_py()) for i in mixed.tolist()}
        if whole:
            plain = pc.if_else(apart, "", plain)
        lists = pc.split_pattern(plain, " ")
        begin = lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        # The first chunk of a text has no space before it.
        heads = pc.list_element(lists, 0).dictionary_encode()
        keys = pa.concat_arrays([pc.binary_join_element_wise(" ", words.dictionary, ""), heads.dictionary])
        codes = words.indices.to_numpy().astype(np.int64)
        codes[begin] = heads.indices.to_numpy().astype(np.int64) + len(words.dictionary)
        slots, first, number = self._slots(keys, np.bincount(codes, minlength=len(keys)))
        # From chunks to their pieces, from pieces to their ids.
        places = _gather(slots, first[codes], number[codes])
        lengths = self.lengths[places]
        ids = _gather(self.ids, (np.cumsum(self.lengths) - self.lengths)[places], lengths)
        per_chunk = number[codes]
        starts = (np.cumsum(per_chunk) - per_chunk)[begin]
        counts = np.add.reduceat(lengths, starts)
        return (ids, counts) if not whole else _insert(ids, counts, whole)


def _bytes(pieces: pa.StringArray) -> int:
    return pc.sum(pc.binary_length(pieces)).as_py() or 0


def _gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``source[start:start + length]`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _insert(ids: np.ndarray, counts: np.ndarray, whole: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts)
    parts = [np.array(whole[i], np.uint32) if i in whole else ids[end - n:end] for i, (n, end) in enumerate(zip(counts, ends))]
    return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer, loaded once."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
