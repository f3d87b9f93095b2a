"""Two tokenizers over one text: tokens, groups and links of every distinct chunk.

A text is cut before each space that follows something other than white space. There
both tokenizers cut too: the byte-level one because its words take one space before them
and a run of white space is looked at from its first character on, the piece model
because no piece has a space mark after another character (asserted when it is loaded).
So whatever is found for a chunk holds wherever the chunk stands, and a worker works out
each distinct chunk once. Tests compare with whole texts.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

# The tasks of an executor already use all its cores.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks and characters remembered by a worker; beyond, those met once are forgotten.
REMEMBERED = 400_000
REMEMBERED_CHARS = 16 << 20

#: Bits of an id of the first tokenizer in a pair's number, the second's id above it.
SIDE_BITS = 20

_MARK = "▁"
_CHUNKS = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*").findall
_BYTE = re.compile(r"<0x([0-9A-F]{2})>$")


def chunks_of(text: str) -> list[str]:
    """``text``, which begins with a space, cut before spaces that follow no white space."""
    return _CHUNKS(text)


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes.

    Printable bytes stand for themselves; the others follow from code point 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """A tokenizer: the ids of a text, and the bytes of an id."""

    def __init__(self, encode, tokens: dict[int, bytes]):
        self.encode = encode
        self.tokens = tokens
        self.sizes = np.zeros(max(tokens) + 1, np.int64)
        for number, data in tokens.items():
            self.sizes[number] = len(data)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join([self.tokens[i] for i in ids.tolist()])


def byte_level(path: str) -> Side:
    """A byte-level model of the tokenizers library; special strings are plain text."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    alphabet = byte_alphabet()
    tokens = {
        number: bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        for name, number in model.get_vocab(with_added_tokens=True).items()
    }
    return Side(lambda text: model.encode_batch_fast([text], add_special_tokens=False)[0].ids, tokens)


def pieces(path: str) -> Side:
    """A piece model; it puts a space before the text, so it is given the text without."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = {}
    for number in range(model.get_piece_size()):
        name = model.id_to_piece(number)
        if _MARK in name[1:] and name.strip(_MARK):
            raise ValueError(f"piece {name!r} goes across words")
        byte = _BYTE.match(name) if model.is_byte(number) else None
        tokens[number] = bytes([int(byte[1], 16)]) if byte else name.replace(_MARK, " ").encode()
    space = model.piece_to_id(_MARK)
    # Nothing is put before an empty text.
    return Side(lambda text: model.encode(text[1:], num_threads=1) if text != " " else [space], tokens)


class Aligner:
    """What is known of each distinct chunk: numbers of tokens, groups, pairs, its text."""

    def __init__(self, left: Side, right: Side, remembered: int = REMEMBERED, chars: int = REMEMBERED_CHARS):
        self.left, self.right, self.remembered, self.chars = left, right, remembered, chars
        marks = [[f"{i}{mark}" for i in range(len(left.sizes))] for mark in ",|"]
        marks += [[f"{i}{mark}" for i in range(len(right.sizes))] for mark in ",;\n"]
        self.marked = np.array([x for part in marks for x in part], object)
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.written: list[str] = []
        # Per chunk: tokens of both sides, groups, links; -1 tokens if a side alters the chunk.
        self.sizes = np.zeros((0, 4), np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)
        self.held = 0

    def _forget(self) -> None:
        """Keep the chunks that were met again, if they are not too many."""
        keep = np.flatnonzero(self.met > 1)
        names, written = list(self.known), self.written
        sizes, pairs, starts, met = self.sizes, self.pairs, self.starts, self.met
        self._empty()
        kept_chars = sum(len(names[i]) for i in keep.tolist())
        if len(keep) > self.remembered // 2 or kept_chars > self.chars // 2:
            return
        self.known = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.written = [written[i] for i in keep.tolist()]
        self.sizes, self.met, self.held = sizes[keep], met[keep], kept_chars
        self.pairs = gather(pairs, starts[keep], self.sizes[:, 3])
        self.starts = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all chunks of all texts, and how many each text has.

        Texts begin with a space. The numbers hold until the next call. A text that a
        tokenizer alters has no chunks, nor has an empty one.
        """
        if len(self.known) > self.remembered or self.held > self.chars:
            self._forget()
        cut = [chunks_of(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(cut))
        known = self.known
        new = [c for c in flat if c not in known]
        if new:
            self.learn(list(dict.fromkeys(new)))
        slots = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        self.met += np.bincount(slots, minlength=len(self.met))
        counts = np.array([len(c) for c in cut], np.int64)
        of = np.repeat(np.arange(len(cut)), counts)
        altered = np.bincount(of[self.sizes[slots, 0] < 0], minlength=len(cut)) > 0
        if altered.any():
            slots, counts = slots[~altered[of]], np.where(altered, 0, counts)
        return slots, counts

    def learn(self, chunks: list[str]) -> None:
        """Align new chunks. Those that end in white space could merge with the next one."""
        self._many([c for c in chunks if not c[-1].isspace()])
        for chunk in chunks:
            if chunk[-1].isspace():
                self._many([chunk])

    def _many(self, chunks: list[str]) -> None:
        if not chunks:
            return
        text = "".join(chunks)
        data = text.encode()
        cuts = np.cumsum(np.array([len(c.encode()) for c in chunks], np.int64))
        a, b = (np.array(side.encode(text), np.int64) for side in (self.left, self.right))
        a_ends, b_ends = np.cumsum(self.left.sizes[a]), np.cumsum(self.right.sizes[b])
        same = self.left.joined(a) == data and self.right.joined(b) == data
        if not same or len(_both(cuts, a_ends)) < len(cuts) or len(_both(cuts, b_ends)) < len(cuts):
            if len(chunks) > 1:
                half = len(chunks) // 2
                self._many(chunks[:half])
                self._many(chunks[half:])
            else:
                self._remember(chunks, np.array([[-1, -1, 0, 0]], np.int64), np.zeros(0, np.int64), [""])
            return
        # A group ends where both sides end. Its last tokens are linked; tokens without
        # bytes, if a vocabulary had any, would end there too.
        ends = _both(a_ends, b_ends)
        a_group, b_group = np.searchsorted(ends, a_ends), np.searchsorted(ends, b_ends)
        pairs, pair_group = _links(a, a_ends, b, b_ends, ends)
        chunk_of = np.searchsorted(cuts, ends)
        parts = [chunk_of[a_group], chunk_of[b_group], chunk_of, chunk_of[pair_group]]
        sizes = np.stack([np.bincount(x, minlength=len(chunks)) for x in parts], 1)
        self._remember(chunks, sizes, pairs, self._written(a, a_group, b, b_group, chunk_of))

    def _remember(self, chunks: list[str], sizes: np.ndarray, pairs: np.ndarray, written: list[str]) -> None:
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.written += written
        self.starts = np.r_[self.starts, len(self.pairs) + np.cumsum(sizes[:, 3]) - sizes[:, 3]]
        self.pairs = np.r_[self.pairs, pairs]
        self.sizes = np.concatenate([self.sizes, sizes])
        self.met = np.r_[self.met, np.zeros(len(chunks), np.int64)]
        self.held += sum(map(len, chunks))

    def _written(self, a, a_group, b, b_group, chunk_of) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each chunk."""
        left, right = len(self.left.sizes), len(self.right.sizes)
        a_last = np.r_[a_group[1:] != a_group[:-1], True]
        b_last = np.r_[b_group[1:] != b_group[:-1], True]
        new_chunk = np.r_[chunk_of[1:] != chunk_of[:-1], True]
        after_b = np.where(b_last, np.where(new_chunk[b_group], 2, 1), 0)
        # Each group has its tokens of the one side, then those of the other.
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.searchsorted(b_group, a_group)] = a + left * a_last
        codes[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = 2 * left + b + right * after_b
        return "".join(self.marked[codes].tolist()).split("\n")[:-1]


def gather(source: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``source[start:start + length]`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return source[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def _both(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Values of two ascending arrays that are in both, once each."""
    if not len(one) or not len(other):
        return one[:0]
    found = one[other[np.minimum(np.searchsorted(other, one), len(other) - 1)] == one]
    return found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


def _links(a, a_ends, b, b_ends, ends) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of tokens that end together, and the group of each."""
    a_from, a_to = np.searchsorted(a_ends, ends), np.searchsorted(a_ends, ends, "right")
    b_from, b_to = np.searchsorted(b_ends, ends), np.searchsorted(b_ends, ends, "right")
    if (a_to - a_from == 1).all() and (b_to - b_from == 1).all():
        return b[b_from] << SIDE_BITS | a[a_from], np.arange(len(ends))
    pairs = [
        (int(b[j]) << SIDE_BITS | int(a[i]), k)
        for k in range(len(ends)) for j in range(b_from[k], b_to[k]) for i in range(a_from[k], a_to[k])
    ]
    found = np.array(pairs, np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


_loaded: dict[tuple[str, str], Aligner] = {}


def aligner(left: str, right: str) -> Aligner:
    """The worker's aligner, loaded once."""
    if (left, right) not in _loaded:
        _loaded[left, right] = Aligner(byte_level(left), pieces(right))
    return _loaded[left, right]
