"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the result contract.
SHINGLE = 4
SEED = 42


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    return np.array([digest(view[a:b], SEED) for a, b in spans], np.uint64)
