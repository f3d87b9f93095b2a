"""Numpy kernel that scores blocks of documents for all queries at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Scores held at a time, and weighted postings added up at a time.
CELLS = 1 << 20
PAIRS = 1 << 21

#: Cells of all queries' counts, and the most and fewest of one query.
COUNTS = 1 << 22
MOST_BINS = 4_096
FEWEST_BINS = 16

#: Scores are ranked after rounding to six decimals; nothing that near a bound is left out.
MARGIN = 2e-6


class Weights:
    """The weight of each term in each query, by term."""

    def __init__(self, queries: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_queries: int, n_terms: int):
        order = np.argsort(terms, kind="stable")
        self.query, self.weight = queries[order].astype(np.int64), weights[order]
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.queries = n_queries
        self.bins = max(FEWEST_BINS, min(MOST_BINS, COUNTS // max(n_queries, 1)))
        # A posting adds less than its weight.
        self.most = np.bincount(self.query, self.weight, n_queries)

    def bin_of(self, query: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.minimum((score / self.most[query] * self.bins).astype(np.int64), self.bins - 1)

    def edge(self, query: int, place: int) -> float:
        """A score below every one that counts in the bin ``place``."""
        return float(place / self.bins * self.most[query]) - MARGIN


def chunks(weights: Weights, sizes: np.ndarray, terms: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, scores by document and query); 0 where they share no term.

    ``sizes`` is the number of postings of each document, ``terms`` and ``parts`` are
    those of all of them.
    """
    ends = np.r_[0, np.cumsum(sizes)]
    pairs = np.r_[0, np.cumsum(weights.first[terms + 1] - weights.first[terms])][ends]
    start, rows = 0, max(1, CELLS // max(weights.queries, 1))
    while start < len(sizes):
        stop = min(start + rows, max(start + 1, int(np.searchsorted(pairs, pairs[start] + PAIRS, "right")) - 1), len(sizes))
        mine = slice(ends[start], ends[stop])
        first, count = weights.first[terms[mine]], weights.first[terms[mine] + 1] - weights.first[terms[mine]]
        at = np.arange(int(count.sum())) + np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count)
        doc = np.repeat(np.repeat(np.arange(stop - start), sizes[start:stop]), count)
        cell = doc * weights.queries + weights.query[at]
        values = weights.weight[at] * np.repeat(parts[mine], count)
        yield start, np.bincount(cell, values, (stop - start) * weights.queries).reshape(stop - start, weights.queries)
        start = stop
