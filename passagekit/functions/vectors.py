"""Numpy kernels for blocks of vectors; Spark decides what meets in a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Distances are compared after rounding, then by id, so that the order does
#: not depend on how sums were grouped.
DECIMALS = 6

#: Cells of one distance matrix (32 MB of float64). Batches are cut to fit.
MATRIX_CELLS = 4_000_000

#: Pairs whose exact distances are worked out at a time.
EXACT_PAIRS = 1 << 16
#: Squared lengths up to which single precision screens pairs.
LARGEST = 1e30
#: Base vectors compared at a time, at first and later: what they give bounds the next.
FIRST_ROWS = 512
BLOCK_ROWS = 8_192
#: Of so many cells one may pass the screen; with more the whole matrix is worked out.
PASS_SHARE = 16


def stack(column) -> np.ndarray:
    """Array column of a pandas batch as a float64 matrix."""
    return np.stack([np.asarray(value, dtype=np.float64) for value in column])


def matrix_of(column: pa.Array) -> np.ndarray:
    """Array column of an Arrow batch as a float64 matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(flat) // max(1, len(column))
    if column.null_count or np.any(np.diff(column.offsets.to_numpy()) != width):
        return stack(column.to_numpy(zero_copy_only=False))
    return flat.reshape(len(column), width)


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    cross = left @ right.T
    norms = (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :]
    return np.maximum(norms - 2.0 * cross, 0.0)


def nearest(
    distances: np.ndarray,
    query_ids: np.ndarray,
    base_ids: np.ndarray,
    k: int,
    skip_same_id: bool,
    decimals: int = DECIMALS,
    by_row: bool = False,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best base entries of every query row, as flat columns.

    Ties at the cut are settled by id, so at most ``k`` entries per query
    leave even when most base vectors are equal. ``by_row`` gives the row of a query
    instead of its id.
    """
    values = np.round(distances, decimals)
    if skip_same_id:
        values[query_ids[:, None] == base_ids[None, :]] = np.inf
    if values.shape[1] > k:
        limit = np.partition(values, k - 1, axis=1)[:, k - 1 : k]
        rows, cols = np.nonzero((values <= limit) & np.isfinite(values))
    else:
        rows, cols = np.nonzero(np.isfinite(values))
    order = np.lexsort((base_ids[cols], values[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    rows, cols = rows[keep], cols[keep]
    return rows if by_row else query_ids[rows], base_ids[cols], values[rows, cols]


class Screen:
    """Vectors among which one single-precision product finds what may be near.

    Only what is left is worth an exact distance. Nothing within a limit is left out: the
    threshold allows for the rounding of the product, of its input and of the result.
    """

    def __init__(self, vectors: np.ndarray):
        norms = (vectors * vectors).sum(axis=1)
        self.largest = norms[np.isfinite(norms)].max(initial=0.0)
        self.usable = self.largest < LARGEST
        if self.usable:
            self.table = np.concatenate([vectors, norms[:, None] / -2], axis=1).astype(np.float32)

    def near(self, left: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(row, column) of all pairs within the limits of ``left``'s rows, with some beyond.

        None if too many pairs pass, or if the lengths cannot be screened.
        """
        norms = (left * left).sum(axis=1)
        finite = np.isfinite(norms)
        if not self.usable or norms[finite].max(initial=0.0) >= LARGEST or np.isposinf(limits[finite]).any():
            return None
        # A vector that is not finite has no distances.
        norms, limits = np.where(finite, norms, 0.0), np.where(finite, limits, -np.inf)
        error = (left.shape[1] + 8) * 2.0**-23 * (np.sqrt(norms * self.largest) + self.largest + norms)
        least = ((norms - limits - 10.0**-DECIMALS) / 2 - error).astype(np.float32)
        asked = np.concatenate([left, np.ones((len(left), 1))], axis=1).astype(np.float32)
        passed = asked @ self.table.T >= np.nextafter(least, np.float32(-np.inf))[:, None]
        if np.count_nonzero(passed) > max(EXACT_PAIRS, passed.size // PASS_SHARE):
            return None
        return np.divmod(np.flatnonzero(passed), max(1, passed.shape[1]))


class Best:
    """The best ``k`` hits of some queries while base vectors stream past.

    What lies beyond the ``k``-th hit so far of its query is screened out. ``distances``
    gives the matrix of all distances to a block, ``exact`` those of single pairs.
    """

    def __init__(self, query_ids: np.ndarray, matrix: np.ndarray, k: int, skip_same_id: bool):
        self.ids, self.matrix, self.k, self.skip = query_ids, matrix, k, skip_same_id
        self.limits = np.full(len(query_ids), np.inf)
        self.seen = 0
        self.hits: tuple | None = None
        self.waiting: list[tuple] = []

    def offer(self, base_ids: np.ndarray, screen: Screen, distances, exact) -> None:
        near = screen.near(self.matrix, self.limits)
        self.seen += len(base_ids)
        if near is None:
            rows, found, values = nearest(distances(self.matrix), self.ids, base_ids, self.k, self.skip, by_row=True)
        else:
            rows, cols = near
            values = np.empty(len(rows))
            for start in range(0, len(rows), EXACT_PAIRS):
                part = slice(start, start + EXACT_PAIRS)
                values[part] = exact(self.matrix, rows[part], cols[part])
            values, found = np.round(values, DECIMALS), base_ids[cols]
            keep = values <= self.limits[rows]
            if self.skip:
                keep &= self.ids[rows] != found
            rows, found, values = rows[keep], found[keep], values[keep]
        self.waiting.append((rows, found, values))
        if near is None or sum(len(part[0]) for part in self.waiting) > len(self.ids) * self.k // 2:
            self._merge()

    def _merge(self) -> None:
        """Lower the limits and drop what lies beyond them; ties at a limit are settled by id later."""
        if not self.waiting:
            return
        parts = self.waiting if self.hits is None else [self.hits, *self.waiting]
        rows, found, values = (np.concatenate(column) for column in zip(*parts))
        self.waiting = []
        counts = np.bincount(rows, minlength=len(self.ids))
        width = int(counts.max(initial=0))
        full = counts >= self.k
        if full.any() and width * len(self.ids) <= MATRIX_CELLS:
            order = np.argsort(rows.astype(np.int16 if len(self.ids) < 1 << 15 else np.int64), kind="stable")
            rows, found, values = rows[order], found[order], values[order]
            table = np.full((len(self.ids), width), np.inf)
            table[rows, np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
            self.limits[full] = np.partition(table[full], self.k - 1, axis=1)[:, self.k - 1]
            keep = values <= self.limits[rows]
            rows, found, values = rows[keep], found[keep], values[keep]
        self.hits = rows, found, values
        if len(rows) > 2 * self.k * len(self.ids):
            self._cut()

    def _cut(self) -> None:
        rows, found, values = self.hits
        order = np.lexsort((found, values, rows))
        rows, found, values = rows[order], found[order], values[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < self.k
        self.hits = rows, found, values = rows[keep], found[keep], values[keep]
        ends = np.searchsorted(rows, np.arange(len(self.ids)), side="right")
        full = np.flatnonzero(np.diff(ends, prepend=0) >= self.k)
        self.limits[full] = values[ends[full] - 1]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(query id, base id, distance), flat."""
        self._merge()
        if self.hits is None:
            return None
        self._cut()
        return self.ids[self.hits[0]], *self.hits[1:]


def blocks(rows: int, seen: int = 0) -> Iterator[slice]:
    """Slices of ``rows`` base vectors, each about as long as all that were seen before."""
    start = 0
    while start < rows:
        size = min(max(FIRST_ROWS, seen + start), BLOCK_ROWS)
        yield slice(start, min(start + size, rows))
        start += size


def offer_vectors(best: list[Best], base_ids: np.ndarray, vectors: np.ndarray) -> None:
    """Show base vectors to the queries of every slice."""
    for block in blocks(len(vectors), best[0].seen if best else 0):
        some = vectors[block]
        screen = Screen(some)

        def exact(matrix: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            gap = matrix[rows] - some[cols]
            return np.einsum("ij,ij->i", gap, gap)

        for part in best:
            part.offer(base_ids[block], screen, lambda matrix: squared_distances(matrix, some), exact)


def closest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre; the lowest index wins a tie."""
    found = [np.round(squared_distances(part, centres), DECIMALS + 3).argmin(axis=1) for part in slices(vectors, centres)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def slices(vectors: np.ndarray, centres: np.ndarray):
    """Parts of ``vectors`` whose distances to all centres fit in one matrix."""
    rows = max(1, MATRIX_CELLS // max(1, len(centres)))
    return (vectors[start:start + rows] for start in range(0, len(vectors), rows))


def closest_few(vectors: np.ndarray, centres: np.ndarray, names: np.ndarray, k: int) -> list[np.ndarray]:
    """Names of the ``k`` nearest centres of each vector, nearest first."""
    out = []
    for part in slices(vectors, centres):
        rows, found, _ = nearest(squared_distances(part, centres), np.arange(len(part)), names, k, False, DECIMALS + 3)
        out += np.split(found, np.searchsorted(rows, np.arange(1, len(part))))
    return out
