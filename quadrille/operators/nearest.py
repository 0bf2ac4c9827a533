"""The nearest vectors in numpy: one task's rows against a block of queries.

Distances come from one matrix product with bounds of its rounding; pairs that
the bounds leave are summed again element by element, so the result is exact.
Missing elements (nulls, or beyond the shorter vector) count for nothing; NaN
comes after all numbers, and pairs without a common element come last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Doubles in one matrix.
CELLS = 1 << 21
#: Larger elements are summed one by one, for their squares could overflow.
LARGE = 1e140
NUMBER, NAN, NOTHING, EXCLUDED = range(4)


class Vectors:
    """Lists of doubles with their ids."""

    def __init__(self, ids: pa.Array, lists: pa.Array):
        whole = lambda a: a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
        ids, lists = whole(ids), whole(lists)
        self.ids = ids.to_numpy(zero_copy_only=False)
        flat = lists.flatten()  # without what stands under null lists
        self.lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.there = flat.is_valid().to_numpy(zero_copy_only=False)
        self.flat = np.where(self.there, flat.to_numpy(zero_copy_only=False), 0.0)

    def padded(self, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The first ``width`` elements of some rows, and where there is one."""
        there = np.arange(width) < self.lengths[rows, None]
        at = (self.starts[rows, None] + np.arange(width))[there]
        values = np.zeros(there.shape)
        values[there] = self.flat[at]
        there[there] = self.there[at]
        return values, there


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in the order of the elements."""
    d = a - b
    d *= d
    total = np.zeros(len(d))
    for k in range(d.shape[1]):
        total += d[:, k]
    return total


class Nearest:
    """The nearest vector so far of each query."""

    def __init__(self, queries: Vectors):
        self.queries = queries
        n = len(queries.ids)
        self.kind, self.distance, self.ids = np.full(n, EXCLUDED), np.full(n, np.inf), np.empty(n, dtype=object)
        lengths, counts = np.unique(queries.lengths, return_counts=True)
        self.width = int(lengths[counts.argmax()]) if n else 0
        same = np.flatnonzero(queries.lengths == self.width)
        values, there = queries.padded(same, self.width)
        plain = there.all(1) & (np.abs(values) < LARGE).all(1) & (self.width > 0)
        self.plain, self.values, self.norms = same[plain], values[plain], np.einsum("ij,ij->i", values[plain], values[plain])
        rest = np.setdiff1d(np.arange(n), self.plain)
        self.rest = [rest[queries.lengths[rest] == x] for x in np.unique(queries.lengths[rest])]

    def _keep(self, at: np.ndarray, kind: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        """Take what is better, for queries that are named once each."""
        k, d = self.kind[at], self.distance[at]
        better = (kind < k) | ((kind == k) & (distance < d))
        tie = np.flatnonzero((kind == k) & (distance == d) & (kind != EXCLUDED))
        better[tie] = [x < y for x, y in zip(ids[tie], self.ids[at[tie]], strict=True)]
        at = at[better]
        self.kind[at], self.distance[at], self.ids[at] = kind[better], distance[better], ids[better]

    def add(self, points: Vectors) -> None:
        rows = np.argsort(points.ids, kind="stable")  # so of a tie the first row has the least id
        step = max(1, CELLS // max(1, self.width))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            if len(self.plain):
                values, there = points.padded(some, self.width)
                plain = there.all(1) & (np.abs(values) < LARGE).all(1)
                self._plain(values[plain], points.ids[some[plain]])
                self._any(self.plain, self.width, points, some[~plain])
            for group in self.rest:
                self._any(group, int(self.queries.lengths[group[0]]), points, some)

    def _any(self, group: np.ndarray, width: int, points: Vectors, rows: np.ndarray) -> None:
        """All pairs, element by element."""
        high = max(1, CELLS // max(1, width))
        for q in range(0, len(group), high):
            at = group[q : q + high]
            a, has = self.queries.padded(at, width)
            step = max(1, min(high, CELLS // len(at)))
            for p in range(0, len(rows), step):
                some = rows[p : p + step]
                b, also = points.padded(some, width)
                total, common = np.zeros((len(at), len(some))), np.zeros((len(at), len(some)), dtype=bool)
                with np.errstate(invalid="ignore", over="ignore"):
                    for k in range(width):
                        both = has[:, k, None] & also[None, :, k]
                        d = a[:, k, None] - b[None, :, k]
                        total += np.where(both, d * d, 0.0)
                        common |= both
                kind = np.where(common, np.where(np.isnan(total), NAN, NUMBER), NOTHING)
                kind[self.queries.ids[at][:, None] == points.ids[some][None, :]] = EXCLUDED
                total[kind != NUMBER] = 0.0
                best = kind.min(1)
                first = np.where(kind == best[:, None], total, np.inf)
                least = first.min(1)
                # an infinite distance is a number too
                where = ((kind == best[:, None]) & (total == least[:, None])).argmax(1)
                self._keep(at, best, least, points.ids[some][where])

    def _plain(self, values: np.ndarray, ids: np.ndarray) -> None:
        """Queries and points of one length, of numbers only; rows by ascending id."""
        if not len(values):
            return
        # of copies the least id counts, and the next one for the query that has the least itself
        _, first, which = np.unique(np.ascontiguousarray(values).view(np.dtype((np.void, values.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        second = np.full(len(first), -1)
        other = np.flatnonzero(ids != ids[first[which]])
        copies, place = np.unique(which[other], return_index=True)
        second[copies] = other[place]
        by_id = np.argsort(first)  # rows are by id already
        first, second = first[by_id], second[by_id]
        values, least = values[first], ids[first]
        norms, share = np.einsum("ij,ij->i", values, values), 16 * (values.shape[1] + 8) * np.finfo(float).eps
        asked = self.queries.ids[self.plain]
        low, high = np.searchsorted(least, asked, "left"), np.searchsorted(least, asked, "right")
        high_rows = 4096
        for q in range(0, len(asked), CELLS // high_rows):
            q1 = min(len(asked), q + CELLS // high_rows)
            for p in range(0, len(values), high_rows):
                p1 = min(len(values), p + high_rows)
                bound = self.norms[q:q1, None] + norms[None, p:p1]
                wide = bound * share + 1e-300
                bound -= 2 * (self.values[q:q1] @ values[p:p1].T) + wide
                for i in np.flatnonzero(high[q:q1] > low[q:q1]):
                    own = np.arange(max(p, low[q + i]), min(p1, high[q + i]))
                    bound[i, own[second[own] < 0] - p] = np.inf
                at = self.plain[q:q1]
                most = np.minimum((bound + 2 * wide).min(1), np.where(self.kind[at] == NUMBER, self.distance[at], np.inf))
                i, j = np.nonzero((bound <= most[:, None]) & (bound < np.inf))
                i, j = i + q, j + p
                step = max(1, CELLS // values.shape[1])
                for k in range(0, len(i), step):
                    a, b = i[k : k + step], j[k : k + step]
                    d, row = _summed(self.values[a], values[b]), np.where(least[b] == asked[a], second[b], first[b])
                    order = np.lexsort((row, d, a))
                    once = order[np.r_[True, a[order][1:] != a[order][:-1]]]
                    self._keep(self.plain[a[once]], np.full(len(once), NUMBER), d[once], ids[row[once]])

    def found(self, schema: pa.Schema) -> pa.RecordBatch:
        """(query, nearest, kind, distance) of the queries that met any vector."""
        at = np.flatnonzero(self.kind < EXCLUDED)
        kind = self.kind[at]
        distance = np.where(kind == NAN, np.nan, self.distance[at])
        columns = [self.queries.ids[at].tolist(), list(self.ids[at]), kind, distance]
        arrays = [pa.array(c, type=t) for c, t in zip(columns[:3], schema.types, strict=False)]
        arrays.append(pa.array(distance, mask=kind == NOTHING))
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def nearest_of(batches: Iterator[pa.RecordBatch], queries: pa.Table) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows (id, vector) in, the best of them for each query (id, vector) out."""
    best, kind = Nearest(Vectors(queries.column(0), queries.column(1))), None
    for batch in batches:
        kind = batch.column(0).type
        if batch.num_rows:
            best.add(Vectors(batch.column(0), batch.column(1)))
    if kind is not None:
        fields = [("query", queries.schema.types[0]), ("nearest", kind), ("kind", pa.int32()), ("distance", pa.float64())]
        yield best.found(pa.schema(fields))
