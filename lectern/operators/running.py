"""The best hits of each query over all batches that a task reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cells of a table of scores, queries by rows, that are made at once.
CELLS = 2_000_000
#: Rows of one batch that is put out.
OUT = 100_000


class Running:
    """Keeps k hits of each of ``n`` queries: the highest scores from ``least`` on, equal ones by id (numbers by size, strings by code point).

    A hit below a query's k-th score so far is dropped at once, the others are gathered and cut back to
    k a query whenever they are twice as many, so memory and output are bounded by n * k, whatever is read.
    """

    def __init__(self, n: int, k: int, least: float = -np.inf):
        self.n, self.k = n, k
        self.edge = np.full(n, least)
        self._q, self._s, self._id = [], [], []
        self._held = 0

    def add(self, q: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        self._q.append(q.astype(np.int32))
        self._s.append(s)
        self._id.append(ids)
        self._held += len(q)
        if self._held > max(CELLS, 2 * self.n * self.k):
            self._cut()

    def _cut(self) -> None:
        q, s, ids = (np.concatenate(x) for x in (self._q, self._s, self._id))
        order = np.lexsort((-s, q))
        q, s, ids = q[order], s[order], ids[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        size = np.diff(np.append(first, len(q)))
        at = np.arange(len(q)) - np.repeat(first, size)
        full = size >= self.k
        last = np.repeat(np.where(full, s[np.minimum(first + self.k - 1, len(s) - 1)], -np.inf), size)
        keep = (at < self.k) | (s == last)
        q, s, ids = q[keep], s[keep], ids[keep]
        # more than k only where scores are equal at the edge; ids settle those
        count = np.bincount(q, minlength=self.n)
        over = np.flatnonzero(count > self.k)
        if len(over):
            begin = np.concatenate(([0], np.cumsum(count)))
            good = np.ones(len(q), dtype=bool)
            for x in over:
                lo, hi = begin[x], begin[x + 1]
                tied = lo + np.flatnonzero(s[lo:hi] == s[hi - 1])
                drop = sorted(tied, key=lambda i: ids[i])[len(tied) - (hi - lo - self.k) :]
                good[drop] = False
            q, s, ids = q[good], s[good], ids[good]
        done = np.flatnonzero(np.bincount(q, minlength=self.n) >= self.k)
        low = np.full(self.n, np.inf)
        np.minimum.at(low, q, s)
        self.edge[done] = low[done]
        self._q, self._s, self._id, self._held = [q], [s], [ids], len(q)

    def batches(self, queries: pa.Array, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """(query_id, id, score) of what is kept; ``kind`` is the type of the ids."""
        if not self._q:
            return
        self._cut()
        q, s, ids = self._q[0], self._s[0], self._id[0]
        for lo in range(0, len(q), OUT):
            part = slice(lo, lo + OUT)
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(q[part])), pa.array(ids[part], kind), pa.array(s[part])], ["query_id", "id", "score"])
