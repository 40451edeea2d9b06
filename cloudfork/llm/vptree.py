"""Vantage-point trees on numpy arrays: one that routes vectors to shards, one inside a shard.

Both are small helpers of the Spark operators in this package: Spark partitions
and shuffles the vectors, and each task works on the rows of its own shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 96  # rows of a leaf inside a shard
CHUNK = 4096  # queries that meet a leaf at a time
SEARCHED = 16_384  # queries that are searched at a time


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    diff = points - centre
    return np.sqrt(np.einsum("ij,ij->i", diff, diff))


def widest(points: np.ndarray, rng: np.random.Generator, tries: int = 6) -> np.ndarray:
    """Of a few random points, the one whose distances to a sample vary most."""
    sample = points[rng.integers(0, len(points), min(len(points), 64))]
    candidates = points[rng.integers(0, len(points), tries)]
    diff = sample - candidates[:, None]
    return candidates[int(np.argmax(np.sqrt(np.einsum("cij,cij->ci", diff, diff)).std(axis=1)))]


def outlook(points: np.ndarray, rng: np.random.Generator, tries: int = 8) -> np.ndarray:
    """Candidate vantage points: some of the points, and places far out along the main directions of the cloud."""
    some = points[rng.integers(0, len(points), min(len(points), 512))]
    mean = some.mean(axis=0)
    _, size, axes = np.linalg.svd(some - mean, full_matrices=False)
    far = [mean + side * times * size[i] / np.sqrt(len(some)) * axes[i] for i in range(min(3, len(axes))) for times in (2, 5, 20) for side in (-1, 1)]
    return np.array([*points[rng.integers(0, len(points), tries)], *far])


@dataclass
class Router:
    """A complete vantage-point tree over a bounded sample; its leaves are the shards."""

    depth: int
    centres: np.ndarray
    radii: np.ndarray

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int, reach: float = np.inf, seed: int = 7) -> Router:
        """Halves the sample ``depth`` times, each time by the vantage point, of several, around
        whose median sphere the fewest vectors lie within ``reach`` (if infinite, a tenth of the spread)."""
        dim = sample.shape[1] if sample.ndim == 2 else 0
        inner = 2**depth - 1
        centres, radii = np.zeros((inner, dim)), np.zeros(inner)
        rng = np.random.default_rng(seed)
        parts = {0: np.arange(len(sample))}
        for node in range(inner):
            rows = parts.pop(node)
            if len(rows):
                least = np.inf
                for c in outlook(sample[rows], rng):
                    d = distances(sample[rows], c)
                    middle = np.median(d)
                    near = np.mean(np.abs(d - middle) <= (reach if np.isfinite(reach) else 0.1 * d.std()))
                    if near < least:
                        least, centres[node], radii[node] = near, c, middle
                inside = distances(sample[rows], centres[node]) <= radii[node]
                parts[2 * node + 1], parts[2 * node + 2] = rows[inside], rows[~inside]
            else:
                parts[2 * node + 1] = parts[2 * node + 2] = rows
        return cls(depth, centres, radii)

    def home(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            d = distances(x, self.centres[node])
            node = 2 * node + 1 + (d > self.radii[node])
        return node - (2**self.depth - 1)

    def visits(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, shard) of every shard whose region may hold a vector within ``reach``."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        reach = reach * (1 + 1e-9) + 1e-12  # the rounding of a gap must keep nothing away
        for _ in range(self.depth):
            gap = distances(x[row], self.centres[node]) - self.radii[node]
            left, right = gap <= reach[row], -gap <= reach[row]
            row = np.concatenate([row[left], row[right]])
            node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - (2**self.depth - 1)


class Tree:
    """A vantage-point tree over the vectors of one shard, searched for many queries at once."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.points, self.order = points, np.arange(len(points))
        self.nodes: list[tuple] = []
        rng = np.random.default_rng(seed)
        todo = [(0, len(points), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][4 + side] = at
            if hi - lo <= LEAF:
                self.nodes.append([lo, hi, None, None, -1, -1])
                continue
            rows = self.order[lo:hi]
            centre = widest(points[rows], rng)
            d = distances(points[rows], centre)
            half = (hi - lo) // 2
            part = np.argpartition(d, half)
            self.order[lo:hi], d = rows[part], d[part]
            bounds = (d[:half].min(), d[:half].max(), d[half:].min(), d[half:].max())
            self.nodes.append([lo, hi, centre, bounds, -1, -1])
            todo += [(lo + half, hi, at, 1), (lo, lo + half, at, 0)]
        self.sorted = points[self.order]
        self.squares = np.einsum("ij,ij->i", self.sorted, self.sorted)
        self.lifted = np.concatenate([self.sorted, -0.5 * self.squares[:, None]], axis=1).T.copy()

    def _leaf(self, queries: np.ndarray, squares: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Squared distances, by the expansion; up to rounding."""
        d = squares[:, None] + self.squares[None, lo:hi]
        d -= 2.0 * (queries @ self.sorted[lo:hi].T)
        return d

    def _walk(self, queries: np.ndarray, reach: np.ndarray, factor: float, after: np.ndarray | None = None):
        """(lo, hi, query rows) of the leaves, of those that go beyond the place ``after``; ``reach`` may shrink between the steps."""
        todo = [(0, np.arange(len(queries)), np.full(len(queries), -np.inf))]
        while todo:
            at, rows, least = todo.pop()
            lo, hi, centre, bounds, left, right = self.nodes[at]
            keep = least <= reach[rows] / factor
            if after is not None:
                keep &= after[rows] < hi - 1
            rows = rows[keep]
            if not len(rows):
                continue
            if centre is None:
                yield lo, hi, rows
                continue
            d = distances(queries[rows], centre)
            near = np.maximum(bounds[0] - d, d - bounds[1])
            far = np.maximum(bounds[2] - d, d - bounds[3])
            todo += [(right, rows, far), (left, rows, near)]

    def _home(self, queries: np.ndarray):
        """The leaf into which each query falls."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, rows = todo.pop()
            if not len(rows):
                continue
            lo, hi, centre, bounds, left, right = self.nodes[at]
            if centre is None:
                yield lo, hi, rows
                continue
            d = distances(queries[rows], centre)
            side = np.maximum(bounds[0] - d, d - bounds[1]) > np.maximum(bounds[2] - d, d - bounds[3])
            todo += [(right, rows[side]), (left, rows[~side])]

    def kth(self, queries: np.ndarray, k: int, reach: np.ndarray, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """For each query the distance within which its ``k`` nearest points lie, at most ``reach``,
        and those points, -1 where there are fewer; with a factor above 1, of the leaves that it looks at."""
        squares = np.einsum("ij,ij->i", queries, queries)
        best, who = np.full((len(queries), k), np.inf), np.full((len(queries), k), -1)
        reach = reach.astype(float).copy()
        first = np.full(len(queries), -1)

        def look(lo: int, hi: int, rows: np.ndarray) -> None:
            for i in range(0, len(rows), CHUNK):
                some = rows[i : i + CHUNK]
                d = self._leaf(queries[some], squares[some], lo, hi)
                hit = d.min(axis=1) <= reach[some] ** 2 * (1 + 1e-9) + 1e-12
                if hit.any():
                    some = some[hit]
                    both = np.concatenate([best[some], d[hit]], axis=1)
                    keep = np.argpartition(both, k - 1, axis=1)[:, :k]
                    best[some] = np.take_along_axis(both, keep, axis=1)
                    old = np.take_along_axis(who[some], np.minimum(keep, k - 1), axis=1)
                    who[some] = np.where(keep < k, old, self.order[np.minimum(lo + np.maximum(keep - k, 0), hi - 1)])
                    reach[some] = np.minimum(reach[some], np.sqrt(np.maximum(best[some].max(axis=1), 0)))

        for lo, hi, rows in self._home(queries):
            first[rows] = lo
            look(lo, hi, rows)
        for lo, hi, rows in self._walk(queries, reach, factor):
            look(lo, hi, rows[first[rows] != lo])
        return reach, who

    def within(self, queries: np.ndarray, reach: np.ndarray, factor: float = 1.0, bound: np.ndarray | None = None, after: np.ndarray | None = None):
        """Blocks (query row, point row, distance) of the points at most ``reach`` away.

        ``bound`` also limits the search, but only up to rounding. ``after``: for each query the place in ``order``
        behind which its points are, so that points that look for one another meet once.
        """
        squares = np.einsum("ij,ij->i", queries, queries)
        slack = (reach if bound is None else np.minimum(reach, bound)) * (1 + 1e-7) + 1e-6
        # |q - p|^2 <= slack^2, as q.p - |p|^2 / 2 >= (|q|^2 - slack^2) / 2: one product, one comparison
        lifted, least = np.concatenate([queries, np.ones((len(queries), 1))], axis=1), 0.5 * (squares - slack**2)
        for lo, hi, rows in self._walk(queries, slack, factor, after):
            for i in range(0, len(rows), CHUNK):
                some = rows[i : i + CHUNK]
                hit = np.flatnonzero(lifted[some] @ self.lifted[:, lo:hi] >= least[some, None])
                if len(hit):
                    a, b = some[hit // (hi - lo)], lo + hit % (hi - lo)
                    if after is not None:
                        behind = b > after[a]
                        a, b = a[behind], b[behind]
                    b = self.order[b]
                    exact = distances(queries[a], self.points[b])
                    keep = exact <= reach[a]
                    yield a[keep], b[keep], exact[keep]

    def nearest(self, queries, query_ids, point_ids, k: int, reach, factor: float = 1.0):
        """(query row, point row, distance) of the ``k`` nearest other points, ties by smaller id.

        A point with the query's own id is no neighbour of it, if ids of the queries are given. Queries
        are searched leaf after leaf, SEARCHED of them at a time, so that what a search holds stays small.
        """
        parts = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        order = np.concatenate([rows for _, _, rows in self._home(queries)]) if len(queries) else np.empty(0, int)
        for i in range(0, len(order), SEARCHED):
            some = order[i : i + SEARCHED]
            a, b, d = self._nearest(queries[some], None if query_ids is None else query_ids[some], point_ids, k, reach[some], factor)
            parts.append((some[a], b, d))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _nearest(self, queries, query_ids, point_ids, k: int, reach, factor: float):
        bound, who = self.kth(queries, k + (query_ids is not None), reach, factor)
        if factor > 1:
            a, b = np.nonzero(who >= 0)
            b = who[a, b]
            d = distances(queries[a], self.points[b])
            near = d <= reach[a]
            a, b, d = a[near], b[near], d[near]
        else:
            # a query with at most k points in reach has them all; the others collect again, for the ties at the last place
            some = np.flatnonzero(bound >= reach)
            a, b = np.nonzero(who[some] >= 0)
            a, b = some[a], who[some[a], b]
            d = distances(queries[a], self.points[b])
            near = d <= reach[a]
            full = np.flatnonzero(bound < reach)
            blocks = [(full[p], q, r) for p, q, r in self.within(queries[full], reach[full], 1.0, bound[full])] if len(full) else []
            a, b, d = (np.concatenate(x) for x in zip((a[near], b[near], d[near]), *blocks))
        if query_ids is not None:
            other = query_ids[a] != point_ids[b]
            a, b, d = a[other], b[other], d[other]
        order = np.lexsort((point_ids[b], d, a))
        a, b, d = a[order], b[order], d[order]
        start = np.searchsorted(a, a)
        keep = np.arange(len(a)) - start < k
        return a[keep], b[keep], d[keep]
