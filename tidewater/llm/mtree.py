"""A paged M-tree over vectors, searched best-first by blocks of queries.

Nodes are pages.  An entry holds a routing vector, the covering radius of what
lies below it and the distance to its parent's routing vector; a leaf's entries
are the vectors with their parent distances.  Before a distance is computed,
the stored parent distance bounds it by the triangle inequality:
``|d(q, parent) - d(entry, parent)| - radius``; entries whose bound is beyond
the k-th best are passed over.

A block of queries goes down together: a page is opened once for all queries of
the block that may find something below it, the pages in the order of their
smallest bound, and the distances of those queries to the entries that any of
them cannot pass over are one matrix product.

Inner products are searched as distances: a vector ``x`` gets one more
component ``sqrt(M**2 - |x|**2)`` (``M``: the largest norm) and a query a 0, so
that ``d**2 = |q|**2 + M**2 - 2 q.x`` falls as the product rises.  Distances
only prune, with room for rounding; scores are exact integers.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

PAGE = 64
#: Rounding room of distances, relative to the scale of the space.
SLACK = 1e-6


@dataclass
class Node:
    parent_distance: np.ndarray  # of every entry to this node's routing vector
    children: list[int] = field(default_factory=list)  # inner node
    routing: np.ndarray | None = None  # of the children, one row each
    radius: np.ndarray | None = None  # of the children
    rows: np.ndarray | None = None  # leaf: positions of its vectors


def lift(vectors: np.ndarray, norm2: float) -> np.ndarray:
    """The vectors with the component that makes all of them equally long."""
    own = np.einsum("ij,ij->i", vectors, vectors)
    return np.c_[vectors, np.sqrt(np.maximum(norm2 - own, 0.0))]


def _distance(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    d = points - center
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _nearest(points: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    cross = points @ seeds.T
    return (np.einsum("ij,ij->i", seeds, seeds) - 2 * cross).argmin(axis=1)


class MTree:
    """Bulk-loaded over ``vectors`` (integers as float64); ``norm2``: at least the largest squared norm.

    ``ids`` decide ties and need not be unique; ``rows`` (the ids, unless given) tell the vectors apart.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm2: float, page: int = PAGE, rows: np.ndarray | None = None):
        self.ids, self.vectors, self.norm2, self.page = ids, vectors, norm2, page
        self.row_ids = ids if rows is None else rows
        self.points = lift(vectors, norm2)
        self.nodes: list[Node] = []
        self.computed = 0  # distances to routing vectors and scores, for tests
        rows = np.arange(len(ids))
        self.center = self.points.mean(axis=0) if len(ids) else np.zeros(self.points.shape[1])
        self.root = self._load(rows, self.center) if len(ids) else -1
        self.covering = float(_distance(self.points, self.center).max()) if len(ids) else 0.0
        del self.points  # only routing vectors are lifted in a search

    def __getstate__(self) -> dict:
        small = np.abs(self.vectors).max(initial=0.0) < 2**31
        return self.__dict__ | {"vectors": self.vectors.astype(np.int32) if small else self.vectors}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.vectors = self.vectors.astype(np.float64)

    def _load(self, rows: np.ndarray, center: np.ndarray) -> int:
        points = self.points[rows]
        if len(rows) <= self.page:
            self.nodes.append(Node(_distance(points, center), rows=rows))
            return len(self.nodes) - 1
        fan = int(min(self.page, -(-len(rows) // self.page) + 1))
        # Seeds evenly spread over the rows by distance to the parent; every row goes to its nearest.
        order = np.argsort(_distance(points, center), kind="stable")
        seeds = points[order[np.linspace(0, len(rows) - 1, fan).astype(int)]]
        near = _nearest(points, seeds)
        parts = [np.flatnonzero(near == s) for s in range(fan)]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.9 * len(rows):  # (nearly) equal vectors: cut by position
            parts = [p for p in np.array_split(order, fan) if len(p)]
        children, routing, radius = [], [], []
        for p in parts:
            middle = points[p].mean(axis=0)
            routing.append(middle)
            radius.append(_distance(points[p], middle).max())
            children.append(self._load(rows[p], middle))
        routing = np.asarray(routing)
        self.nodes.append(Node(_distance(routing, center), children, routing, np.asarray(radius)))
        return len(self.nodes) - 1

    def search(self, query: np.ndarray, k: int, own: int | None = None, beyond: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id) for one query."""
        score, at = self.search_block(query[None, :], k, np.array([-1 if own is None else own]), np.array([beyond]))
        return [(int(s), int(self.ids[i])) for s, i in zip(score[0], at[0]) if i >= 0]

    def search_block(self, queries: np.ndarray, k: int, own: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, position) of the k best vectors of every query, by score, then id, then row; position -1 where there is none.

        ``own``: the row that is no candidate of its query; a query's vectors under a score of ``beyond`` may be left out.
        """
        n = len(queries)
        base = np.einsum("ij,ij->i", queries, queries) + self.norm2
        slack = SLACK * (1.0 + np.sqrt(base))
        best, at = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        if self.root < 0 or n == 0:
            return best, at

        def reach(score: np.ndarray, of: np.ndarray | slice) -> np.ndarray:
            """Distance beyond which no score of ``score`` or more lies."""
            known = np.isfinite(score)
            return np.where(known, np.sqrt(np.maximum(base[of] - 2.0 * np.where(known, score, 0.0), 0.0)) + slack[of], np.inf)

        limit = reach(beyond, slice(None))
        lifted = np.c_[queries, np.zeros(n)]
        everyone = np.arange(n)
        turn = 0
        # (smallest bound, turn, page, its queries, their bounds and distances to the page's routing vector)
        frontier = [(0.0, turn, self.root, everyone, np.zeros(n), self._far(lifted, self.center[None, :])[:, 0])]
        while frontier:
            lowest, _, number, who, bound, to_parent = heapq.heappop(frontier)
            if lowest > limit.max():
                break
            alive = bound <= limit[who]
            who, bound, to_parent = who[alive], bound[alive], to_parent[alive]
            if not len(who):
                continue
            node = self.nodes[number]
            gap = np.abs(to_parent[:, None] - node.parent_distance)
            if node.rows is not None:
                met = gap <= limit[who][:, None]
                some, entries = met.any(axis=1), met.any(axis=0)
                if entries.any():
                    self._take(queries, who[some], node.rows[entries], own, best, at)
                    limit[who] = np.minimum(limit[who], reach(best[who, -1], who))
                continue
            met = gap - node.radius <= limit[who][:, None]
            entries = np.flatnonzero(met.any(axis=0))
            far = self._far(lifted[who], node.routing[entries])
            lower = np.maximum(bound[:, None], far - node.radius[entries])
            for j, c in enumerate(entries):
                below = met[:, c] & (lower[:, j] <= limit[who])
                if below.any():
                    turn += 1
                    heapq.heappush(frontier, (float(lower[below, j].min()), turn, node.children[c], who[below], lower[below, j], far[below, j]))
        return best, at

    def _far(self, lifted: np.ndarray, routing: np.ndarray) -> np.ndarray:
        """Distances of all queries to all routing vectors; what cancellation may cost lies within the slack."""
        self.computed += len(lifted) * len(routing)
        squares = np.einsum("ij,ij->i", lifted, lifted)[:, None] + np.einsum("ij,ij->i", routing, routing)
        return np.sqrt(np.maximum(squares - 2.0 * (lifted @ routing.T), 0.0))

    def _take(self, queries: np.ndarray, who: np.ndarray, rows: np.ndarray, own: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        """Let ``rows`` stand against the best of the queries ``who``."""
        self.computed += len(who) * len(rows)
        scores = queries[who] @ self.vectors[rows].T
        scores[self.row_ids[rows] == own[who][:, None]] = -np.inf
        k = best.shape[1]
        better = (scores >= best[who, -1:]) & (scores > -np.inf)
        for i in np.flatnonzero(better.any(axis=1)):
            q, new = who[i], np.flatnonzero(better[i])
            place, score = np.r_[at[q], rows[new]], np.r_[best[q], scores[i, new]]
            real = place >= 0
            place, score = place[real], score[real]
            first = np.lexsort((self.row_ids[place], self.ids[place], -score))[:k]
            best[q, : len(first)], at[q, : len(first)] = score[first], place[first]
