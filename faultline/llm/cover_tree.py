"""A cover tree over norm-augmented vectors, searched for inner products within windows.

Vectors x of norm at most M become (x, sqrt(M^2 - |x|^2)), all of norm M. For an anchor (a, 0) the squared
distance is |a|^2 + M^2 - 2 a.x, so a ball around a node's centre bounds the inner products below it from both sides.

A node's children are centres taken farthest first: each point lies within the level's radius of its child's
centre (covering), centres of a node are at least that far apart (separation), and a node's centre is that of its
first child (nesting). Radii are the distances found, not powers of two, so that levels fit the data.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FAN = 16
LEAF = 64


@dataclass
class Level:
    """Nodes of one depth: centre, radius, number of the parent in the level above; ``first`` and ``last`` in ``order`` for leaves."""
    centre: np.ndarray
    radius: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray


@dataclass
class CoverTree:
    vectors: np.ndarray
    order: np.ndarray
    levels: list[Level]
    norm2: float


def augmented(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    size2 = np.einsum("ij,ij->i", vectors, vectors)
    norm2 = float(size2.max(initial=0.0))
    return np.column_stack([vectors, np.sqrt(np.maximum(norm2 - size2, 0.0))]), norm2


def _children(points: np.ndarray, own: np.ndarray, centre: int, fan: int):
    """Centres, child of each point, and distance of each point to its centre."""
    away = lambda c: np.sqrt(((points[own] - points[c]) ** 2).sum(axis=1))
    centres, dist, child = [centre], away(centre), np.zeros(len(own), np.int64)
    while len(centres) < fan:
        far = int(dist.argmax())
        if dist[far] == 0:
            break
        new = away(own[far])
        closer = new < dist
        child[closer], dist[closer] = len(centres), new[closer]
        centres.append(int(own[far]))
    return centres, child, dist


def build(vectors: np.ndarray, fan: int = FAN, leaf: int = LEAF) -> CoverTree:
    """A tree over the rows of ``vectors`` (whole numbers as doubles); nodes of up to ``leaf`` points, or of copies only, are leaves."""
    points, norm2 = augmented(vectors)
    n = len(points)
    order, levels = [], []
    top = np.sqrt(((points - points[0]) ** 2).sum(axis=1)) if n else np.zeros(0)
    nodes = [(0, float(top.max()), -1, np.arange(n))] if n else []
    placed = 0
    while nodes:
        below, first, last, is_leaf = [], [], [], []
        for at, (centre, radius, _, own) in enumerate(nodes):
            done = len(own) <= leaf or radius == 0
            is_leaf.append(done)
            first.append(placed)
            if done:
                order.append(own)
                placed += len(own)
            else:
                centres, child, dist = _children(points, own, centre, fan)
                for k, c in enumerate(centres):
                    mine = child == k
                    below.append((c, float(dist[mine].max()), at, own[mine]))
            last.append(placed)
        levels.append(Level(vectors[[x[0] for x in nodes]], np.array([x[1] for x in nodes]), np.array([x[2] for x in nodes]),
                            np.array(first), np.array(last), np.array(is_leaf)))
        nodes = below
    return CoverTree(vectors, np.concatenate(order) if order else np.zeros(0, np.int64), levels, norm2)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles; beyond 2^53 they are computed as Python integers."""
    largest = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return (whole(a) @ whole(b).T).astype(np.int64)


def _leaf_bounds(tree: CoverTree, anchors: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Of each leaf and anchor whose window it may touch: leaf (first, last), anchor and upper bound."""
    size2 = np.einsum("ij,ij->i", anchors, anchors)
    slack = 1e-6 + 1e-9 * (size2 + tree.norm2)[:, None]
    alive = np.ones((len(anchors), 1), bool)
    out = []
    for depth, level in enumerate(tree.levels):
        total = (size2 + tree.norm2)[:, None]
        away = np.sqrt(np.maximum(total - 2 * (anchors @ level.centre.T), 0.0))
        upper = (total - np.maximum(away - level.radius, 0.0) ** 2) / 2 + slack
        lower = (total - (away + level.radius) ** 2) / 2 - slack
        inside = (upper >= low[:, None]) & (lower <= high[:, None])
        alive = inside if depth == 0 else inside & alive[:, level.parent]
        who, node = np.nonzero(alive & level.leaf)
        out.append((level.first[node], level.last[node], who, upper[who, node]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def search(tree: CoverTree, anchors: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, allowed, k: int):
    """``anchor, window, candidate, score``: of each anchor's windows the ``k`` allowed candidates of the highest scores.

    ``low`` and ``high`` have a row for each anchor and a column for each window (a window with ``low > high`` is none);
    ``allowed(anchors, candidates)`` says of pairs whether they count; ties go to the smaller ``ids``. Each anchor looks at its
    leaves in descending order of their upper bounds, ever more in a step, until none can still enter a window.
    """
    none = np.zeros(0, np.int64)
    best = (none, none, none, none)
    if not len(tree.order) or not len(anchors):
        return best
    real = low <= high
    least = np.where(real, low, np.inf)
    first, last, who, upper = _leaf_bounds(tree, anchors, least.min(axis=1), np.where(real, high, -np.inf).max(axis=1))
    turn = np.lexsort((-upper, who))
    first, last, who, upper = first[turn], last[turn], who[turn], upper[turn]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    need = least.copy()  # the score a candidate must reach to enter a window
    start, step = 0, 1
    while True:
        open_ = upper >= need.min(axis=1)[who]
        now = open_ & (rank >= start) & (rank < start + step)
        if now.any():
            best = _merged(best, _verified(tree, anchors, first[now], last[now], who[now], need, high, allowed), ids, k)
            need = least.copy()
            a, w, _, s = best
            edge = np.flatnonzero(np.append((a[1:] != a[:-1]) | (w[1:] != w[:-1]), True)) if len(a) else none
            full = np.diff(np.append(-1, edge)) == k
            need[a[edge[full]], w[edge[full]]] = s[edge[full]]
        start, step = start + step, step * 2
        if not (open_ & (rank >= start)).any():
            return best


def _verified(tree, anchors, first, last, who, need, high, allowed):
    """Scores of all pairs of anchors and points of the leaves they look at that fall into a window."""
    turn = np.lexsort((who, first))
    first, last, who = first[turn], last[turn], who[turn]
    edge = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    found = []
    for b, e in zip(edge, np.append(edge[1:], len(first)), strict=True):
        points = tree.order[first[b] : last[b]]
        a = who[b:e]
        score = products(anchors[a], tree.vectors[points])
        x, y = np.nonzero((score >= need[a].min(axis=1)[:, None]) & allowed(a[:, None], points[None, :]))
        a, p, s = a[x], points[y], score[x, y]
        z, w = np.nonzero((s[:, None] >= need[a]) & (s[:, None] <= high[a]))
        found.append((a[z], w, p[z], s[z]))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _merged(best, more, ids, k):
    a, w, p, s = (np.concatenate(x) for x in zip(best, more, strict=True))
    turn = np.lexsort((ids[p], -s, w, a))
    a, w, p, s = a[turn], w[turn], p[turn], s[turn]
    new = np.append(True, (a[1:] != a[:-1]) | (w[1:] != w[:-1]))[: len(a)]
    start = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    keep = np.arange(len(a)) - start < k
    return a[keep], w[keep], p[keep], s[keep]
