"""Shortest paths from many roots over a graph that a task holds, with numpy: roots stand side by side as columns, and what they reach at a step
are rows."""

from __future__ import annotations

import numpy as np

#: Bytes of the matrices of the roots that are walked at once, and rows that are summed at once.
MEMORY, ROWS = 48_000_000, 512
#: Links of a node that are summed one after the other, for many nodes at once; the others of a node are summed by themselves.
FEW = 64


class Links:
    """Of each of ``n`` nodes the nodes that links lead to, one after the other."""

    def __init__(self, node: np.ndarray, to: np.ndarray, n: int):
        self.to, self.count = to[np.argsort(node, kind="stable")], np.bincount(node, minlength=n)
        self.start = np.cumsum(self.count) - self.count

    def near(self, nodes: np.ndarray) -> np.ndarray:
        n = self.count[nodes]
        return self.to[np.repeat(self.start[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def sorted(self, nodes: np.ndarray) -> np.ndarray:
        return nodes[np.argsort(self.count[nodes], kind="stable")]

    def sums(self, nodes: np.ndarray, rows: np.ndarray, place: np.ndarray):
        """Of some of ``nodes`` (``sorted``) at a time, these and the sums of the rows, which are at ``place``, of what their links lead to."""
        for low in range(0, len(nodes), ROWS):
            own = nodes[low : low + ROWS]
            n, start, out = self.count[own], self.start[own], np.zeros((len(own), rows.shape[1]))
            for k in range(min(n[-1], FEW)):
                first = np.searchsorted(n, k, side="right")
                out[first:] += rows[place[self.to[start[first:] + k]]]
            for x in range(np.searchsorted(n, FEW, side="right"), len(n)):
                for a in range(FEW, n[x], ROWS):
                    out[x] += rows[place[self.to[start[x] + a : start[x] + min(a + ROWS, n[x])]]].sum(axis=0)
            yield own, out


def _placed(nodes: np.ndarray, width: int, row, place: np.ndarray) -> np.ndarray:
    """What ``row`` makes of nodes, some at a time, behind a row of zeros, with their places; all other nodes are at the zeros."""
    place[:] = 0
    place[nodes] = np.arange(1, len(nodes) + 1)
    out = np.zeros((len(nodes) + 1, width))
    for low in range(0, len(nodes), ROWS):
        out[low + 1 : low + 1 + ROWS] = row(nodes[low : low + ROWS])
    return out


def through(source: np.ndarray, target: np.ndarray, size: np.ndarray, mass: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over edges of nodes by number: of each node the sum of what ``roots`` send through it (the ``size`` of what lies behind it, by its share of
    shortest paths) and of the roots that reach it, both times their ``mass``; and of each root the size of all that it reaches.

    Roots that are near each other reach a node at about the same step, so in an order that keeps them together less is summed for nothing.
    """
    n, ahead, back = len(size), Links(source, target, len(size)), Links(target, source, len(size))
    passed, reached, found = np.zeros(n), np.zeros(n, np.int64), np.zeros(len(roots))
    width, place = max(8, MEMORY // (36 * n)), np.zeros(n, np.int64)
    for low in range(0, len(roots), width):
        own = roots[low : low + width]
        at = (own, np.arange(len(own)))
        depth, paths = np.full((n, len(own)), -1, np.int32), np.zeros((n, len(own)))
        depth[at], paths[at] = 0, 1.0
        left = np.full(n, len(own)) - np.bincount(own, minlength=n)
        level, levels = np.unique(own), []
        while len(level):
            levels.append(level)
            k = len(levels)
            rows = _placed(level, len(own), lambda x: np.where(depth[x] == k - 1, paths[x], 0.0), place)
            met = np.zeros(n, bool)
            met[ahead.near(level)] = True
            some = []
            for x, sums in back.sums(back.sorted(np.flatnonzero(met & (left > 0))), rows, place):
                before = depth[x]
                new = (before < 0) & (sums > 0)
                many = new.sum(axis=1)
                left[x] -= many
                depth[x], paths[x] = np.where(new, k, before), np.where(new, sums, paths[x])
                some.append(x[many > 0])
            level = np.concatenate(some) if some else level[:0]
        share = np.zeros((n, len(own)))
        for k in range(len(levels) - 1, 0, -1):
            rows = _placed(levels[k], len(own), lambda x: np.where(depth[x] == k, (size[x, None] + share[x]) / np.maximum(paths[x], 1.0), 0.0), place)
            for x, sums in ahead.sums(ahead.sorted(levels[k - 1]), rows, place):
                share[x] += np.where(depth[x] == k - 1, paths[x] * sums, 0.0)
        found[low : low + width] = share[at]
        share[at], depth[at] = 0.0, -1
        passed += share @ mass[own].astype(float)
        # whole numbers up to 2**53, so a sum of floats is exact
        reached += ((depth >= 0) @ mass[own].astype(float)).astype(np.int64)
    return passed, reached, found


def of_part(frames, parts: int):
    """Frames (part, _s, mass, _d, size) of all edges to (node, through, reached, size) of the roots that belong to a part, as one frame."""
    import pandas as pd

    frames = [f for f in frames if len(f)]
    for part, own in pd.concat(frames).groupby("part") if frames else ():
        ids, ends = np.unique(np.concatenate([own._s.to_numpy(), own._d.to_numpy()]), return_inverse=True)
        source, target = ends[: len(own)], ends[len(own) :]
        size, mass = np.ones(len(ids)), np.zeros(len(ids), np.int64)
        size[target], mass[source] = own["size"], own["mass"]
        roots = np.flatnonzero(mass)
        roots = roots[len(roots) * part // parts : len(roots) * (part + 1) // parts]
        passed, reached, found = through(source, target, size, mass, roots)
        of_root = np.full(len(ids), np.nan)
        of_root[roots] = found
        kept = (reached > 0) | ~np.isnan(of_root)
        yield pd.DataFrame({"node": ids[kept], "through": passed[kept], "reached": reached[kept], "size": of_root[kept]})
