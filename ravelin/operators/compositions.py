"""Owners with the most alike sets of items, exactly: owners lie in strips, every strip meets every other where both are read, and of the pairs that
are counted only the best of each owner leave a task."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators.graphs import _cut

#: Rows of a strip at about, strips that a task holds to meet one, and places of pairs that are counted at once (or those of one owner).
STRIP, STRIPS, AT_ONCE = 2_000_000, 15, 2_000_000
#: Similarities are compared in these parts of one, as they are rounded.
UNIT = 1_000_000


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(x.max())) if len(x) else x.astype(np.uint8)


def _gaps(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers as steps from one to the next (modulo the range of a long)."""
    return _small(np.diff(x).view(np.uint64))


def _from_gaps(first: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    return np.concatenate([first, gaps.astype(np.int64)]).cumsum()


def strip(frames):
    """Frames (_o, _i, _none) of a partition to one row (id, strip): which owners have which items, by item; a missing item counts for an owner's
    size and is shared with nobody."""
    held, n, most = [], 0, 2 * STRIP
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n > most:
            held = [pd.concat(held).drop_duplicates()]
            n, most = len(held[0]), max(2 * STRIP, 2 * len(held[0]))
    if not n:
        return
    rows = pd.concat(held)
    owners, who = np.unique(rows._o.to_numpy(), return_inverse=True)
    none = rows._none.to_numpy()
    items, of = np.unique(rows._i.to_numpy()[~none], return_inverse=True)
    own = np.unique(of * len(owners) + who[~none])
    of, by = own // len(owners), own % len(owners)
    size = np.bincount(by, minlength=len(owners))
    size[np.unique(who[none])] += 1
    out = io.BytesIO()
    np.savez(out, ends=items[[0, -1]] if len(items) else items, owner0=owners[:1], owners=_gaps(owners), size=_small(size), item0=items[:1], items=_gaps(items), count=_small(np.bincount(of, minlength=len(items))), by=_small(by))
    yield pd.DataFrame({"id": owners[:1], "strip": [out.getvalue()]})


class _Strip:
    def __init__(self, packed: bytes):
        self.of = np.load(io.BytesIO(packed))
        self.ends = self.of["ends"]

    def opened(self) -> _Strip:
        x = self.of
        self.owners, self.size = _from_gaps(x["owner0"], x["owners"]), x["size"].astype(np.int64)
        self.items, self.count, self.by = _from_gaps(x["item0"], x["items"]), x["count"].astype(np.int64), x["by"]
        self.start = np.cumsum(self.count) - self.count
        return self


class _Best:
    """The best of each owner of a strip, as far as others were met."""

    def __init__(self, packed: bytes, top: int):
        self.own, self.top = _Strip(packed).opened(), top
        by = self.own.by
        # the items of each owner, one owner after the other
        self.item = np.repeat(np.arange(len(self.own.items)), self.own.count)[np.argsort(by, kind="stable")]
        self.to = np.concatenate([[0], np.bincount(by, minlength=len(self.own.owners)).cumsum()])
        self.least = np.zeros(len(self.own.owners), np.int64)
        self.rows = [np.zeros((0, 5), np.int64)]

    def meet(self, packed: bytes) -> None:
        own, other = self.own, _Strip(packed)
        if not len(own.ends) or not len(other.ends) or own.ends[1] < other.ends[0] or other.ends[1] < own.ends[0]:
            return
        other.opened()
        at = np.minimum(np.searchsorted(other.items, own.items), len(other.items) - 1)
        count = np.where(other.items[at] == own.items, other.count[at], 0)
        if not count.any():
            return
        start, places = other.start[at], count[self.item]
        upto = np.concatenate([[0], places.cumsum()])[self.to]
        low = 0
        while low < len(own.owners):
            high = max(low + 1, int(np.searchsorted(upto, upto[low] + AT_ONCE, side="right")) - 1)
            if upto[high] > upto[low]:
                self._count(other, low, high, start, places)
            low = high
        if sum(map(len, self.rows)) > 4 * self.top * len(own.owners):
            self._trim()

    def _count(self, other: _Strip, low: int, high: int, start: np.ndarray, places: np.ndarray) -> None:
        own, width = self.own, len(other.owners)
        at = slice(self.to[low], self.to[high])
        n = places[at]
        a = np.repeat(np.arange(high - low), np.diff(self.to[low : high + 1]))
        b = other.by[np.repeat(start[self.item[at]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        pair = np.repeat(a * width, n) + b
        if (high - low) * width < 2**32:
            pair = pair.astype(np.uint32)
        pair.sort()
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        shared = np.diff(np.concatenate([first, [len(pair)]]))
        pair = pair[first].astype(np.int64)
        a, b = pair // width, pair % width
        union = own.size[low + a] + other.size[b] - shared
        score = (2 * UNIT * shared + union) // (2 * union)
        kept = (score >= self.least[low + a]) & (own.owners[low + a] != other.owners[b])
        # by owner, then the best, then the smallest other one
        order = (a[kept] * (UNIT + 1) + UNIT - score[kept]) * width + b[kept]
        order.sort()
        a, rest = order // (width * (UNIT + 1)), order % (width * (UNIT + 1))
        new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[: len(a)])
        best = np.arange(len(a)) - np.repeat(new, np.diff(np.concatenate([new, [len(a)]]))) < self.top
        a, rest = a[best], rest[best]
        b = rest % width
        self.rows.append(np.stack([low + a, UNIT - rest // width, other.owners[b], other.size[b], shared[np.searchsorted(pair, a * width + b)]], axis=1))

    def _trim(self) -> np.ndarray:
        rows = np.concatenate(self.rows)
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        new = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])[: len(rows)])
        rank = np.arange(len(rows)) - np.repeat(new, np.diff(np.concatenate([new, [len(rows)]])))
        last = rows[rank == self.top - 1]
        self.least[last[:, 0]] = last[:, 1]
        self.rows = [rows[rank < self.top]]
        return self.rows[0]

    def frame(self) -> pd.DataFrame:
        a, _, b, size, shared = self._trim().T
        return pd.DataFrame({"a": self.own.owners[a], "na": self.own.size[a], "b": b, "nb": size, "shared": shared})


def best(frames, top: int):
    """Frames (id, own, other), the others of a strip one after the other, to (a, na, b, nb, shared): the best of each owner of a strip."""
    at, found = None, None
    for frame in frames:
        for k, own, other in zip(frame["id"], frame["own"], frame["other"], strict=True):
            if found is None or k != at:
                if found is not None:
                    yield found.frame()
                at, found = k, _Best(own, top)
            found.meet(other)
    if found is not None:
        yield found.frame()


def nearest(items: DataFrame, owner: str, item: str, top: int) -> DataFrame:
    """(a, na, b, nb, shared): of each owner the ``top`` others and more, by the rounded share of items that both have among all that one has (equal
    ones by the smaller owner), with the numbers of distinct items; owners and items are whole numbers.

    Rows are shuffled once, by owner, and written as strips of a few bytes a row. A task reads one strip and several others from the shared
    folder, so neither pairs nor lists of owners are shuffled or written: what goes on is the best of each owner in each task.
    """
    rows = items.count()
    parts = max(items.sparkSession.sparkContext.defaultParallelism, -(-rows // STRIP))
    own = items.select(F.col(owner).cast("long").alias("_o"), F.coalesce(F.col(item).cast("long"), F.lit(0)).alias("_i"), F.col(item).isNull().alias("_none")).where("_o is not null")
    strips = _cut(own.repartitionByRange(parts, "_o").mapInPandas(strip, "id long, strip binary"))
    others = strips.select(F.col("strip").alias("other")).coalesce(max(1, -(-rows // (STRIP * STRIPS))))
    each = strips.withColumnRenamed("strip", "own").crossJoin(others.hint("shuffle_replicate_nl"))
    return each.mapInPandas(lambda frames: best(frames, top), "a long, na long, b long, nb long, shared long")
