"""Approximate vector search: lists around centres, compact codes in the lists, exact scores for a short list.

Directions are cut into about sqrt(n) lists. A row is written with its list and a code of one byte for each part of the vector, in files that
are ranges of (list, id), so a list of any size is several pieces and a read of some lists skips the rest. A search looks into the nearest
lists of its query, ranks their rows by code, and scores only the best of these exactly. How many lists and rows that takes depends on the
data (on clustered directions few lists do, on scattered ones most are needed), so it is measured on some rows when the index is made.

The short list is never brought together: a query's floor, the approximate score that its short list ends at, is read off the rows that
codes were fitted to, and a task scores what reaches the floor where it reads it and keeps only the best of each query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators.vectors import ROWS_AT_ONCE, SCORED_AT_ONCE, _best_of, _unit, nearest_many
from ravelin.sources.files import scratch

#: Rows that centres and codes are fitted to at most (every row is indexed), rows that the search is tuned by, lists at most, rounds of fitting.
SAMPLE, TUNED_BY, MOST_LISTS, ROUNDS = 20_000, 200, 5_000, 10
#: Parts of a code (fewer if the vector has fewer components), and values of a part.
PARTS, VALUES = 16, 256
#: Queries that are broadcast in one job, those whose floors are read off at once, and hits that a task gathers before it keeps the best.
QUERY_BLOCK, FLOORS_AT_ONCE, GATHERED = 8192, 128, 100_000
#: Share of the tuning neighbours that must lie in the lists looked into, and of these in the short list.
IN_LISTS, IN_SHORT_LIST = 0.98, 0.98


def _near(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of each point's nearest centre, some points at a time."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(points[at : at + SCORED_AT_ONCE] @ centres.T - half).argmax(axis=1) for at in range(0, max(len(points), 1), SCORED_AT_ONCE)])


def _means(points: np.ndarray, k: int) -> np.ndarray:
    """Centres of ``k`` groups at most, by rounds of assignment and averaging, from the first distinct points on."""
    centres = np.unique(points[: 4 * k], axis=0)[:k]
    for _ in range(ROUNDS):
        near = _near(points, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


class Codes:
    """Compact codes: each part of a vector is the nearest of a few values for that part."""

    def __init__(self, units: np.ndarray):
        parts = min(PARTS, units.shape[1])
        self.edges = [round(k * units.shape[1] / parts) for k in range(parts + 1)]
        self.books = [_means(units[:, a:b], min(VALUES, max(1, len(units) // 4))) for a, b in zip(self.edges, self.edges[1:])]

    def encode(self, units: np.ndarray) -> np.ndarray:
        near = [_near(units[:, a:b], book) for a, b, book in zip(self.edges, self.edges[1:], self.books)]
        return np.stack(near, axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)


def _unpacked(codes: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(c, np.uint8) for c in codes])


def best_rows(frames: Iterator[pd.DataFrame], ids: np.ndarray, units: np.ndarray, into: np.ndarray, floors: np.ndarray, codes: Codes, top: int) -> Iterator[pd.DataFrame]:
    """(query, found, score, scored): what a task keeps: of the rows in the lists of a query whose codes reach its floor, the ``top`` by exact
    score; and in a row of its own, how many were scored. Memory doesn't depend on how many rows there are or reach the floor."""
    kept, hits, waiting, scored = None, [], 0, 0
    bars, last = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
    for frame in frames:
        if not len(frame):
            continue
        own, of, exact, them = frame.id.to_numpy(), frame["list"].to_numpy(), _unit(frame.v), codes.decode(_unpacked(frame.code))
        ends = [*(np.flatnonzero(np.diff(of)) + 1), len(of)]
        for a, b in zip([0, *ends], ends):
            asked = np.flatnonzero(into[:, of[a]])
            for row, at in product(range(a, b, ROWS_AT_ONCE), range(0, len(asked), SCORED_AT_ONCE)):
                here, some = asked[at : at + SCORED_AT_ONCE], slice(row, min(row + ROWS_AT_ONCE, b))
                q, n = np.nonzero((units[here] @ them[some].T >= floors[here, None]) & (ids[here, None] != own[None, some]))
                q, n, scored = here[q], n + row, scored + len(q)
                score = np.einsum("ij,ij->i", units[q], exact[n])
                better = (score > bars[q]) | ((score == bars[q]) & (own[n] < last[q]))
                hits.append(pd.DataFrame({"query": q[better], "found": own[n[better]], "score": score[better]}))
                waiting += len(hits[-1])
                if waiting > GATHERED:
                    kept, hits, waiting = _best_of(hits if kept is None else [kept, *hits], top), [], 0
                    full = kept.groupby("query").agg(n=("score", "size"), score=("score", "last"), found=("found", "last")).query("n == @top")
                    bars[full.index], last[full.index] = full.score, full.found
    if kept is not None or hits:
        kept = _best_of(hits if kept is None else [kept, *hits], top)
        yield pd.DataFrame({"query": ids[kept["query"].to_numpy(np.int64)], "found": kept.found, "score": kept.score, "scored": 0})
    none = pd.array([None], dtype="Int64")
    yield pd.DataFrame({"query": none, "found": none, "score": [np.nan], "scored": [scored]})


def _ordered(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lists of each query, the nearest first."""
    return np.argsort((centres * centres).sum(axis=1) / 2 - units @ centres.T, axis=1, kind="stable")


def _looked_into(units: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Is a list one of the ``probes`` that a query looks into?"""
    into = np.zeros((len(units), len(centres)), bool)
    for at in range(0, len(units), SCORED_AT_ONCE):
        here = slice(at, at + SCORED_AT_ONCE)
        np.put_along_axis(into[here], _ordered(units[here], centres)[:, :probes], True, axis=1)
    return into


class Floors:
    """The approximate score that the short list of a query ends at.

    If codes were fitted to some rows only, it is that of a place among these, three standard deviations further down than its share.
    """

    def __init__(self, ids: np.ndarray, units: np.ndarray, centres: np.ndarray, codes: Codes):
        self.ids, self.centres, self.codes = ids, centres, codes
        self.lists, self.coded = _near(units, centres), codes.encode(units)

    def read(self, ids: np.ndarray, units: np.ndarray, probes: int, short: int, n: int) -> np.ndarray:
        place, floors = short, np.full(len(ids), -np.inf)
        if len(self.ids) < n:
            part = short * len(self.ids) / n
            place = math.ceil(part + 3 * math.sqrt(part) + 3)
        if place > len(self.ids):
            return floors
        them = self.codes.decode(self.coded).T
        for at in range(0, len(ids), FLOORS_AT_ONCE):
            here = slice(at, at + FLOORS_AT_ONCE)
            those = _looked_into(units[here], self.centres, probes)[:, self.lists] & (ids[here, None] != self.ids[None, :])
            scores = np.where(those, units[here] @ them, -np.inf)
            # less than a rounding below, so that the last row of the list is in
            floors[here] = np.partition(scores, len(self.ids) - place, axis=1)[:, len(self.ids) - place] - 1e-9
        return floors


class Index:
    """An index of the rows' vectors; null and zero vectors aren't in it. Ids are those of distinct rows.

    ``probes`` and ``short`` (lists looked into, rows scored exactly, for each query) are tuned to find ``top`` neighbours unless given.
    """

    def __init__(self, rows: DataFrame, ident: str, vector: str, top: int = 5, probes: int | None = None, short: int | None = None):
        self.spark, self.ident, self.vector = rows.sparkSession, ident, vector
        self.place = scratch(self.spark)
        own = rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
        own = own.where(F.exists("v", lambda x: x != 0))
        self.n = own.count()
        few = own.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(SAMPLE).toPandas()
        units = _unit(few.v) if len(few) else np.ones((1, 1))
        lists = max(1, min(MOST_LISTS, round(math.sqrt(self.n)), max(1, len(units) // 4)))
        self.centres, self.codes = _means(units, lists), Codes(units)
        self.floors, self.share = Floors(few.id.to_numpy(np.int64), units, self.centres, self.codes), None
        self._write(own)
        asked = few.id[:TUNED_BY].tolist()
        self.probes, self.short = probes or 1, short or top
        if len(asked) and not (probes and short):
            self._tune(own, asked, top, probes, short)

    def _write(self, own: DataFrame) -> None:
        centres, codes = self.centres, self.codes

        def coded(frames):
            for frame in frames:
                units = _unit(frame.v) if len(frame) else np.zeros((0, centres.shape[1]))
                near = _near(units, centres)
                yield pd.DataFrame({"list": near.astype(np.int32), "id": frame.id, "code": [c.tobytes() for c in codes.encode(units)], "v": frame.v})

        found = own.mapInPandas(coded, "list int, id long, code binary, v array<double>")
        # ranges of (list, id): a large list is cut, small ones share a file
        found.repartitionByRange("list", "id").sortWithinPartitions("list", "id").write.parquet(f"{self.place}/index")
        self.rows = self.spark.read.schema("list int, id long, code binary, v array<double>").parquet(f"{self.place}/index")
        self.sizes = np.zeros(len(centres), np.int64)
        for r in self.rows.groupBy("list").count().collect():
            self.sizes[r["list"]] = r["count"]

    def _tune(self, own: DataFrame, ids: list[int], top: int, probes: int | None, short: int | None) -> None:
        """``probes`` and ``short`` by the places that the exact neighbours of some rows have among lists and among codes."""
        asked = own.where(F.col("id").isin(ids))
        exact = nearest_many(own, asked, "id", "v", top, -1.0).select("query", "found")
        with_list = exact.join(self.rows.select(F.col("id").alias("found"), "list", "code"), "found").toPandas()
        if not len(with_list):
            return
        frame = asked.toPandas().drop_duplicates("id").set_index("id")
        units = _unit(frame.v)
        place = {q: k for k, q in enumerate(frame.index)}
        at = with_list["query"].map(place).to_numpy()
        order = np.argsort(_ordered(units, self.centres), axis=1)
        self.probes = probes or 1 + int(np.quantile(order[at, with_list["list"].to_numpy()], IN_LISTS, method="higher"))
        scores = (units[at] * self.codes.decode(_unpacked(with_list.code))).sum(axis=1)
        codes, own_ids, cut = self.codes, frame.index.to_numpy(), [np.sort(scores[at == k]) for k in range(len(units))]
        reach = order < self.probes

        def ahead(frames):
            """How many rows come before each neighbour, of each query."""
            total = [np.zeros(len(c), np.int64) for c in cut]
            for f in frames:
                if len(f):
                    approx = units @ codes.decode(_unpacked(f.code)).T
                    approx[(own_ids[:, None] == f.id.to_numpy()[None, :]) | ~reach[:, f["list"].to_numpy()]] = -np.inf
                    for k, c in enumerate(cut):
                        total[k] += approx.shape[1] - np.searchsorted(np.sort(approx[k]), c, side="right")
            yield pd.DataFrame([(k, j, x) for k, t in enumerate(total) for j, x in enumerate(t)], columns=["q", "j", "n"])

        before = self.rows.select("list", "id", "code").mapInPandas(ahead, "q int, j int, n long").groupBy("q", "j").agg(F.sum("n").alias("n")).toPandas()
        self.short = short or max(top, 1 + int(np.quantile(before.n, IN_SHORT_LIST, method="higher")))

    def search(self, queries: DataFrame, top: int) -> DataFrame:
        """(query, found, score, rank): the nearest others of each row of ``queries`` (distinct ids) that the index finds."""
        if not self.n:
            return self.spark.createDataFrame([], "query long, found long, score double, rank int")
        asked = queries.select(F.col(self.ident).cast("long").alias("query"), F.col(self.vector).cast("array<double>").alias("w")).where("query is not null and w is not null")
        place, floors, sizes = scratch(self.spark), self.floors, (self.probes, self.short, self.n)

        def floored(frames):
            for frame in frames:
                if len(frame):
                    units = _unit(frame.w)
                    able = np.isfinite(units).all(axis=1)
                    yield frame[able].assign(floor=floors.read(frame["query"].to_numpy()[able], units[able], *sizes))

        n = asked.count()
        blocks = F.pmod(F.xxhash64("query"), F.lit(max(1, -(-n // QUERY_BLOCK)))).cast("int")
        with_floor = "query long, w array<double>, floor double"
        asked.mapInPandas(floored, with_floor).withColumn("block", blocks).write.partitionBy("block").parquet(f"{place}/asked")
        asked = self.spark.read.schema(f"{with_floor}, block int").parquet(f"{place}/asked")
        near, codes = "query long, found long, score double, scored long", self.codes
        for k in [r[0] for r in asked.select("block").distinct().collect()]:
            part = asked.where(F.col("block") == k).toPandas()
            units = _unit(part.w)
            into = _looked_into(units, self.centres, self.probes)
            held = self.spark.sparkContext.broadcast((part["query"].to_numpy(), units, into, part.floor.to_numpy()))
            rows = self.rows
            some = np.flatnonzero(into.any(axis=0)).tolist()
            if len(some) < len(self.centres) // 2:
                rows = rows.where(F.col("list").isin(some))

            def search(frames, held=held):
                yield from best_rows(frames, *held.value, codes, top)

            rows.mapInPandas(search, near).write.parquet(f"{place}/near/block={k}")
            held.unpersist()
        found = self.spark.read.schema(near).parquet(f"{place}/near") if asked.head(1) else self.spark.createDataFrame([], near)
        self.share = (found.agg(F.sum("scored")).first()[0] or 0) / max(n * self.n, 1)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "found")
        best = found.where("query is not null").select("query", "found", "score").withColumn("rank", F.row_number().over(order))
        return best.where(F.col("rank") <= top)

    def read_share(self) -> float:
        """Share of the rows whose codes a query reads, at most: those of the ``probes`` largest lists."""
        return float(np.sort(self.sizes)[::-1][: self.probes].sum() / max(self.n, 1))

    def scored_share(self) -> float:
        """Share of the rows that a query of the last search scored exactly; before a search, of those that a short list has."""
        return self.short / max(self.n, 1) if self.share is None else self.share
