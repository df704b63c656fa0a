"""Exact vector search over an array column: one query in expressions, many queries in blocks; ``vectorindex`` has the approximate one."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators.ordered import placed
from ravelin.sources.files import scratch

#: Query vectors that are broadcast in one job, those that are scored at once and with how many rows, and the least similarity that counts as near.
QUERY_BLOCK, SCORED_AT_ONCE, ROWS_AT_ONCE, FLOOR = 32_768, 1024, 256, 0.45
#: Stands for no second object.
NONE = np.iinfo(np.int64).min


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def nearest(rows: DataFrame, ident: str, vector: str, query: list[float], top: int, floor: float = -1.0) -> DataFrame:
    """The ``top`` rows by cosine similarity with a query vector; a top-k on every task, so only ``top`` rows of each move."""
    scored = rows.select(ident, cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    return scored.where(F.col("score") >= floor).orderBy(F.desc("score"), ident).limit(top)


def _unit(column: pd.Series) -> np.ndarray:
    found = np.array(column.tolist(), dtype=float)
    size = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, size, out=np.full_like(found, np.nan), where=size > 0)


def _best_of(hits: list[pd.DataFrame], top: int) -> pd.DataFrame:
    found = pd.concat(hits).sort_values(["score", "found"], ascending=[False, True], kind="stable")
    return found.drop_duplicates(["query", "found"]).groupby("query", sort=False).head(top)


def _pieces(rows: DataFrame, own: Column, vector: str) -> DataFrame:
    """(v, first, second, same): each distinct vector with the two smallest objects that have it, and how many have it.

    The ranks are limited before the shuffle, so a vector of a third of all rows doesn't move whole.
    """
    pairs = rows.select(own.cast("long").alias("o"), F.col(vector).alias("v")).where("v is not null and o is not null").distinct()
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("o"))
    two = pairs.withColumn("_r", rank).where("_r <= 2").groupBy("v").agg(F.min("o").alias("first"), F.max("o").alias("last"))
    return two.join(pairs.groupBy("v").agg(F.count("*").alias("same")), "v").select("v", "first", F.when(F.col("last") > F.col("first"), F.col("last")).alias("second"), "same")


def best_pieces(frames: Iterator[pd.DataFrame], ids: np.ndarray, owners: np.ndarray, units: np.ndarray, floor: float, top: int) -> Iterator[pd.DataFrame]:
    """(query, found, score, same): what a task keeps: of its pieces the ``top`` objects of each query.

    A few rows are scored at a time, and of these only what is no worse than the worst that a full list holds goes on, so memory doesn't
    depend on how many rows there are.
    """
    kept: dict[int, pd.DataFrame] = {}
    bars = np.full(len(ids), floor)
    for frame in frames:
        if not len(frame):
            continue
        them, first, same = _unit(frame.v).T, frame["first"].to_numpy(), frame.same.to_numpy()
        second = frame.second.fillna(NONE).to_numpy(np.int64)
        for row, at in product(range(0, len(frame), ROWS_AT_ONCE), range(0, len(ids), SCORED_AT_ONCE)):
            here, some = slice(at, at + SCORED_AT_ONCE), slice(row, row + ROWS_AT_ONCE)
            scores, other = units[here] @ them[:, some], owners[here, None] == first[None, some]
            scores[np.isnan(scores) | (other & (second[some] == NONE)[None, :])] = -np.inf
            q, n = np.nonzero(scores >= bars[here, None])
            if not len(q):
                continue
            now = pd.DataFrame({"query": ids[here][q], "found": np.where(other[q, n], second[some][n], first[some][n]), "score": scores[q, n], "same": same[some][n]})
            kept[at] = _best_of([now] if at not in kept else [kept[at], now], top)
            full = kept[at].groupby("query").score.agg(["size", "min"])
            bars[here] = np.fmax(bars[here], full["min"].where(full["size"] == top).reindex(ids[here]).to_numpy())
    yield from kept.values()


def nearest_many(rows: DataFrame, queries: DataFrame, ident: str, vector: str, top: int, floor: float = FLOOR, owner: Column | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query, found, score, same, rank): for each row of ``queries`` the ``top`` other objects of ``rows`` by cosine similarity, ``floor`` at least.

    ``owner`` is the object that a row is a piece of (else the row itself): an object counts by its best piece, and a query never finds its
    own object. Of pieces with equal vectors the one with the smallest object besides the query's own counts; ``same`` says how many
    objects have that vector. Rows that repeat a query's id with another vector ask together. Queries are broadcast in blocks, a job each,
    whose hits are written; each task keeps ``top`` of each query, and what the tasks kept is merged. Ties go to the smallest object.
    """
    spark = rows.sparkSession
    own = F.col(ident) if owner is None else owner
    pieces = _pieces(rows, own, vector)
    place = scratch(spark)
    pieces.write.parquet(f"{place}/pieces")
    pieces = spark.read.schema(pieces.schema).parquet(f"{place}/pieces")
    asked = queries.select(F.col(ident).cast("long").alias("q"), own.cast("long").alias("o"), F.col(vector).alias("v")).where("v is not null and q is not null")
    # blocks are cut by a running number, so that rows that repeat an id stay
    placed(asked, [F.asc("q"), F.asc("o"), F.xxhash64("v").asc()], name="at").write.parquet(f"{place}/asked")
    asked = spark.read.parquet(f"{place}/asked")
    found = "query long, found long, score double, same long"
    for k in range(-(-asked.count() // block)):
        part = asked.where((F.col("at") > k * block) & (F.col("at") <= (k + 1) * block)).toPandas()
        held = spark.sparkContext.broadcast((part.q.to_numpy(), part.o.to_numpy(), _unit(part.v)))

        def search(frames, held=held):
            yield from best_pieces(frames, *held.value, floor, top)

        pieces.select("v", "first", "second", "same").mapInPandas(search, found).write.parquet(f"{place}/hits/block={k}")
        held.unpersist()
    hits = spark.read.schema(found).parquet(f"{place}/hits") if asked.count() else spark.createDataFrame([], found)
    best = hits.groupBy("query", "found").agg(F.max(F.struct("score", "same")).alias("b")).select("query", "found", "b.*")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "found")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact (query, found) pairs that were found."""
    hits = exact.select("query", "found").join(found.select("query", "found", F.lit(1).alias("hit")), ["query", "found"], "left")
    return hits.agg(F.count("*").alias("wanted"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))
