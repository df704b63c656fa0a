"""Loops over rounds: whole results however deep or many, and nothing of a round's size through the driver."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from ravelin import catalog
from ravelin.operators import graphs, ordered, vectors


def chain(spark, n):
    return spark.createDataFrame([(k, k + 1, 1) for k in range(n)], "a long, b long, q long")


def test_parts_list_is_whole_and_ends_at_a_cycle(spark):
    lines = graphs.indented(chain(spark, 23), 0, "a", "b", "q").collect()
    assert sorted((r.level, r.node, len(r.path)) for r in lines) == [(k, k, k + 1) for k in range(1, 24)]
    with pytest.raises(ValueError, match="cycle"):
        graphs.indented(chain(spark, 3).union(spark.createDataFrame([(3, 1, 1)], "a long, b long, q long")), 0, "a", "b", "q")


def test_rounds_broadcast_nothing(spark, monkeypatch):
    plans, cut = [], graphs._cut

    def told(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(graphs, "_cut", told)
    edges = chain(spark, 3)
    graphs.explosion(edges, 0, "a", "b", "q").collect()
    graphs.chains(edges, 0, 3, "a", "b")
    graphs.subtree_fold(edges, edges.selectExpr("b as node", "q as v"), "a", "b", "v")
    joined = [p for p in plans if "Join" in p]
    assert joined and not [p for p in joined if "BroadcastHashJoin" in p]


def test_exact_search_keeps_few_rows_in_memory():
    rng = np.random.default_rng(3)
    rows, units = rng.normal(size=(10_000, 8)), vectors._unit(pd.Series(list(rng.normal(size=(1024, 8)))))
    frames = [pd.DataFrame({"v": list(rows), "first": np.arange(10_000), "second": np.full(10_000, np.nan), "same": 1})]
    ids = np.arange(1024)
    tracemalloc.start()
    got = pd.concat(vectors.best_pieces(iter(frames), ids, -1 - ids, units, -1.0, 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    best = np.sort(units @ vectors._unit(frames[0].v).T, axis=1)[:, :-6:-1]
    assert np.allclose(np.stack([g.sort_values("score", ascending=False).score for _, g in got.groupby("query")]), best)
    assert peak < 100e6


def test_least_from_a_row_on_is_read_once(spark):
    rows = spark.createDataFrame([(k, float((7 * k) % 11)) for k in range(40)], "k long, v double")
    out = ordered.placed(rows, [F.asc("k")], least={"m": F.col("v")})
    v = [(7 * k) % 11 for k in range(40)]
    assert [(r["rank"], r.m) for r in out.orderBy("k").collect()] == [(k + 1, min(v[k:])) for k in range(40)]
    # a frame from the row to the end is read anew for each row, which costs the square of a piece
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().toString()


def test_scans_of_series_are_dealt_by_number(spark):
    found = catalog.queries()["stat_changes_scan"](spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
