"""How many roots reach each node, without a row for each pair.

Roots are numbered along a forest (each node's smallest successor is its parent), so that the roots below a node of the forest are one run of
numbers. What reaches a node is a list of runs: one for a node of the forest, and a few more where links run across it. Nodes pass
their runs on once, when all that lead to them are known, so rows are the edges' and the runs'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators.graphs import _cut
from ravelin.operators.ordered import placed

#: Runs of one node are merged in so many parts first, so a hub's runs aren't sorted by one task.
PARTS = 16


def merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): runs of numbers with those that touch or overlap united, for each of ``keys``."""

    def united(rows: DataFrame, by: list[str]) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("lo", "hi")
        rows = rows.withColumn("_far", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.withColumn("_run", F.sum(F.when(F.col("lo") <= F.col("_far") + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.groupBy(*by, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_run")

    rows = runs.select(*keys, "lo", "hi").distinct().withColumn("_part", F.pmod(F.xxhash64("lo"), F.lit(PARTS)))
    return united(united(rows, [*keys, "_part"]).drop("_part"), keys).select(*keys, "lo", "hi")


def numbered_roots(edges: DataFrame) -> DataFrame:
    """(node, lo): the roots (nodes that no edge (_s, _d) leads to), numbered from 0 so that those below one node of the forest follow each other."""
    up = edges.groupBy(F.col("_s").alias("node")).agg(F.min("_d").alias("next"))
    roots = _cut(edges.select(F.col("_s").alias("node")).distinct().join(edges.select(F.col("_d").alias("node")).distinct(), "node", "left_anti"))
    # doubling: after k rounds a path holds the 2^k nodes ahead; only the order of paths matters, so where they end (in a cycle, too) is no fault
    path = _cut(up.select("node", F.array("next").alias("path"), F.col("next").alias("end")))
    for _ in range(5):
        on = path.select(F.col("node").alias("end"), F.col("path").alias("_p"), F.col("end").alias("_e"))
        path = _cut(path.join(on, "end", "left").select("node", F.coalesce(F.concat("path", "_p"), "path").alias("path"), F.coalesce("_e", "end").alias("end")))
    return placed(roots.join(path, "node").select("node", F.reverse("path").alias("path")), [F.asc("path"), F.asc("node")], name="lo").select("node", (F.col("lo") - 1).cast("long").alias("lo"))


def root_counts(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, n): how many roots reach each node that is no root itself; 0 for a node that only cycles lead to.

    Repeated edges and edges from a node to itself count nothing. Nodes are settled in waves: a node passes its runs on when all edges into
    it have brought theirs. Nodes in and behind cycles can't be settled so; their runs go round until nothing is added.
    """
    step = _cut(edges.select(F.col(src).alias("_s"), F.col(dst).alias("_d")).where("_s is not null and _d is not null and _s <> _d").distinct())
    due = step.groupBy(F.col("_d").alias("node")).agg(F.count("*").alias("due"))
    runs = _cut(numbered_roots(step).select("node", "lo", F.col("lo").alias("hi")))
    ready = runs.select("node")
    waiting, all_runs = _cut(due.select("node", "due")), [runs]
    while True:
        arrived = ready.join(step, F.col("node") == F.col("_s")).groupBy("_d").agg(F.count("*").alias("got"))
        waiting = _cut(waiting.join(arrived, F.col("node") == F.col("_d"), "left").select("node", (F.col("due") - F.coalesce("got", F.lit(0))).alias("due"), F.col("got").isNotNull().alias("new")))
        ready = waiting.where("due = 0").select("node")
        if ready.isEmpty():
            break
        known = all_runs[0]
        for r in all_runs[1:]:
            known = known.union(r)
        into = step.join(ready.withColumnRenamed("node", "_d"), "_d", "left_semi").join(known.withColumnRenamed("node", "_s"), "_s")
        all_runs.append(_cut(merged(into.select(F.col("_d").alias("node"), "lo", "hi"), ["node"])))
        if len(all_runs) > 8:
            whole = all_runs[0]
            for r in all_runs[1:]:
                whole = whole.union(r)
            all_runs = [_cut(whole)]
        waiting = waiting.where("due > 0").select("node", "due")
    known = all_runs[0]
    for r in all_runs[1:]:
        known = known.union(r)
    left = waiting.select("node")
    if not left.isEmpty():
        known = known.union(_around(step, known, left))
    counts = known.groupBy("node").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))
    return due.select("node").join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"))


def _around(step: DataFrame, known: DataFrame, left: DataFrame) -> DataFrame:
    """(node, lo, hi) of nodes that wait for each other: what settled nodes bring, sent on among them until no node gains a number."""
    own = step.join(left.withColumnRenamed("node", "_d"), "_d", "left_semi")
    among = _cut(own.join(left.withColumnRenamed("node", "_s"), "_s", "left_semi"))
    runs = _cut(merged(own.join(known.withColumnRenamed("node", "_s"), "_s").select(F.col("_d").alias("node"), "lo", "hi"), ["node"]))
    size = -1
    while True:
        now = runs.agg(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] or 0
        if now == size:
            return runs
        size = now
        sent = among.join(runs.withColumnRenamed("node", "_s"), "_s").select(F.col("_d").alias("node"), "lo", "hi")
        runs = _cut(merged(runs.union(sent), ["node"]))
