"""The scan over recipes: what is unchanged isn't measured again, and false findings are held down; samples are parts of a table."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ravelin.operators import insights, metrics, numeric

SCHEMA = "axis string, key string, period date, hits long, total long"


def cells(seed=1, loud=()):
    rng = random.Random(seed)
    rows = []
    for axis, keys in (("a", 30), ("b", 4)):
        for k in range(keys):
            for m in range(24):
                total = rng.randrange(20, 60)
                p = 0.4 if (axis, k) in loud else 0.1
                rows.append((axis, f"k{k}", datetime.date(2020 + m // 12, m % 12 + 1, 1), sum(rng.random() < p for _ in range(total)), total))
    return rows


def test_unchanged_cells_keep_what_was_said(spark):
    rows, calls = cells(), []
    old = insights.measured(spark.createDataFrame(rows, SCHEMA)).persist()
    changed = [(*r[:3], r[3] + 1, r[4] + 1) if r[:2] == ("b", "k2") and r[2].month == 3 else r for r in rows]

    def counted(df):
        calls.append(df.select("axis").distinct().collect())
        return insights.share(df)

    now = insights.measured(spark.createDataFrame(changed, SCHEMA), old, {**insights.RECIPES, "share": counted})
    assert [[r.axis for r in c] for c in calls] == [["b"]]
    whole = insights.measured(spark.createDataFrame(changed, SCHEMA))
    near = lambda df: sorted((r.recipe, r.axis, r.key, round(r.strength, 9), round(r.statistic, 6), r.df, r.support, r.print) for r in df.collect())
    assert near(now) == near(whole) and near(now) != near(old)
    assert near(insights.measured(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), old)) == near(old)


def test_false_findings_are_held_down(spark):
    quiet = insights.judged(insights.measured(spark.createDataFrame(cells(2), SCHEMA)), 0.05)
    assert quiet.where("kept").count() <= 2
    rows = insights.judged(insights.scored(insights.measured(spark.createDataFrame(cells(3, {("a", 4), ("b", 1)}), SCHEMA)))).collect()
    assert {(r.axis, r.key) for r in rows if r.kept and r.recipe == "share"} >= {("a", "k4"), ("b", "k1")}
    ps = sorted((numeric.chi2_tail(r.statistic, r.df), r.recipe, r.axis, r.key) for r in rows)
    want, least = {}, 1.0
    for rank in range(len(ps), 0, -1):
        least = min(least, ps[rank - 1][0] * len(ps) / rank)
        want[ps[rank - 1][1:]] = least
    assert {(r.recipe, r.axis, r.key): r.q for r in rows} == pytest.approx(want)


def test_cells_without_hits_or_months(spark):
    rows = [("a", "x", datetime.date(2020, 1, 1), 0, 10), ("a", "y", datetime.date(2020, 1, 1), 10, 10), ("b", "z", datetime.date(2020, 1, 1), 0, 0)]
    found = insights.judged(insights.scored(insights.measured(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert {(r.recipe, r.key) for r in found} == {("share", "y")}
    assert insights.judged(insights.scored(insights.measured(spark.createDataFrame([], SCHEMA)))).collect() == []


def test_a_sample_reads_its_parts_only(spark, tmp_path):
    rows = spark.range(4000).select("id", (F.col("id") * 7919 % 300).alias("k"))
    laid = metrics.laid_out(rows, "id", str(tmp_path / "laid"))
    plan = metrics.sampled_combos(laid, ["k"], 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and "(_part" in plan and "< 2)" in plan
    small, half, all_ = (metrics.sampled_combos(laid, ["k"], e).first() for e in (1, 4, 8))
    assert 0.06 * 4000 < small.rows < 0.2 * 4000 and small.rows < half.rows < all_.rows == 4000 and all_.combos == 300
    got = metrics.estimate(laid, ["k"], 4000)
    assert abs(got.first().blended - 300) < 60 and got.first().error <= 0.1


def test_cells_are_made_once(spark):
    from ravelin.plans.ingest import insight_cells
    from ravelin.sources.tables import Tables

    # recipes read the cells many times, and never the tables behind them
    cells = insight_cells(Tables(spark, "/root/testdata/sf0.001"))
    plan = insights.measured(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def odd_tables(folder):
    """Lines with months and flags that aren't known, and parts, orders and customers whose keys repeat."""
    import duckdb

    con, data = duckdb.connect(), "/root/testdata/sf0.001"
    month = "(year(l_shipdate) * 12 + month(l_shipdate)) % 5"
    con.sql(f"COPY (SELECT * EXCLUDE (c_nationkey) REPLACE (CASE WHEN l_linenumber = 2 THEN NULL ELSE l_shipdate END AS l_shipdate, CASE WHEN {month} = 0 THEN NULL WHEN c_nationkey = 3 THEN 'R' ELSE l_returnflag END AS l_returnflag) FROM (SELECT l.*, c_nationkey FROM '{data}/lineitem.parquet' l LEFT JOIN '{data}/orders.parquet' ON l_orderkey = o_orderkey LEFT JOIN '{data}/customer.parquet' ON o_custkey = c_custkey)) TO '{folder}/lineitem.parquet'")
    for table, key, n in (("part", "p_partkey", 3), ("orders", "o_orderkey", 4), ("customer", "c_custkey", 1000000)):
        con.sql(f"COPY (SELECT * FROM '{data}/{table}.parquet' UNION ALL SELECT * FROM '{data}/{table}.parquet' WHERE {key} % {n} = 1) TO '{folder}/{table}.parquet'")
    for table in ("lineitem", "part", "orders", "customer"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def test_no_line_is_left_out_of_cells(spark, tmp_path):
    from ravelin import catalog
    from ravelin.plans.ingest import insight_cells
    from ravelin.sources.tables import Tables

    con = odd_tables(tmp_path)
    for name in ("insight_share", "insight_recent", "insight_unsteady", "insight_scan"):
        sql, found = catalog.oracle_sql()[name], catalog.queries()[name](spark, str(tmp_path))
        order = ", ".join(found.columns)
        want = con.sql(f"SELECT {order} FROM ({sql})").fetchall()
        assert sorted(map(tuple, found.collect())) == sorted(want) and want
    cells = insight_cells(Tables(spark, str(tmp_path)))
    want = con.sql("SELECT c_nationkey::VARCHAR, date_trunc('month', l_shipdate)::DATE, count(*) FILTER (l_returnflag = 'R'), count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2").fetchall()
    got = cells.where("axis = 'nation'").drop("axis").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and any(r.period is None for r in got)
    # returns that only a nation stands out by are found
    judged = {(r.recipe, r.axis, r.key) for r in catalog.queries()["insight_judged"](spark, str(tmp_path)).collect()}
    assert ("share", "nation", "3") in judged
