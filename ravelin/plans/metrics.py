"""Questions over metric cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ravelin.functions.scalars import bucket
from ravelin.operators import metrics, summary
from ravelin.plans.registry import RECORDS, question
from ravelin.sources import files

c = F.col
KEYS = ["period", "cohort", "age", "l_returnflag", "l_linestatus"]
CELLS = f"(SELECT period, cohort, age, l_returnflag, l_linestatus, count(*) AS count, count(l_quantity) AS value_count, sum(l_quantity) AS sum, min(l_quantity) AS min, max(l_quantity) AS max FROM {RECORDS} x GROUP BY ALL)"


def cells(t):
    return metrics.cells(t.records, KEYS, c("l_quantity"))


question("metric_cells", f"SELECT * FROM {CELLS}")(cells)


@question("metric_value", "SELECT event_type, count(*) AS count, count(k) AS value_count, sum(k)::DOUBLE AS sum, min(k)::DOUBLE AS min, max(k)::DOUBLE AS max FROM (SELECT event_type, CASE WHEN user_id % 7 <> 0 THEN (props->>'k')::BIGINT END AS k FROM events) GROUP BY 1")
def _(t):
    # numbers that come as text; what isn't one counts as a record without a value
    rows = t.events.withColumn("k", F.when(c("user_id") % 7 == 0, "n/a").otherwise(F.get_json_object("props", "$.k")))
    return metrics.cells(rows, ["event_type"], metrics.value_of(rows, "k"))


@question("scan_cells", f"SELECT period, count(*) AS cells FROM {CELLS} GROUP BY 1")
def _(t):
    return cells(t).groupBy("period").agg(F.count("*").alias("cells"))


@question("metric_read", f"SELECT l_returnflag, sum(count)::BIGINT AS count, sum(value_count)::BIGINT AS value_count, sum(sum) AS sum, min(min) AS min, max(max) AS max, round(sum(sum) / sum(value_count), 6) AS avg FROM {CELLS} GROUP BY 1")
def _(t):
    return metrics.read(cells(t), ["l_returnflag"]).withColumn("avg", F.round("avg", 6))


@question("metric_table", f"SELECT period, l_returnflag, sum(count)::BIGINT AS n FROM {CELLS} GROUP BY 1, 2")
def _(t):
    return metrics.read(cells(t), ["period", "l_returnflag"]).select("period", "l_returnflag", c("count").alias("n"))


@question("metric_once", "SELECT l_suppkey, count(*) AS count FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) GROUP BY 1")
def _(t):
    return metrics.once(t.lineitem.withColumn("v", F.lit(1)), ["l_suppkey"], "l_orderkey", "v").select("l_suppkey", "count")


@question("metric_rules", "SELECT CASE WHEN l_quantity >= 40 THEN 'large' WHEN l_discount >= 0.08 THEN 'cheap' WHEN l_tax > 0.06 THEN 'taxed' ELSE 'other' END AS rule, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    label = metrics.rules([("large", c("l_quantity") >= 40), ("cheap", c("l_discount") >= 0.08), ("taxed", c("l_tax") > 0.06)])
    return t.lineitem.groupBy(label.alias("rule")).agg(F.count("*").alias("n"))


@question("metric_rule_stats", "SELECT count(*) FILTER (l_quantity >= 40) AS large_matched, count(*) FILTER (l_discount >= 0.08) AS cheap_matched, count(*) FILTER (l_discount >= 0.08 AND NOT l_quantity >= 40) AS cheap_assigned FROM lineitem")
def _(t):
    large, cheap = c("l_quantity") >= 40, c("l_discount") >= 0.08
    return t.lineitem.agg(F.count_if(large).alias("large_matched"), F.count_if(cheap).alias("cheap_matched"), F.count_if(cheap & ~large).alias("cheap_assigned"))


@question("metric_share", "SELECT l_linestatus, count(*) AS den, sum((l_returnflag = 'R')::INT)::BIGINT AS num, round(avg((l_returnflag = 'R')::INT), 6) AS share FROM lineitem GROUP BY 1")
def _(t):
    own = metrics.read(metrics.cells(t.lineitem, ["l_linestatus"], F.when(c("l_returnflag") == "R", 1).otherwise(0)), ["l_linestatus"])
    return own.select("l_linestatus", c("count").alias("den"), c("sum").alias("num"), F.round("avg", 6).alias("share"))


_BY_MONTH = "(SELECT date_trunc('month', l_shipdate)::DATE AS period, count(*) AS count, sum(l_quantity) AS sum FROM lineitem GROUP BY 1)"


@question("metric_stay", f"SELECT period, sum(count)::BIGINT AS count, sum(sum) AS sum FROM (SELECT (period + to_months(k::INT))::DATE AS period, count, sum FROM {_BY_MONTH}, range(3) r(k)) WHERE period <= DATE '2001-10-01' GROUP BY 1")
def _(t):
    by = metrics.cells(t.lineitem.withColumn("period", bucket(c("l_shipdate"), "month")), ["period"], c("l_quantity"))
    return metrics.stay(by, "month", 3, F.lit("2001-10-01").cast("date")).select("period", "count", "sum")


@question("metric_through", "SELECT max(date_trunc('month', l_shipdate)::DATE) AS through FROM lineitem WHERE l_shipdate IS NOT NULL")
def _(t):
    return t.lineitem.agg(bucket(F.max("l_shipdate"), "month").alias("through"))


@question("metric_composition", "SELECT l_returnflag, l_linestatus, n, round(100.0 * n / sum(n) OVER (PARTITION BY l_returnflag), 6)::DOUBLE AS share FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def _(t):
    return summary.shares(t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")), ["l_returnflag"])


@question("metric_dim_values", f"SELECT l_linestatus AS value, sum(count)::BIGINT AS n FROM {CELLS} GROUP BY 1")
def _(t):
    return cells(t).groupBy(c("l_linestatus").alias("value")).agg(F.sum("count").alias("n"))


@question("metric_ratio", "SELECT coalesce(a.period, b.period) AS period, a.n AS num, b.n AS den, CASE WHEN b.n > 0 THEN round(coalesce(a.n, 0) * 1000 / b.n, 6) END AS ratio FROM (SELECT date_trunc('month', l_shipdate)::DATE AS period, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL JOIN (SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*) AS n FROM orders GROUP BY 1) b ON a.period = b.period")
def _(t):
    num = t.lineitem.where("l_returnflag = 'R'").groupBy(bucket(c("l_shipdate"), "month").alias("period")).agg(F.count("*").alias("count"))
    den = t.orders.groupBy(bucket(c("o_orderdate"), "month").alias("period")).agg(F.count("*").alias("count"))
    return metrics.ratio(num, den, ["period"], 1000.0).withColumn("ratio", F.round("ratio", 6))


@question("join_denominator", "SELECT l_returnflag, n, total, round(n / total, 6) AS ratio FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), (SELECT count(*) AS total FROM orders)")
def _(t):
    total = t.orders.agg(F.count("*").alias("total"))
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).withColumn("ratio", F.round(c("n") / c("total"), 6))


_VISITS = """(SELECT event_id, user_id, CASE WHEN n >= 4 THEN '4+' ELSE n::VARCHAR END AS visit, CASE WHEN later - day <= 1 THEN 'yes' WHEN day + 1 > DATE '2024-01-29' THEN 'open' ELSE 'no' END AS again
 FROM (SELECT event_id, user_id, ts::DATE AS day, row_number() OVER w AS n, lead(ts::DATE) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


def visits(t):
    return metrics.visits(t.events, "user_id", "ts", "event_id", 1, F.lit("2024-01-29").cast("date"))


@question("win_visit_number", f"SELECT event_id, visit FROM {_VISITS}")
def _(t):
    return visits(t).select("event_id", "visit")


@question("win_repeat_within", f"SELECT again, count(*) AS n FROM {_VISITS} GROUP BY 1")
def _(t):
    return visits(t).groupBy("again").agg(F.count("*").alias("n"))


@question("win_prev_yoy", f"WITH cal AS (SELECT unnest(range(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS period), s AS (SELECT cal.period, coalesce(count, 0) AS count, sum FROM cal LEFT JOIN {_BY_MONTH} b ON cal.period = b.period) SELECT s.period, s.count, s.sum, lag(s.count) OVER (ORDER BY s.period) AS prev, y.count AS yoy FROM s LEFT JOIN s y ON s.period = (y.period + INTERVAL 12 MONTH)::DATE")
def _(t):
    by = metrics.cells(t.lineitem.withColumn("period", bucket(c("l_shipdate"), "month")), ["period"], c("l_quantity"))
    return metrics.series(by, metrics.dense(t.spark, "1995-01-01", "2001-11-01")).select("period", "count", "sum", "prev", "yoy")


@question("win_cohort_cumulative", f"SELECT cohort, age, sum(n) OVER w::BIGINT AS running_count, sum(q) OVER w AS running_sum FROM (SELECT cohort, age, sum(count) AS n, sum(sum) AS q FROM {CELLS} WHERE age >= 0 GROUP BY 1, 2) WINDOW w AS (PARTITION BY cohort ORDER BY age ROWS UNBOUNDED PRECEDING)")
def _(t):
    return metrics.cumulative(cells(t))


@question("metric_incremental_plan", f"SELECT 'small' AS case, period, 'periods' AS mode, NULL AS reason FROM (SELECT DISTINCT period FROM {RECORDS} x WHERE o_orderkey % 50 = 7) UNION ALL SELECT 'large', NULL, 'full', 'too many changes' UNION ALL SELECT 'other', NULL, 'full', 'another definition'")
def _(t):
    """What a refresh counts again: the periods that changed orders touch, or all of it with the reason."""
    some, most = t.orders.where("o_orderkey % 50 = 7").select("o_orderkey"), t.orders.where("o_orderkey % 2 = 0").select("o_orderkey")
    cases = [("small", some, {}), ("large", most, {"no earlier run": False}), ("other", some, {"no earlier run": False, "another definition": True})]
    out = None
    for name, changed, reasons in cases:
        one = metrics.refresh_plan(t.records, changed, "o_orderkey", "period", reasons).select(F.lit(name).alias("case"), "period", "mode", "reason")
        out = one if out is None else out.union(one)
    return out


@question("metric_incremental", f"SELECT * FROM {CELLS} WHERE period <> (SELECT min(period) FROM {RECORDS} y)")
def _(t):
    """Cells are written without some orders; then those come, and all records of the first period go. Only the touched periods are
    written again, and what stands there equals the cells of all records that are left."""
    path = files.scratch(t.spark) + "/cells"
    # records are read once, with the columns that are asked for
    records = t.records.select("o_orderkey", *KEYS, "l_quantity").persist()
    first = records.agg(F.min("period").alias("period"))
    late = t.orders.where("o_orderkey % 13 = 0").select("o_orderkey")
    metrics.write_cells(metrics.cells(records.join(late, "o_orderkey", "left_anti"), KEYS, c("l_quantity")), path)
    now = records.join(F.broadcast(first.withColumnRenamed("period", "_f")), c("period") == c("_f"), "left_anti")
    touched = metrics.changed_periods(records, late, "o_orderkey", "period").union(first).distinct()
    metrics.rewrite_periods(path, now, touched, KEYS, c("l_quantity"))
    records.unpersist()
    kinds = {f.name: f.dataType.simpleString() for f in metrics.cells(t.records, KEYS, c("l_quantity")).schema.fields}
    return t.spark.read.schema(", ".join(f"`{k}` {v}" for k, v in kinds.items())).parquet(path)


@question("stream_settle", "SELECT DISTINCT date_trunc('month', l_shipdate)::DATE AS period, date_trunc('month', l_shipdate)::DATE + INTERVAL 1 MONTH <= DATE '2001-11-04' - 10 AS closed FROM lineitem")
def _(t):
    from ravelin.functions.scalars import is_closed

    period = bucket(c("l_shipdate"), "month")
    return t.lineitem.select(period.alias("period")).distinct().withColumn("closed", is_closed(c("period"), "month", F.lit("2001-11-04").cast("date"), 10))


@question("metric_hash", f"SELECT md5(concat_ws('|', strftime(period, '%Y-%m-%d'), l_returnflag)) AS cell, sum(count)::BIGINT AS n FROM {CELLS} GROUP BY 1")
def _(t):
    key = F.md5(F.concat_ws("|", F.date_format("period", "yyyy-MM-dd"), "l_returnflag"))
    return cells(t).groupBy(key.alias("cell")).agg(F.sum("count").alias("n"))


_SAMPLE = "(SELECT {0}::INT AS eighths, sum(n)::BIGINT AS rows, count(*) AS combos, count(*) FILTER (n = 1) AS once, count(*) FILTER (n = 2) AS twice FROM (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem WHERE strpos('0123456789abcdef', md5(l_orderkey::VARCHAR)[1:1]) - 1 < 2 * {0} GROUP BY 1, 2))".format
_ESTIMATED = f"(SELECT *, sqrt(unseen * scaled) AS blended, abs(ln(unseen / scaled)) / 2 AS error FROM (SELECT *, least(combos + once * once / (2.0 * greatest(twice, 1)), total) AS unseen, least(sqrt(total / rows) * once + (combos - once), total) AS scaled FROM ({' UNION ALL '.join(_SAMPLE(k) for k in (1, 2, 4))}), (SELECT count(*)::DOUBLE AS total FROM lineitem)))"
_ROUNDED = "eighths, rows, combos, once, twice, round(unseen, 3) AS unseen, round(scaled, 3) AS scaled, round(blended, 3) AS blended, round(error, 6) AS error"


def _laid(t):
    return metrics.laid_out(t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey"), "l_orderkey", files.scratch(t.spark) + "/laid")


def _rounded(rows):
    return rows.withColumns({**{n: F.round(n, 3) for n in ("unseen", "scaled", "blended")}, "error": F.round("error", 6)})


@question("metric_estimate", f"SELECT {_ROUNDED} FROM {_ESTIMATED} ORDER BY error > 0.1, CASE WHEN error <= 0.1 THEN eighths ELSE -eighths END LIMIT 1")
def _(t):
    """How many cells a metric of two axes will have, from the smallest sample that says it."""
    return _rounded(metrics.estimate(_laid(t), ["l_suppkey", "l_partkey"], t.lineitem.count()))


@question("metric_estimate_combos", f"SELECT {_ROUNDED} FROM {_ESTIMATED}")
def _(t):
    laid, total = _laid(t), t.lineitem.count()
    one, *more = [metrics.sampled_combos(laid, ["l_suppkey", "l_partkey"], k) for k in (1, 2, 4)]
    for x in more:
        one = one.union(x)
    return _rounded(metrics.estimated(one, total))
