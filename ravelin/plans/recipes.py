"""Statistics over metric cells."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin import extensions
from ravelin.functions.scalars import age, bucket, is_closed
from ravelin.operators import lives, metrics, numeric, statistics
from ravelin.operators.ordered import with_totals
from ravelin.plans.registry import RECORDS, question
from ravelin.sources.files import stored

c = F.col
_BY = "(SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS total FROM lineitem GROUP BY 1)"
_MONTHS = "(SELECT date_trunc('month', l_shipdate)::DATE AS m, count(*) FILTER (l_returnflag = 'R') AS hits, count(*) AS total FROM lineitem GROUP BY 1)"


def by_supplier(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_if(c("l_returnflag") == "R").alias("hits"), F.count("*").alias("total"))


def by_month(t):
    return t.lineitem.groupBy(bucket(c("l_shipdate"), "month").alias("m")).agg(F.count_if(c("l_returnflag") == "R").alias("hits"), F.count("*").alias("total"))


_FRAME = f"(SELECT coalesce(h.period, d.period) AS period, h.hits, d.exposure, (coalesce(h.period, d.period) + INTERVAL 1 MONTH)::DATE <= DATE '2001-08-01' - 20 AS closed FROM (SELECT date_trunc('month', l_shipdate)::DATE AS period, count(*) AS hits FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) h FULL JOIN (SELECT date_trunc('month', o_orderdate)::DATE AS period, count(*) AS exposure FROM orders GROUP BY 1) d ON h.period = d.period)"


def frame(t):
    """Numerator by period with its denominator and whether the period is closed."""
    month = lambda df, at: df.groupBy(bucket(c(at), "month").alias("period")).agg(F.count("*").alias("count"))
    both = metrics.ratio(month(t.lineitem.where("l_returnflag = 'R'"), "l_shipdate"), month(t.orders, "o_orderdate"), ["period"])
    return both.select("period", c("num").alias("hits"), c("den").alias("exposure"), is_closed(c("period"), "month", F.lit("2001-08-01").cast("date"), 20).alias("closed"))


question("stat_frame", f"SELECT * FROM {_FRAME}")(frame)


@question("stat_series", f"SELECT l_returnflag AS split, period, sum(n) OVER w::BIGINT AS hits, count(*) OVER w AS periods FROM (SELECT v.l_returnflag, cal.period, coalesce(n, 0) AS n FROM (SELECT unnest(range(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH))::DATE AS period) cal CROSS JOIN (SELECT DISTINCT l_returnflag FROM lineitem) v LEFT JOIN (SELECT l_returnflag, date_trunc('month', l_shipdate)::DATE AS period, count(*) AS n FROM lineitem GROUP BY 1, 2) x ON x.l_returnflag = v.l_returnflag AND x.period = cal.period) WINDOW w AS (PARTITION BY l_returnflag ORDER BY period ROWS 2 PRECEDING)")
def _(t):
    # counts of each value on a dense calendar, over windows of three periods
    by = t.lineitem.groupBy(c("l_returnflag").alias("split"), bucket(c("l_shipdate"), "month").alias("period")).agg(F.count("*").alias("n"))
    grid = by.select("split").distinct().crossJoin(F.broadcast(metrics.dense(t.spark, "1995-01-01", "2001-11-01")))
    over = Window.partitionBy("split").orderBy("period").rowsBetween(-2, 0)
    return grid.join(by, ["split", "period"], "left").select("split", "period", F.sum(F.coalesce("n", F.lit(0))).over(over).alias("hits"), F.count("*").over(over).alias("periods"))


@question("stat_totals", f"SELECT sum(hits)::BIGINT AS hits, sum(total)::BIGINT AS total, round(sum(hits) / sum(total), 6) AS rate FROM {_BY}")
def _(t):
    return by_supplier(t).agg(F.sum("hits").alias("hits"), F.sum("total").alias("total"), F.round(F.sum("hits") / F.sum("total"), 6).alias("rate"))


@question("stat_concentration", f"WITH s AS (SELECT l_suppkey, hits / sum(hits) OVER () AS s, row_number() OVER (ORDER BY hits, l_suppkey) AS i, count(*) OVER () AS n FROM {_BY}) SELECT round(sum(s * s), 6) AS hhi, round(sum((2 * i - n - 1) * s) / max(n), 6) AS gini, round(sum(s) FILTER (i > n - 1), 6) AS cr1, round(sum(s) FILTER (i > n - 3), 6) AS cr3, round(sum(s) FILTER (i > n - 5), 6) AS cr5, round(sum(s) FILTER (i > n - 10), 6) AS cr10, round(1 / sum(s * s), 6) AS effective FROM s")
def _(t):
    return statistics.concentration(by_supplier(t), "l_suppkey", "hits")


@question("stat_homogeneity", f"WITH x AS (SELECT *, sum(hits) OVER () / sum(total) OVER () AS p, sum(total) OVER () AS n FROM {_BY}), e AS (SELECT *, total * p AS expected, hits - total * p AS d FROM x) SELECT l_suppkey, round(expected, 6) AS expected, round(d / sqrt(expected * (1 - p) * (1 - total / n)), 6) AS residual, round(sum(d * d / (expected * (1 - p))) OVER (), 6) AS chi2 FROM e")
def _(t):
    return statistics.homogeneity(by_supplier(t), "l_suppkey", "hits", "total")


def _chart_sql(center: str, size: str, spread: str, high: str, base: str) -> str:
    """SQL of a control chart: centre and moving ranges from the points of ``base``."""
    return f"""(WITH m AS (SELECT m, hits, total, {size} AS n, {base} AS b FROM {_MONTHS}), a AS (SELECT m, hits / n AS rate, n, b, (SELECT {center} FROM m WHERE b) AS center FROM m),
 r AS (SELECT *, sqrt({spread} / n) AS sigma, (rate - center) / sqrt({spread} / n) AS raw FROM a),
 g AS (SELECT greatest(coalesce(avg(moved) / 1.128, 1.0), 1.0) AS sz FROM (SELECT abs(raw - lag(raw) OVER (ORDER BY m)) AS moved FROM r WHERE b)),
 f AS (SELECT r.*, sz, raw / sz AS z, greatest(center - 3 * sigma * sz, 0) AS low, {high} AS high FROM r, g)
 SELECT m, round(rate, 6) AS rate, round(center, 6) AS center, round(sz, 6) AS sigma_z, round(z, 6) AS z, round(low, 6) AS low, round(high, 6) AS high, rate < low OR rate > high AS out FROM f)"""


_U = _chart_sql("sum(hits) / sum(n)", "total", "center", "center + 3 * sigma * sz", "true")
_EARLY = "m < DATE '1999-01-01'"
question("stat_control", f"SELECT * FROM {_U}")(lambda t: statistics.chart(by_month(t), "m", "hits", "total"))
question("stat_control_base", f"SELECT * FROM {_chart_sql('sum(hits) / sum(n)', 'total', 'center', 'center + 3 * sigma * sz', _EARLY)}")(lambda t: statistics.chart(by_month(t), "m", "hits", "total", baseline=c("m") < F.lit("1999-01-01").cast("date")))
question("stat_control_c", f"SELECT * FROM {_chart_sql('sum(hits) / sum(n)', '1.0', 'center', 'center + 3 * sigma * sz', 'true')}")(lambda t: statistics.chart(by_month(t), "m", "hits", "total", "c"))
question("stat_control_p", f"SELECT * FROM {_chart_sql('sum(hits) / sum(n)', 'total', 'center * (1 - center)', 'least(center + 3 * sigma * sz, 1.0)', 'true')}")(lambda t: statistics.chart(by_month(t), "m", "hits", "total", "p"))


_FRAMES = "WINDOW nine AS (ORDER BY m ROWS 8 PRECEDING), six AS (ORDER BY m ROWS 5 PRECEDING), five AS (ORDER BY m ROWS 4 PRECEDING), three AS (ORDER BY m ROWS 2 PRECEDING)"


def _nelson_sql(points: str) -> str:
    found = f"SELECT m, abs(z) > 3 AS beyond, count(z) OVER nine = 9 AND (min(z) OVER nine > 0 OR max(z) OVER nine < 0) AS same_side, count(z) OVER six = 6 AND (sum(up) OVER five = 5 OR sum(down) OVER five = 5) AS trend, count(z) OVER three = 3 AND ((sum((z > 2)::INT) OVER three >= 2 AND z > 2) OR (sum((z < -2)::INT) OVER three >= 2 AND z < -2)) AS two_of_three FROM (SELECT m, z, (rate > lag(rate) OVER (ORDER BY m))::INT AS up, (rate < lag(rate) OVER (ORDER BY m))::INT AS down FROM {points} WHERE z IS NOT NULL AND rate IS NOT NULL) {_FRAMES}"
    flags = ", ".join(f"coalesce({n}, false) AS {n}" for n in ("beyond", "same_side", "trend", "two_of_three"))
    return f"SELECT m, z, {flags} FROM {points} LEFT JOIN ({found}) USING (m)"


@question("win_nelson", _nelson_sql(_U))
def _(t):
    return statistics.runs(statistics.chart(by_month(t), "m", "hits", "total"), "m", "z", "rate")


_OPEN = "(month(m) = 5 OR m >= DATE '2001-01-01')"
_U_OPEN = _chart_sql("sum(hits) / sum(n)", "total", "center", "center + 3 * sigma * sz", f"NOT {_OPEN}")
_WITH_OPEN = f"(SELECT m, rate, center, sigma_z, CASE WHEN NOT {_OPEN} THEN z END AS z, CASE WHEN NOT {_OPEN} THEN low END AS low, CASE WHEN NOT {_OPEN} THEN high END AS high, NOT {_OPEN} AND out AS out FROM {_U_OPEN})"


def _with_open(t):
    return statistics.chart(by_month(t), "m", "hits", "total", open_=F.expr("month(m) = 5 or m >= date'2001-01-01'"))


# every May and the last year are open: they are shown, and take part in nothing
question("stat_control_open", f"SELECT * FROM {_WITH_OPEN}")(_with_open)
question("win_nelson_open", _nelson_sql(_WITH_OPEN))(lambda t: statistics.runs(_with_open(t), "m", "z", "rate"))


@question("stat_collapse", f"SELECT age, count(*) AS units, count(*) FILTER (l_returnflag = 'R') AS hits FROM {RECORDS} x WHERE age >= 0 GROUP BY 1")
def _(t):
    return t.records.where("age >= 0").groupBy("age").agg(F.count("*").alias("units"), F.count_if(c("l_returnflag") == "R").alias("hits"))


@question("stat_reference_rates", f"WITH a AS (SELECT age, count(*) FILTER (l_returnflag = 'R') / count(*) AS rate FROM {RECORDS} x WHERE age >= 0 GROUP BY 1), s AS (SELECT l_suppkey, age, count(*) AS units, count(*) FILTER (l_returnflag = 'R') AS hits FROM {RECORDS} x WHERE age >= 0 GROUP BY 1, 2) SELECT l_suppkey, sum(hits)::BIGINT AS hits, round(sum(units * rate), 6) AS expected, round(sum(hits) / sum(units * rate), 6) AS ratio FROM s JOIN a USING (age) GROUP BY 1")
def _(t):
    own = t.records.where("age >= 0").groupBy("l_suppkey", "age").agg(F.count("*").alias("units"), F.count_if(c("l_returnflag") == "R").alias("hits"))
    rates = own.groupBy("age").agg((F.sum("hits") / F.sum("units")).alias("rate"))
    return own.join(rates, "age").groupBy("l_suppkey").agg(F.sum("hits").alias("hits"), F.round(F.sum(c("units") * c("rate")), 6).alias("expected"), F.round(F.sum("hits") / F.sum(c("units") * c("rate")), 6).alias("ratio"))


_UNITS = f"(SELECT cohort, count(*) AS units, (year(e) - year(cohort)) * 12 + month(e) - month(cohort) AS horizon FROM {RECORDS} x, (SELECT max(date_trunc('month', l_shipdate)) AS e FROM lineitem) GROUP BY cohort, e)"
_LIFE = f"(SELECT age, sum(d)::BIGINT AS failed, sum(u)::BIGINT AS ended FROM (SELECT age, count(*) AS d, 0 AS u FROM {RECORDS} x WHERE l_returnflag = 'R' AND age >= 0 GROUP BY 1 UNION ALL SELECT horizon + 1, 0, units - coalesce(f, 0) FROM {_UNITS} n LEFT JOIN (SELECT cohort, count(*) AS f FROM {RECORDS} y WHERE l_returnflag = 'R' AND age >= 0 GROUP BY 1) z USING (cohort)) GROUP BY 1)"


def life_table(t):
    """(age, failed, at_risk): units leave the risk when they fail and, without a failure, behind the last age that their cohort was seen at."""
    rows = t.records
    end = t.lineitem.agg(F.max(bucket(c("l_shipdate"), "month")).alias("end"))
    hits = F.count_if((c("l_returnflag") == "R") & (c("age") >= 0))
    cohorts = rows.groupBy("cohort").agg(F.count("*").alias("units"), hits.alias("hits")).crossJoin(F.broadcast(end))
    ended = cohorts.select((age(c("cohort"), c("end"), "month") + 1).alias("age"), F.lit(0).cast("long").alias("failed"), (c("units") - c("hits")).alias("ended"))
    failed = rows.where("l_returnflag = 'R' and age >= 0").groupBy("age").agg(F.count("*").alias("failed")).withColumn("ended", F.lit(0).cast("long"))
    # one row for each age; the calendar bounds them
    by = failed.unionByName(ended).groupBy("age").agg(F.sum("failed").alias("failed"), F.sum("ended").alias("ended"))
    gone = F.coalesce(F.sum(c("failed") + c("ended")).over(Window.orderBy("age").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_ = F.sum(c("failed") + c("ended")).over(Window.partitionBy())
    return by.select("age", "failed", (all_ - gone - c("ended")).alias("at_risk"))


@question("stat_actuarial", f"WITH r AS (SELECT age, failed, (sum(failed + ended) OVER () - coalesce(sum(failed + ended) OVER (ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - ended)::BIGINT AS at_risk FROM {_LIFE}), s AS (SELECT *, sum(ln(1 - failed / at_risk)) OVER (ORDER BY age ROWS UNBOUNDED PRECEDING) AS l, sum(failed / (at_risk * (at_risk - failed)::DOUBLE)) OVER (ORDER BY age ROWS UNBOUNDED PRECEDING) AS g FROM r WHERE at_risk > failed) SELECT age, failed, at_risk, round(1 - exp(l), 6) AS share, round(CASE WHEN l < 0 THEN 1 - exp(l * exp(-1.959963984540054 * sqrt(g) / -l)) ELSE 0.0 END, 6) AS low, round(CASE WHEN l < 0 THEN 1 - exp(l * exp(1.959963984540054 * sqrt(g) / -l)) ELSE 0.0 END, 6) AS high FROM s")
def _(t):
    return lives.survived(life_table(t)).withColumns({n: F.round(n, 6) for n in ("share", "low", "high")})


#: Odd parts are the new line, even ones its predecessor.
_NEW, _OLD = "l_partkey % 2 = 1", "l_partkey % 2 = 0"


def _exposed(which: str, keys: str = "") -> str:
    """SQL of the exposure matrix of a line: units and hits of each cohort at each age it was seen at."""
    k = keys + ", " if keys else ""
    units = f"(SELECT {k}cohort, count(*) AS units, (year(e) - year(cohort)) * 12 + month(e) - month(cohort) AS horizon FROM {RECORDS} x, (SELECT max(date_trunc('month', l_shipdate)) AS e FROM lineitem) WHERE {which} GROUP BY {k}cohort, e)"
    return f"(SELECT {k}cohort, age, units, coalesce(hits, 0) AS hits FROM (SELECT *, unnest(range(0, horizon + 1))::INT AS age FROM {units}) LEFT JOIN (SELECT {k}cohort, age, count(*) AS hits FROM {RECORDS} x WHERE {which} AND l_returnflag = 'R' AND age >= 0 GROUP BY ALL) USING ({k}cohort, age))"


def _standard(keys: str = "", shared: str = "") -> str:
    """SQL, as the begin of a WITH: matrices t (new) and o (old), rates r of the old line, and phi of its cohorts; ``shared`` keys are those of
    the rates, too."""
    k = shared + ", " if shared else ""
    phi = f"SELECT {k}CASE WHEN count(*) >= 5 THEN greatest(1.0, sum((o - e) ** 2 / e) / nullif(count(*) - 1, 0)) ELSE 1.0 END AS phi FROM (SELECT {k}cohort, sum(hits) AS o, sum(units * rate) AS e FROM o JOIN r USING ({k}age) GROUP BY {k}cohort) WHERE e > 0" + (f" GROUP BY {shared}" if shared else "")
    return f"WITH t AS MATERIALIZED {_exposed(_NEW, keys)}, o AS MATERIALIZED {_exposed(_OLD, shared)}, r AS MATERIALIZED (SELECT {k}age, sum(hits) / sum(units) AS rate, sum(hits) AS records, sum(units) AS at_age FROM o GROUP BY {k}age), f AS ({phi})"


def standard(t, keys=(), shared=()):
    """(cohorts of the new line, rates of the old one, phi of its cohorts). Cohorts are written once; if both lines have the same keys, together."""
    end, hit = t.lineitem.agg(F.max(bucket(c("l_shipdate"), "month"))), c("l_returnflag") == "R"
    lines = t.records.withColumn("new", F.when(F.expr(_NEW), True).when(F.expr(_OLD), False)).where("new is not null")
    written = lambda rows, by: stored(lives.exposures(rows, end, hit, ["new", *by]))
    new = written(lines if list(keys) == list(shared) else lines.where("new"), keys)
    old = new if list(keys) == list(shared) else written(lines.where("not new"), shared)
    new, old = new.where("new").drop("new"), old.where("not new").drop("new")
    by_age = lives.rates(old, list(shared))
    return new, by_age, lives.dispersion(old, by_age, list(shared))


_WIDE = "1.959963984540054 * sqrt(phi * (1.0 / nullif(o, 0) + v / (e * e)))"


@question("stat_ratio", f"{_standard('l_suppkey')}, a AS (SELECT l_suppkey, age, sum(hits) AS o, sum(units) AS w, any_value(rate) AS rate, any_value(records) AS records, any_value(at_age) AS at_age FROM t JOIN r USING (age) GROUP BY 1, 2), s AS (SELECT l_suppkey, sum(o) AS o, sum(w * rate) AS e, sum((w / at_age) ** 2 * records) AS v FROM a GROUP BY 1) SELECT l_suppkey, o::BIGINT AS o, round(e, 6) AS e, round(o / e, 6) AS ratio, round(CASE WHEN o > 0 THEN o / e * exp(-{_WIDE}) ELSE 0.0 END, 6) AS low, round(CASE WHEN o > 0 THEN o / e * exp({_WIDE}) ELSE -ln(0.025) / e * exp(1.959963984540054 * sqrt(phi * v / (e * e))) * sqrt(phi) END, 6) AS high FROM s, f WHERE e > 0")
def _(t):
    """Returns of each supplier's new parts over what the old line's rates by age expect, with an interval by the delta method."""
    new, by_age, phi = standard(t, ["l_suppkey"])
    return lives.compared(new, by_age, phi, ["l_suppkey"]).where("e > 0").select("l_suppkey", "o", *[F.round(n, 6).alias(n) for n in ("e", "ratio", "low", "high")])


@question("stat_ratio_all", f"{_standard()}, a AS (SELECT age, sum(hits) AS o, sum(units) AS w, any_value(rate) AS rate, any_value(records) AS records, any_value(at_age) AS at_age FROM t JOIN r USING (age) GROUP BY 1), s AS (SELECT sum(o) AS o, sum(w * rate) AS e, sum((w / at_age) ** 2 * records) AS v FROM a) SELECT o::BIGINT AS o, round(e, 4) AS e, round(phi, 6) AS phi, round(o / e * exp(-{_WIDE}), 6) AS low, round(o / e * exp({_WIDE}), 6) AS high FROM s, f")
def _(t):
    new, by_age, phi = standard(t)
    return lives.compared(new, by_age, phi, []).crossJoin(F.broadcast(phi)).select("o", F.round("e", 4).alias("e"), *[F.round(n, 6).alias(n) for n in ("phi", "low", "high")])


_POOLED = f"SELECT *, hits / total AS rate, sum(hits) OVER () / sum(total) OVER () AS pooled, sum(total) OVER () AS n, sum(total * total) OVER () AS n2, count(*) OVER () AS k FROM {_BY}"
_TAU = f"(SELECT *, greatest(0.0, (sum(total * (rate - pooled) ** 2) OVER () - (k - 1) * pooled) / (n - n2 / n)) AS tau2, sum((hits - total * pooled) ** 2 / (total * pooled)) OVER () AS chi2 FROM ({_POOLED}))"


def compared(t):
    """Suppliers with the pooled rate, the spread between them and the exact two-sided p of each."""
    own = with_totals(by_supplier(t), all_hits=F.sum("hits"), n=F.sum("total"), n2=F.sum(c("total") * c("total")), k=F.count("*"))
    own = own.withColumns({"pooled": F.try_divide("all_hits", "n"), "rate": F.try_divide("hits", "total")})
    own = with_totals(own, spread=F.sum(c("total") * F.pow(c("rate") - c("pooled"), F.lit(2))), chi2=F.sum(F.try_divide(F.pow(c("hits") - c("total") * c("pooled"), F.lit(2)), c("total") * c("pooled"))))
    return own.withColumn("tau2", F.greatest(F.lit(0.0), F.try_divide(c("spread") - (c("k") - 1) * c("pooled"), c("n") - F.try_divide("n2", "n"))))


@question("stat_groups", f"SELECT l_suppkey, round(rate, 6) AS rate, round(pooled, 6) AS pooled, round(chi2, 4) AS chi2, round(tau2, 10) AS tau2, round(CASE WHEN tau2 > 0 THEN (hits + pooled * pooled / tau2) / (total + pooled / tau2) ELSE pooled END, 6) AS shrunk, round(CASE WHEN tau2 > 0 THEN pooled / tau2 / (total + pooled / tau2) ELSE 1.0 END, 6) AS shrinkage FROM {_TAU}")
def _(t):
    b = c("pooled") / c("tau2")
    own = compared(t).withColumns({"shrunk": F.when(c("tau2") > 0, (c("hits") + c("pooled") * b) / (c("total") + b)).otherwise(c("pooled")), "shrinkage": F.when(c("tau2") > 0, b / (c("total") + b)).otherwise(1.0)})
    return own.select("l_suppkey", *[F.round(x, n).alias(x) for x, n in (("rate", 6), ("pooled", 6), ("chi2", 4), ("tau2", 10), ("shrunk", 6), ("shrinkage", 6))])


@question("stat_groups_exact")
def _(t):
    """Exact two-sided binomial p of each supplier, its q, and the interval of its shrunk rate (a gamma posterior)."""
    own = compared(t).withColumn("p", numeric.column(lambda k, n, share: numeric.binomial_p(int(k), int(n), share), c("hits"), c("all_hits"), c("total") / c("n")))
    own = own.withColumns({"shape": c("hits") + c("pooled") * c("pooled") / F.nullif("tau2", F.lit(0.0)), "scale": c("total") + c("pooled") / F.nullif("tau2", F.lit(0.0))})
    bounds = {name: F.round(numeric.column(lambda a, b, q=q: numeric.gamma_quantile(q, a, b), c("shape"), c("scale")), 6) for name, q in (("low", 0.025), ("high", 0.975))}
    q = statistics.adjusted(own.select("l_suppkey", "p"), "l_suppkey", "p").select("l_suppkey", F.round("q", 6).alias("q"))
    return own.withColumns(bounds).join(q, "l_suppkey").select("l_suppkey", F.round("p", 6).alias("p"), "q", "low", "high")


_SIDES = f"(SELECT m, hits, total, m >= DATE '1998-06-01' AS after FROM {_MONTHS})"


def _sides(t):
    return by_month(t).withColumn("after", c("m") >= F.lit("1998-06-01").cast("date"))


def _cut(t):
    """One row: counts before and after a day, their ratio, and the over-dispersion of the periods around the rates of their sides."""
    own = _sides(t)
    rate = own.groupBy("after").agg(F.try_divide(F.sum("hits"), F.sum("total")).alias("rate"))
    spread = F.sum(F.try_divide(F.pow(c("hits") - c("total") * c("rate"), F.lit(2)), c("total") * c("rate")))
    one = lambda column, after: F.sum(F.when(c("after") == after, c(column)).otherwise(0))
    got = own.join(F.broadcast(rate), "after").agg(one("hits", False).alias("c0"), one("total", False).alias("n0"), one("hits", True).alias("c1"), one("total", True).alias("n1"), spread.alias("chi2"), (F.count("*") - 2).alias("df"))
    phi = F.when(c("df") < 3, 1.0).otherwise(F.greatest(F.lit(1.0), c("chi2") / c("df")))
    return got.withColumns({"phi": phi, "ratio": F.try_divide(F.try_divide("c1", "n1"), F.try_divide("c0", "n0"))})


@question("stat_cutin", f"WITH r AS (SELECT after, sum(hits) / sum(total) AS rate FROM {_SIDES} GROUP BY 1), x AS (SELECT sum((hits - total * rate) ** 2 / (total * rate)) AS chi2, count(*) - 2 AS df, sum(CASE WHEN after THEN 0 ELSE hits END)::BIGINT AS c0, sum(CASE WHEN after THEN 0 ELSE total END)::BIGINT AS n0, sum(CASE WHEN after THEN hits ELSE 0 END)::BIGINT AS c1, sum(CASE WHEN after THEN total ELSE 0 END)::BIGINT AS n1 FROM {_SIDES} JOIN r USING (after)) SELECT c0, n0, c1, n1, round(CASE WHEN df < 3 THEN 1.0 ELSE greatest(1.0, chi2 / df) END, 6) AS phi, round((c1 / n1) / (c0 / n0), 6) AS ratio FROM x")
def _(t):
    return _cut(t).select("c0", "n0", "c1", "n1", F.round("phi", 6).alias("phi"), F.round("ratio", 6).alias("ratio"))


@question("stat_cutin_decision")
def _(t):
    """Interval of the ratio after to before (of the share of effective counts, which over-dispersion makes fewer), p and what follows."""
    k0, k1 = c("c0") / c("phi"), c("c1") / c("phi")
    share = lambda q, a, b: numeric.column(lambda x, y, q=q: numeric.beta_quantile(q, x, y) if x > 0 and y > 0 else float(x > 0), a, b)
    own = _cut(t).withColumns({"pl": share(0.025, k1, k0 + 1), "ph": share(0.975, k1 + 1, k0)})
    own = own.withColumns({x: F.when(c(y) < 1, c(y) / (1 - c(y)) * c("n0") / c("n1")) for x, y in (("low", "pl"), ("high", "ph"))})
    own = own.withColumn("p", numeric.column(lambda a, b, s: numeric.binomial_p(round(a), round(a + b), s), k1, k0, c("n1") / (c("n0") + c("n1"))))
    decision = F.when(c("high") < 1, "reduced").when(c("low") > 1, "increased").when((c("low") > 0.8) & (c("high") < 1 / 0.8), "no_difference").otherwise("too_early")
    return own.select(*[F.round(x, 6).alias(x) for x in ("ratio", "low", "high", "p")], decision.alias("decision"))


@question("stat_trend", f"WITH x AS (SELECT *, row_number() OVER (ORDER BY m) AS i, sum(hits) OVER () / sum(total) OVER () AS p FROM {_MONTHS}), y AS (SELECT *, sum(total * i) OVER () / sum(total) OVER () AS ibar FROM x) SELECT round(sum(hits * (i - ibar)) / sqrt(any_value(p) * (1 - any_value(p)) * sum(total * (i - ibar) * (i - ibar))), 4) AS z FROM y")
def _(t):
    whole = Window.partitionBy()
    own = by_month(t).withColumn("i", F.row_number().over(Window.orderBy("m"))).withColumn("p", F.sum("hits").over(whole) / F.sum("total").over(whole))
    own = own.withColumn("d", c("i") - F.sum(c("total") * c("i")).over(whole) / F.sum("total").over(whole))
    return own.agg(F.round(F.sum(c("hits") * c("d")) / F.sqrt(F.first("p") * (1 - F.first("p")) * F.sum(c("total") * c("d") * c("d"))), 4).alias("z"))


@question("stat_auc", "WITH g AS (SELECT l_quantity AS s, count(*) FILTER (l_returnflag = 'R') AS pos, count(*) FILTER (l_returnflag <> 'R') AS neg FROM lineitem GROUP BY 1), r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM r")
def _(t):
    g = t.lineitem.groupBy(c("l_quantity").alias("s")).agg(F.count_if(c("l_returnflag") == "R").alias("pos"), F.count_if(c("l_returnflag") != "R").alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("below", below).agg(F.round(F.sum(c("pos") * (c("below") + c("neg") / 2)) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


_CROSS = "(SELECT p_brand AS a, p_type AS b, count(*) AS n FROM part GROUP BY 1, 2)"


_LNC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - ({1}) + 1))".format
_TAIL = f"(SELECT sum(exp({_LNC('rs', 'i')} + {_LNC('total - rs', 'cs - i')} - {_LNC('total', 'cs')})) FROM range(n, least(rs, cs) + 1) r(i) WHERE total - rs >= cs - i)"


@question("stat_assoc", f"WITH x AS (SELECT a, b, n, sum(n) OVER ()::BIGINT AS total, sum(n) OVER (PARTITION BY a)::BIGINT AS rs, sum(n) OVER (PARTITION BY b)::BIGINT AS cs FROM {_CROSS}), y AS (SELECT a, b, n, n * total / (rs * cs) AS lift, least({_TAIL}, 1.0) AS p FROM x WHERE n >= 5), z AS (SELECT *, round(p, 9) AS pr FROM y), q AS (SELECT *, pr * count(*) OVER () / row_number() OVER (ORDER BY pr, a, b) AS raw FROM z) SELECT a, b, n, round(lift, 6) AS lift, round(pr, 6) AS p, round(least(min(raw) OVER (ORDER BY pr DESC, a DESC, b DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS q FROM q")
def _(t):
    """Pairs of values that occur five times or more together: lift, hypergeometric p and q."""
    by = t.part.groupBy(c("p_brand").alias("a"), c("p_type").alias("b")).agg(F.count("*").alias("n"))
    by = with_totals(by, total=F.sum("n")).withColumns({"rs": F.sum("n").over(Window.partitionBy("a")), "cs": F.sum("n").over(Window.partitionBy("b"))}).where("n >= 5")
    p = numeric.column(lambda k, n, m, d: numeric.hypergeometric_tail(int(k), int(n), int(m), int(d)), c("n"), c("total"), c("rs"), c("cs"))
    by = by.withColumns({"lift": F.round(c("n") * c("total") / (c("rs") * c("cs")), 6), "pr": F.round(p, 9), "pair": F.struct("a", "b")})
    q = statistics.adjusted(by.select("pair", "pr"), "pair", "pr").select("pair", F.round("q", 6).alias("q"))
    return by.join(q, "pair").select("a", "b", "n", "lift", F.round("pr", 6).alias("p"), "q")


@question("stat_clusters")
def _(t):
    """Brands by the shape of their types (positive mutual information), joined by average distance where the silhouette is best.

    Both axes are value lists of a choice field; the MOST_AXIS largest values of each are taken, as the method says.
    """

    def grouped(frames):
        import pandas as pd

        table = pd.concat(frames).pivot_table(index="a", columns="b", values="n", fill_value=0)
        group, score = statistics.linked_groups(statistics.ppmi(table.to_numpy(float)))
        first = {g: k for k, g in reversed(list(enumerate(group)))}
        names = {g: i for i, g in enumerate(sorted(first, key=first.get))}
        yield pd.DataFrame({"a": table.index, "cluster": [names[g] for g in group], "silhouette": round(score, 6)})

    by = _largest(t.part.groupBy(c("p_brand").alias("a"), c("p_type").alias("b")).agg(F.count("*").alias("n")))
    return by.coalesce(1).mapInPandas(grouped, "a string, cluster long, silhouette double")


#: Values of an axis that clusters and maps take (a feature of the method: what is shown stays readable).
MOST_AXIS = 60


def _largest(by):
    """The cells of the MOST_AXIS largest values of both axes, so that one small table is left."""
    for axis in ("a", "b"):
        few = by.groupBy(axis).agg(F.sum("n").alias("_s")).orderBy(F.desc("_s"), axis).limit(MOST_AXIS).select(axis)
        by = by.join(F.broadcast(few), axis, "left_semi")
    return by


@question("stat_dispersion", f"SELECT a, round(1 / sum(s * s), 6) AS effective FROM (SELECT a, n / sum(n) OVER (PARTITION BY a) AS s FROM {_CROSS}) GROUP BY 1")
def _(t):
    by = t.part.groupBy(c("p_brand").alias("a"), c("p_type").alias("b")).agg(F.count("*").alias("n")).withColumn("s", c("n") / F.sum("n").over(Window.partitionBy("a")))
    return by.groupBy("a").agg(F.round(1 / F.sum(c("s") * c("s")), 6).alias("effective"))


@question("stat_coverage", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS covered, round(count(DISTINCT c_nationkey) / 25, 6) AS share FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def _(t):
    return t.customer.where("c_acctbal > 5000").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("covered")).withColumn("share", F.round(c("covered") / 25, 6))


@question("stat_recurrence", "SELECT count(*) AS both FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE year(l_shipdate) = 1996 AND l_returnflag = 'R') JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE year(l_shipdate) = 1998 AND l_returnflag = 'R') USING (l_partkey)")
def _(t):
    one = lambda y: t.lineitem.where((F.year("l_shipdate") == y) & (c("l_returnflag") == "R")).select("l_partkey").distinct()
    return one(1996).join(one(1998), "l_partkey").agg(F.count("*").alias("both"))


@question("stat_profile", "SELECT l_linestatus, count(*) FILTER (l_suppkey = 5) AS n, round((count(*) FILTER (l_suppkey = 5) / (SELECT count(*) FROM lineitem WHERE l_suppkey = 5)) / (count(*) / (SELECT count(*) FROM lineitem)), 6) AS lift FROM lineitem GROUP BY 1")
def _(t):
    by = t.lineitem.groupBy("l_linestatus").agg(F.count_if(c("l_suppkey") == 5).alias("n"), F.count("*").alias("all"))
    whole = Window.partitionBy()
    return by.select("l_linestatus", "n", F.round((c("n") / F.sum("n").over(whole)) / (c("all") / F.sum("all").over(whole)), 6).alias("lift"))


_P = f"(SELECT l_suppkey, round(1 / (1 + abs(hits - total * 0.33)), 6) AS p FROM {_BY})"


@question("stat_bh", f"SELECT l_suppkey, p, round(least(min(raw) OVER (ORDER BY p DESC, l_suppkey DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS q FROM (SELECT l_suppkey, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, l_suppkey) AS raw FROM {_P})")
def _(t):
    tests = by_supplier(t).select("l_suppkey", F.round(1 / (1 + F.abs(c("hits") - c("total") * 0.33)), 6).alias("p"))
    return statistics.adjusted(tests, "l_suppkey", "p").withColumn("q", F.round("q", 6))


#: Ratio that is tested for, and the errors of both kinds.
_RHO, _ALPHA, _BETA = 1.5, 0.05, 0.10


def _walked_sql(keys: str, alpha: str) -> str:
    """SQL of the sequential test over the periods of the new line."""
    k, by = (keys + ", ", f"PARTITION BY {keys} ") if keys else ("", "")
    join = f"JOIN f USING ({keys})" if keys else ", f"
    periods = f"(SELECT {k}period, o, e, phi, n FROM (SELECT {k}(cohort + to_months(age))::DATE AS period, sum(hits)::BIGINT AS o, sum(units * rate) AS e FROM t JOIN r USING ({k}age) GROUP BY ALL) {join}, (SELECT count(*) AS n FROM f))"
    sums = f"(SELECT {k}period, sum(o) OVER w AS o, sum(e) OVER w AS e, phi, n FROM {periods} WINDOW w AS ({by}ORDER BY period ROWS UNBOUNDED PRECEDING))"
    ratio = f"(SELECT *, (o * ln(1.5) - e * 0.5) / greatest(phi, 1.0) AS llr FROM {sums})"
    side = f"(SELECT *, CASE WHEN llr >= ln(0.9 / ({alpha})) THEN 'worse' WHEN llr <= ln(0.1 / (1 - ({alpha}))) THEN 'not_worse' END AS side FROM {ratio})"
    return f"{_standard(keys, keys)} SELECT {k}period, o::BIGINT AS o, round(e, 6) AS e, round(llr, 4) AS llr, coalesce(first_value(side IGNORE NULLS) OVER ({by}ORDER BY period ROWS UNBOUNDED PRECEDING), 'continue') AS state FROM {side}"


@question("stat_sprt", _walked_sql("", "0.05"))
def _(t):
    """Is the new line worse than its predecessor? Counts against the old line's rates by age, month by month."""
    new, by_age, phi = standard(t)
    series = lives.expected(new, by_age, [], []).crossJoin(F.broadcast(phi))
    return lives.walked(series, [], _RHO, F.lit(_ALPHA), _BETA).select("period", "o", F.round("e", 6).alias("e"), F.round("llr", 4).alias("llr"), "state")


@question("stat_sprt_phi", f"{_standard()} SELECT round(phi, 6) AS phi FROM f")
def _(t):
    return standard(t)[2].select(F.round("phi", 6).alias("phi"))


@question("stat_changes_scan")
def _(t):
    """Change points of the monthly returns of each supplier, harder to make the more suppliers are scanned; one series is one small group."""
    by = t.lineitem.groupBy("l_suppkey", bucket(c("l_shipdate"), "month").alias("m")).agg(F.count_if(c("l_returnflag") == "R").alias("hits"), F.count("*").alias("total"))

    def scan(frame):
        import pandas as pd

        frame = frame.sort_values("m")
        penalty = 3 * math.log(max(len(frame), 2)) + 2 * math.log(max(frame.k.iloc[0], 1))
        at, _, _ = statistics.seasonal_changes(frame.hits.to_numpy(float), frame.total.to_numpy(float), pd.to_datetime(frame.m).dt.month.to_numpy() - 1, 12, penalty)
        return pd.DataFrame({"l_suppkey": pd.Series([frame.l_suppkey.iloc[0]] * len(at), dtype="int64"), "m": pd.Series([frame.m.iloc[k] for k in at], dtype="object")})

    by = with_totals(by, k=F.count_distinct("l_suppkey"))
    # dealt by number: small groups that cost much would else be put together by their bytes, into a few long tasks
    by = by.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "l_suppkey")
    return by.groupBy("l_suppkey").applyInPandas(scan, "l_suppkey long, m date")


@question("stat_garwood")
def _(t):
    def intervals(frames):
        for frame in frames:
            found = [numeric.poisson_interval(int(h)) for h in frame.hits]
            yield frame.assign(low=[round(a, 6) for a, _ in found], high=[round(b, 6) for _, b in found])

    return by_month(t).mapInPandas(intervals, "m date, hits long, total long, low double, high double")


@question("stat_changes")
def _(t):
    """Change points of the monthly returns and the level from each on, with seasons taken out: one dense, bounded series."""

    def scan(frames):
        import pandas as pd

        whole = pd.concat(frames).sort_values("m")
        hits, total = whole.hits.to_numpy(float), whole.total.to_numpy(float)
        season = pd.to_datetime(whole.m).dt.month.to_numpy() - 1
        at, index, phi = statistics.seasonal_changes(hits, total, season, 12, 3 * math.log(max(len(whole), 2)))
        first = [0, *at]
        level = [hits[a:b].sum() / max((total * index[season])[a:b].sum(), 1e-300) for a, b in zip(first, [*at, len(whole)], strict=True)]
        yield pd.DataFrame({"m": whole.m.iloc[first].to_list(), "level": [round(x, 6) for x in level], "phi": round(phi, 6)})

    return by_month(t).coalesce(1).mapInPandas(scan, "m date, level double, phi double")


def by_cohort(t):
    """(cohort, age, hits, units, horizon): failures by age with the units of the cohort and the last age it was seen at."""
    end = t.lineitem.agg(F.max(bucket(c("l_shipdate"), "month")).alias("end"))
    hits = t.records.where("age >= 0").groupBy("cohort", "age").agg(F.count_if(c("l_returnflag") == "R").alias("hits"))
    units = t.records.groupBy("cohort").agg(F.count("*").alias("units")).crossJoin(F.broadcast(end))
    return units.join(hits, "cohort", "left").select("cohort", "age", "hits", "units", age(c("cohort"), c("end"), "month").alias("horizon"))


def _lives(frames):
    """The fitted life of the cohorts of a small frame, with what it was fitted to."""
    import numpy as np
    import pandas as pd

    whole = pd.concat(frames)
    if not len(whole):
        return None
    cohorts = whole.groupby("cohort").agg(units=("units", "first"), horizon=("horizon", "first"), hits=("hits", "sum"))
    seen = whole.dropna(subset=["age"])
    failures = np.bincount(seen.age.astype(int), seen.hits, minlength=int(cohorts.horizon.max()) + 1)
    best, p = statistics.best_life(failures, cohorts.horizon.to_numpy(), (cohorts.units - cohorts.hits).to_numpy(float))
    return best, p, cohorts, seen


def _fits(frames):
    import pandas as pd

    found = _lives(frames)
    if found is None:
        return
    best, p, _, _ = found
    shape, scale, share = best.unpacked(best.theta)
    b10, bounds = best.life(0.1), best.life_interval(0.1) or (None, None)
    rounded = lambda x: None if x is None else round(x, 4)
    yield pd.DataFrame({"model": ["defective" if best.defective else "weibull"], "shape": [rounded(shape)], "scale": [rounded(scale)], "share": [rounded(share)], "p": [rounded(p)], "b10": [rounded(b10)], "low": [rounded(bounds[0])], "high": [rounded(bounds[1])]})


for _name, _columns in (("stat_life", ("model", "shape", "scale", "share", "p")), ("stat_blife", ("b10", "low", "high"))):
    # cohorts by ages: a frame bounded by the calendar
    question(_name)(lambda t, columns=_columns: by_cohort(t).coalesce(1).mapInPandas(_fits, "model string, shape double, scale double, share double, p double, b10 double, low double, high double").select(*columns))

#: Periods ahead, draws and seed of the forecast.
AHEAD, DRAWS, SEED = 6, 500, 7


@question("stat_forecast")
def _(t):
    """Expected failures of the next periods from the fitted life, with bands: parameters are drawn from their covariance and counts
    from a Poisson distribution, by a fixed seed. The last periods are held out first, as a check (``kind`` backtest has their counts)."""

    def ahead(frames):
        import numpy as np
        import pandas as pd

        whole = pd.concat(frames)
        for kind, cut in (("backtest", AHEAD), ("forecast", 0)):
            own = whole[whole.horizon >= cut].copy()
            own["horizon"] = own.horizon - cut
            late = own.age > own.horizon
            actual = own[late].assign(step=own.age - own.horizon).groupby("step").hits.sum()
            own.loc[late, ["age", "hits"]] = [np.nan, 0]
            found = _lives([own])
            if found is None:
                continue
            best, _, cohorts, _ = found
            spread, rng = best.covariance(), np.random.default_rng(SEED)
            drawn = np.vstack([best.theta, *([rng.multivariate_normal(best.theta, spread, DRAWS)] if spread is not None else [np.repeat(best.theta[None], DRAWS, axis=0)])])
            ages = np.arange(int(cohorts.horizon.max()) + AHEAD + 2, dtype=float)
            share = np.stack([np.diff(best.cumulative(ages, x), prepend=0.0) for x in drawn])
            for step in range(1, AHEAD + 1):
                mean = share[:, cohorts.horizon.to_numpy() + step] @ cohorts.units.to_numpy(float)
                counts = rng.poisson(mean[1:])
                low, high = np.percentile(counts, [2.5, 97.5])
                yield pd.DataFrame({"kind": [kind], "step": [step], "expected": [round(float(mean[0]), 4)], "low": [float(low)], "high": [float(high)], "actual": [float(actual.get(step, 0.0)) if cut else None]})

    return by_cohort(t).coalesce(1).mapInPandas(ahead, "kind string, step long, expected double, low double, high double, actual double")


@question("stat_sprt_scan", f"SELECT l_suppkey, arg_max(state, period) AS state, arg_max(llr, period) AS llr FROM ({_walked_sql('l_suppkey', '0.05 / n')}) GROUP BY 1")
def _(t):
    """The same for each supplier against its own predecessor, the error shared among them."""
    key = ["l_suppkey"]
    new, by_age, phi = standard(t, key, key)
    tests = with_totals(phi, n=F.count("*"))
    own = lives.walked(lives.expected(new, by_age, key, key).join(tests, "l_suppkey").withColumn("a", F.lit(_ALPHA) / c("n")), key, _RHO, c("a"), _BETA)
    return own.groupBy("l_suppkey").agg(F.max_by("state", "period").alias("state"), F.round(F.max_by("llr", "period"), 4).alias("llr"))


@question("stat_ca")
def _(t):
    """Correspondence analysis of two axes: the first two coordinates of the values of both, from the bounded table of their counts.

    The sign of a coordinate is free; the largest one in size of each is made positive.
    """

    def scores(frames):
        import numpy as np
        import pandas as pd

        table = pd.concat(frames).pivot_table(index="a", columns="b", values="n", fill_value=0)
        p = table.to_numpy(float) / table.to_numpy().sum()
        r, k = p.sum(axis=1), p.sum(axis=0)
        u, s, v = np.linalg.svd((p - np.outer(r, k)) / np.sqrt(np.outer(r, k)), full_matrices=False)
        sign = np.sign(u[np.abs(u[:, :2]).argmax(axis=0), [0, 1]])
        explained = round(float((s[:2] ** 2).sum() / (s**2).sum()), 6)
        for axis, names, at in (("a", table.index, u[:, :2] / np.sqrt(r)[:, None]), ("b", table.columns, v.T[:, :2] / np.sqrt(k)[:, None])):
            at = (at * s[:2] * sign).round(6)
            yield pd.DataFrame({"axis": axis, "value": names, "x": at[:, 0], "y": at[:, 1], "explained": explained})

    by = _largest(t.part.groupBy(c("p_brand").alias("a"), c("p_type").alias("b")).agg(F.count("*").alias("n")))
    return by.coalesce(1).mapInPandas(scores, "axis string, value string, x double, y double, explained double")


@question("stat_logit")
def _(t):
    """Logistic regression of returns on quantity and line status, on grouped cells (a bounded frame) by iterated least squares: the
    coefficients with their errors, the likelihood ratio test against no effect, and the area under the curve."""

    def fit(frames):
        import numpy as np
        import pandas as pd

        g = pd.concat(frames)
        x = np.column_stack([np.ones(len(g)), g.q.to_numpy(float) / 50, (g.f == "F").to_numpy(float)])
        hits, n, b = g.hits.to_numpy(float), g.total.to_numpy(float), np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            info = x.T @ ((n * p * (1 - p))[:, None] * x) + 1e-9 * np.eye(3)
            step = np.linalg.solve(info, x.T @ (hits - n * p))
            b = b + step
            if np.abs(step).max() < 1e-10:
                break
        p, base = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30))), hits.sum() / n.sum()
        log_l = lambda p: float((hits * np.log(np.maximum(p, 1e-300)) + (n - hits) * np.log(np.maximum(1 - p, 1e-300))).sum())
        ratio = max(2 * (log_l(p) - log_l(np.full(len(g), base))), 0.0)
        order = np.argsort(p, kind="stable")
        score, pos, neg = p[order].round(12), hits[order], (n - hits)[order]
        _, group = np.unique(score, return_inverse=True)
        pos, neg = np.bincount(group, pos), np.bincount(group, neg)
        auc = float((pos * (np.cumsum(neg) - neg / 2)).sum() / (pos.sum() * neg.sum()))
        yield pd.DataFrame({"term": ["intercept", "quantity", "status_f"], "b": b.round(6), "error": np.sqrt(np.diag(np.linalg.inv(info))).round(6), "ratio": round(ratio, 4), "p": round(numeric.chi2_tail(ratio, 2), 6), "auc": round(auc, 6)})

    by = t.lineitem.groupBy(c("l_quantity").alias("q"), c("l_linestatus").alias("f")).agg(F.count_if(c("l_returnflag") == "R").alias("hits"), F.count("*").alias("total"))
    return by.coalesce(1).mapInPandas(fit, "term string, b double, error double, ratio double, p double, auc double")


@question("ext_registry", "SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity / 10)::INT AS band, l_shipdate::DATE AS at FROM lineitem")
def _(t):
    """A function and a source of time that were added under names, as a query uses them."""
    own = extensions.Registry()
    own.function("quantity_band", "q DOUBLE", "INT", "CAST(floor(q / 10) AS INT)")
    own.time("lineitem", lambda rows: F.to_date(rows["l_shipdate"]))
    own.install(t.spark)
    rows = t.lineitem
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.expr("quantity_band(l_quantity)").alias("band"), own.times["lineitem"](rows).alias("at"))


@question("ext_recipe", "SELECT l_suppkey, count(*) AS months, max(hits)::BIGINT AS most FROM (SELECT l_suppkey, date_trunc('month', l_shipdate) AS m, count(*) FILTER (l_returnflag = 'R') AS hits FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(t):
    """A recipe that was added under a name, on the monthly series of each supplier."""
    import pandas as pd

    own = extensions.Registry()

    @own.recipe("peak", "l_suppkey long, months long, most long", lambda columns: None if "hits" in columns else "it needs hits")
    def peak(frame):
        return pd.DataFrame({"l_suppkey": [frame.l_suppkey.iloc[0]], "months": [len(frame)], "most": [int(frame.hits.max())]})

    by = t.lineitem.groupBy("l_suppkey", bucket(c("l_shipdate"), "month").alias("m")).agg(F.count_if(c("l_returnflag") == "R").alias("hits"))
    return own.run("peak", by, ["l_suppkey"])
