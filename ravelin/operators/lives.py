"""Expected counts from the rates of a predecessor: an exposure matrix of cohorts by age, its rates, and how much cohorts scatter around them.

A cohort is what began in one month; it is seen from age 0 to its horizon. All tables are bounded by the calendar (and the number of
keys), and all steps are joins and grouped sums. The matrix itself is no table: a cohort is one row with the hits of the ages that have
some, cohorts are dealt by their keys, and ages are made from a cohort where they are summed, so that they aren't shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of a 95 % interval in standard deviations, and the fewest cohorts that say something about their scatter.
Z95, LEAST_COHORTS = 1.959963984540054, 5


def exposures(rows: DataFrame, end: DataFrame, hit: Column, keys: list[str]) -> DataFrame:
    """(keys, cohort, units, horizon, hits) of every cohort that was seen; ``rows`` have cohort and age, ``end`` is the last month, and ``hits``
    says how many each age has (none if it isn't there)."""
    horizon = 12 * (F.year("end") - F.year("cohort")) + F.month("end") - F.month("cohort")
    cells = rows.groupBy(*keys, "cohort", "age").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    cells = cells.crossJoin(F.broadcast(end.toDF("end"))).withColumn("horizon", horizon).where("horizon >= 0")
    hits = F.when((F.col("hits") > 0) & F.col("age").between(0, F.col("horizon")), F.struct("age", "hits"))
    return cells.groupBy(*keys, "cohort", "horizon").agg(F.sum("n").alias("units"), F.map_from_entries(F.collect_list(hits)).alias("hits"))


def _dealt(cohorts: DataFrame, keys: list[str]) -> DataFrame:
    return cohorts.repartition(*keys) if keys else cohorts


def _aged(cohorts: DataFrame, upto: Column) -> DataFrame:
    """Cohorts for each age from 0 to ``upto``, and the hits of that age."""
    others = [c for c in cohorts.columns if c != "hits"]
    aged = cohorts.where(upto >= 0).select(*others, F.col("hits").alias("_hits"), F.explode(F.sequence(F.lit(0), upto)).alias("age"))
    return aged.withColumn("hits", F.coalesce(F.try_element_at("_hits", "age"), F.lit(0))).drop("_hits")


def _with_rates(cohorts: DataFrame, by_age: DataFrame, shared: list[str]) -> DataFrame:
    return cohorts.join(by_age, shared) if shared else cohorts.crossJoin(F.broadcast(by_age))


def rates(cohorts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, by_age): one row with rate, at_age and records of each age from 0 on: hits of an age over the units of all cohorts seen at it."""
    own = _aged(_dealt(cohorts, keys), F.col("horizon")).groupBy(*keys, "age").agg(F.sum("units").alias("at_age"), F.sum("hits").alias("records"))
    # the oldest cohort was seen at every age up to its horizon, so an age is a place
    by_age = F.array_sort(F.collect_list(F.struct("age", F.try_divide("records", "at_age").alias("rate"), "at_age", "records")))
    return own.groupBy(*keys).agg(by_age.alias("by_age"))


def dispersion(cohorts: DataFrame, by_age: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, phi): Pearson's measure of the cohorts' sums around what the rates expect, 1 at least and for fewer than LEAST_COHORTS of them."""
    upto = F.slice("by_age", F.lit(1), F.col("horizon") + 1)
    o = F.aggregate(F.map_values("hits"), F.lit(0).cast("long"), lambda s, x: s + x)
    e = F.aggregate(upto, F.lit(0.0), lambda s, x: s + F.col("units") * x["rate"])
    sums = _with_rates(_dealt(cohorts, keys), by_age, keys).select(*keys, o.alias("o"), e.alias("e")).where("e > 0")
    found = sums.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("o") - F.col("e"), F.lit(2)) / F.col("e")).alias("chi2"))
    phi = F.when(F.col("n") >= LEAST_COHORTS, F.greatest(F.lit(1.0), F.try_divide("chi2", F.col("n") - 1))).otherwise(1.0)
    return found.select(*keys, phi.alias("phi"))


def _against(target: DataFrame, by_age: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """Cohorts of ``target`` for each age at which they were seen, with the predecessor's figures ``r`` of that age; ages that it never
    reached are left out."""
    own = _with_rates(_dealt(target, keys), by_age, shared)
    aged = _aged(own, F.least(F.col("horizon"), F.size("by_age") - 1))
    return aged.withColumn("r", F.get("by_age", F.col("age"))).drop("by_age")


def expected(target: DataFrame, by_age: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """(keys, period, o, e): hits of each period and what the predecessor's rates expect for it; ages that it never reached are left out.
    ``shared`` are the keys that the rates are by, too."""
    period = F.add_months("cohort", F.col("age")).alias("period")
    own = _against(target, by_age, keys, shared)
    return own.groupBy(*keys, period).agg(F.sum("hits").alias("o"), F.sum(F.col("units") * F.col("r.rate")).alias("e"))


def walked(series: DataFrame, keys: list[str], rho: float, alpha: Column, beta: float) -> DataFrame:
    """(keys, period, o, e, llr, state): a sequential test of the rate being ``rho`` times that of the predecessor against its being equal.

    The log ratio of all counts so far is divided by ``phi``; the first boundary that it crosses fixes the state.
    """
    order = Window.partitionBy(*keys).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    own = series.withColumns({"o": F.sum("o").over(order), "e": F.sum("e").over(order)})
    own = own.withColumn("llr", (F.col("o") * F.log(F.lit(rho)) - F.col("e") * (rho - 1)) / F.greatest("phi", F.lit(1.0)))
    side = F.when(F.col("llr") >= F.log((1 - beta) / alpha), "worse").when(F.col("llr") <= F.log(beta / (1 - alpha)), "not_worse")
    own = own.withColumn("side", side)
    return own.select(*keys, "period", "o", "e", "llr", F.coalesce(F.first("side", ignorenulls=True).over(order), F.lit("continue")).alias("state"))


def compared(target: DataFrame, by_age: DataFrame, phi: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, o, e, ratio, low, high): counts over expectation with an interval by the delta method: the scatter of the counts and of the
    predecessor's rates, both widened by ``phi`` (one row). Without a count the upper end is that of a Poisson count of 0."""
    own = _against(target, by_age, keys, []).groupBy(*keys, "age").agg(F.sum("hits").alias("o"), F.sum("units").alias("w"), F.first("r").alias("r"))
    own = own.select(*keys, "o", "w", "r.*")
    spread = F.pow(F.col("w") / F.col("at_age"), F.lit(2)) * F.col("records")
    sums = own.groupBy(*keys).agg(F.sum("o").alias("o"), F.sum(F.col("w") * F.col("rate")).alias("e"), F.sum(spread).alias("v")).crossJoin(F.broadcast(phi))
    around = F.try_divide(F.col("v"), F.col("e") * F.col("e"))
    wide = lambda x: Z95 * F.sqrt(F.col("phi") * x)
    half = wide(F.try_divide(F.lit(1.0), "o") + around)
    ratio = F.try_divide(F.col("o").cast("double"), "e")
    none = F.try_divide(-F.log(F.lit(0.025)), "e") * F.exp(wide(around)) * F.sqrt("phi")
    return sums.select(*keys, "o", "e", ratio.alias("ratio"), F.when(F.col("o") > 0, ratio * F.exp(-half)).otherwise(F.when(F.col("e") > 0, 0.0)).alias("low"), F.when(F.col("o") > 0, ratio * F.exp(half)).otherwise(none).alias("high"))


def survived(table: DataFrame) -> DataFrame:
    """(age, failed, at_risk, share, low, high) of a life table: the failed share by Kaplan and Meier, with Greenwood's variance carried
    through log(-log), so that the interval stays within 0 and 1."""
    upto = Window.orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    own = table.where("at_risk > failed").withColumn("ln_s", F.sum(F.log(1 - F.col("failed") / F.col("at_risk"))).over(upto))
    own = own.withColumn("g", F.sum(F.col("failed") / (F.col("at_risk") * (F.col("at_risk") - F.col("failed")).cast("double"))).over(upto))
    half = Z95 * F.sqrt("g") / -F.col("ln_s")
    end = lambda sign: F.when(F.col("ln_s") < 0, 1 - F.exp(F.col("ln_s") * F.exp(sign * half))).otherwise(0.0)
    return own.select("age", "failed", "at_risk", (1 - F.exp("ln_s")).alias("share"), end(-1).alias("low"), end(1).alias("high"))
