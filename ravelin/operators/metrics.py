"""Metric cells: records folded once into (period, cohort, age, dimensions) with mergeable measures, and what is read from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.functions.scalars import bucket, numeric, shifted

#: How each measure of a cell merges.
MERGED = {"count": F.sum, "value_count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def cells(records: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """count, value_count, sum, min and max by the keys; partial aggregation runs before the one shuffle."""
    own = records.withColumn("_v", value)
    return own.groupBy(*keys).agg(F.count("*").alias("count"), F.count("_v").alias("value_count"), F.sum("_v").alias("sum"), F.min("_v").alias("min"), F.max("_v").alias("max"))


def value_of(records: DataFrame, name: str) -> Column:
    """The number that a metric adds up: a numeric column, or a text read as a number where it is one; a column of several values or of
    another kind is refused."""
    kind = dict(records.dtypes)[name]
    if kind.startswith(("array", "map", "struct")):
        raise ValueError(f"{name} has several values in a record; a metric adds one number of each")
    if kind == "string":
        return numeric(F.col(name))
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kind.startswith("decimal"):
        raise ValueError(f"{name} holds {kind}, not numbers")
    return F.col(name).cast("double")


def once(records: DataFrame, keys: list[str], ident: str, value: str) -> DataFrame:
    """A record with several values on an axis counts once in each cell."""
    return cells(records.select(*keys, ident, value).distinct(), keys, F.col(value))


def read(found: DataFrame, keys: list[str]) -> DataFrame:
    """Cells merged to fewer keys; the average comes from merged sums."""
    out = found.groupBy(*keys).agg(*[f(k).alias(k) for k, f in MERGED.items()])
    return out.withColumn("avg", F.when(F.col("value_count") > 0, F.col("sum") / F.col("value_count")))


def ratio(numerator: DataFrame, denominator: DataFrame, on: list[str], per: float = 1.0) -> DataFrame:
    """Full outer join of two counts with null-safe keys: (on, num, den, ratio); no ratio without a denominator."""
    right = denominator.select(*[F.col(k).alias(f"_{k}") for k in on], F.col("count").alias("den"))
    match = None
    for k in on:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        match = one if match is None else match & one
    out = numerator.withColumnRenamed("count", "num").join(right, match, "full_outer")
    return out.select(*[F.coalesce(k, f"_{k}").alias(k) for k in on], "num", "den", F.when(F.col("den") > 0, F.coalesce("num", F.lit(0)) / F.col("den") * per).alias("ratio"))


def rules(conditions: list[tuple[str, Column]], other: str = "other") -> Column:
    """Label of the first rule that is met; an unknown condition isn't met."""
    out = F.lit(None)
    for n, (label, c) in enumerate(conditions):
        out = F.when(c, F.lit(label)) if n == 0 else out.when(c, F.lit(label))
    return out.otherwise(F.lit(other))


def visits(rows: DataFrame, serial: str, at: str, ident: str, within: int, cutoff: Column) -> DataFrame:
    """Number of a visit of its serial (1, 2, 3, 4+) and whether another follows within so many days: yes, no, or open by the cutoff."""
    order = Window.partitionBy(serial).orderBy(at, ident)
    day, later = F.to_date(at), F.to_date(F.lead(at).over(order))
    number = F.row_number().over(order)
    known = F.col(serial).isNotNull() & F.col(at).isNotNull()
    again = F.when(F.datediff(later, day) <= within, "yes").when(F.date_add(day, within) > cutoff, "open").otherwise("no")
    return rows.withColumn("visit", F.when(known, F.when(number >= 4, "4+").otherwise(number.cast("string")))).withColumn("again", F.when(known, again))


def stay(found: DataFrame, grain: str, periods: int, until: Column) -> DataFrame:
    """Each cell copied to its period and the following ones, not past ``until``, and merged again; a missing period isn't spread."""
    spread = found.withColumn("_k", F.explode(F.when(F.col("period").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(periods - 1)))))
    moved = spread.withColumn("period", F.when(F.col("period").isNotNull(), shifted(F.col("period"), grain, F.col("_k")))).where(F.col("period").isNull() | (F.col("period") <= until))
    return moved.groupBy(*[c for c in found.columns if c not in MERGED]).agg(*[f(k).alias(k) for k, f in MERGED.items()])


def dense(spark, first, last, grain: str = "month") -> DataFrame:
    """All period starts between two dates."""
    step = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}[grain]
    return spark.sql(f"SELECT explode(sequence(date '{first}', date '{last}', {step})) AS period")


def series(found: DataFrame, calendar: DataFrame) -> DataFrame:
    """Counts on a dense calendar with the previous point and the point a year before; a missing period counts 0 and has no sum."""
    by = found.groupBy("period").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))
    dense_ = calendar.join(by, "period", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    before = dense_.select(F.add_months("period", 12).alias("period"), F.col("count").alias("yoy"))
    return dense_.withColumn("prev", F.lag("count").over(Window.orderBy("period"))).join(before, "period", "left")


def cumulative(found: DataFrame) -> DataFrame:
    """Running count and sum of each cohort over age, from age 0."""
    by = found.where("age >= 0").groupBy("cohort", "age").agg(F.sum("count").alias("count"), F.sum("sum").alias("sum"))
    upto = Window.partitionBy("cohort").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    return by.select("cohort", "age", F.sum("count").over(upto).alias("running_count"), F.sum("sum").over(upto).alias("running_sum"))


def changed_periods(records: DataFrame, changed: DataFrame, key: str, period: str) -> DataFrame:
    """Periods that changed records touch: what an incremental refresh recomputes."""
    return records.join(changed.select(key).distinct(), key, "left_semi").select(period).distinct()


def refreshed(old: DataFrame, records: DataFrame, periods: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Cells after a refresh: old cells of other periods, and new cells of the given ones (null periods match null)."""
    p = periods.select(F.col("period").alias("_p"))
    stay_ = old.join(p, F.col("period").eqNullSafe(F.col("_p")), "left_anti")
    again = records.join(p, F.col("period").eqNullSafe(F.col("_p")), "left_semi")
    return stay_.select(*keys, *MERGED).union(cells(again, keys, value).select(*keys, *MERGED))


class TooManyCells(ValueError):
    pass


def _by_period(found: DataFrame, path: str, overwrite: str) -> None:
    """Cells written by period: the rows of a period come together first, so that it is a file or few, and a large one is split."""
    found.hint("rebalance", "period").write.mode("overwrite").option("partitionOverwriteMode", overwrite).partitionBy("period").parquet(path)


def write_cells(found: DataFrame, path: str, most: int = 10_000_000) -> None:
    """Cells as a table by period. If there are more than ``most``, it raises and the place stays as it was: cells are written beside it, counted
    from the files' own sums and moved there."""
    spark, beside = found.sparkSession, f"{path}.new"
    _by_period(found, beside, "static")
    files = spark._jvm.org.apache.hadoop.fs
    old, new = files.Path(path), files.Path(beside)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if spark.read.parquet(beside).count() > most:
        fs.delete(new, True)
        raise TooManyCells(f"the metric has more than {most} cells; leave out an axis or take a coarser one")
    fs.delete(old, True)
    fs.rename(new, old)


def rewrite_periods(path: str, records: DataFrame, periods: DataFrame, keys: list[str], value: Column) -> None:
    """The given periods of written cells anew from ``records``: each is replaced as a whole, and one without a record any more goes.

    A run that is repeated after a failure writes the same cells again. The driver holds the list of periods, which the calendar bounds.
    """
    spark = records.sparkSession
    p = periods.select(F.col("period").alias("_p")).distinct().persist()
    wanted = {r[0] for r in p.collect()}
    new = cells(records.join(F.broadcast(p), F.col("period").eqNullSafe(F.col("_p")), "left_semi"), keys, value).persist()
    _by_period(new, path, "dynamic")
    left = {r[0] for r in new.select("period").distinct().collect()}
    new.unpersist()
    p.unpersist()
    files = spark._jvm.org.apache.hadoop.fs
    for gone in wanted - left:
        place = files.Path(f"{path}/period={'__HIVE_DEFAULT_PARTITION__' if gone is None else gone}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def refresh_plan(records: DataFrame, changed: DataFrame, key: str, period: str, reasons: dict[str, bool], most_share: float = 0.2) -> DataFrame:
    """(period, mode, reason): the periods to count again, or one row that asks for a full count and says why.

    ``reasons`` are what rules out an incremental refresh, in order (no earlier run, another definition, a changed neighbour, ...);
    too many changed records do, too.
    """
    spark = records.sparkSession
    why = next((name for name, holds in reasons.items() if holds), None)
    if why is None:
        sizes = records.select(key).distinct().join(changed.select(key).distinct().withColumn("_c", F.lit(1)), key, "left").agg(F.count("*").alias("n"), F.count("_c").alias("c")).first()
        if sizes["c"] > most_share * sizes["n"]:
            why = "too many changes"
    if why is not None:
        return spark.createDataFrame([(None, "full", why)], "period date, mode string, reason string")
    return changed_periods(records, changed, key, period).select(F.col(period).alias("period"), F.lit("periods").alias("mode"), F.lit(None).cast("string").alias("reason"))


#: Parts that a table is laid out in for samples; a sample is the first so many, so each is part of the next one.
LAID_PARTS = 16


def laid_out(records: DataFrame, ident: str, path: str) -> DataFrame:
    """The records written in LAID_PARTS parts by a hash of the record, once; a sample of some parts then reads no file of the others."""
    part = F.conv(F.substring(F.md5(F.col(ident).cast("string")), 1, 1), 16, 10).cast("int")
    rows = records.withColumn("_part", part)
    rows.repartition("_part").write.partitionBy("_part").parquet(path)
    return records.sparkSession.read.schema(rows.schema).parquet(path)


def sampled_combos(laid: DataFrame, keys: list[str], eighths: int) -> DataFrame:
    """(eighths, rows, combos, once, twice) of a sample of ``laid_out`` records: the filter is one of folders, so the scan reads only these."""
    own = laid.where(F.col("_part") < 2 * eighths).groupBy(*keys).agg(F.count("*").alias("n"))
    return own.agg(F.lit(eighths).alias("eighths"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("combos"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))


def estimated(samples: DataFrame, total: int) -> DataFrame:
    """``samples`` with two estimates of all combinations of ``total`` rows, both of them blended, and how far they are apart.

    Those met once and twice tell how many are unseen of a population that is sampled with repetition (low, if rows have more combinations
    than a sample shows); those met once scaled by the root of the share tell it of one drawn without. The blend is their geometric
    mean, and half of the logarithm of their ratio its error.
    """
    unseen = F.col("combos") + F.col("once") * F.col("once") / (2.0 * F.greatest("twice", F.lit(1)))
    scaled = F.sqrt(F.try_divide(F.lit(float(total)), "rows")) * F.col("once") + (F.col("combos") - F.col("once"))
    out = samples.withColumns({"unseen": F.least(unseen, F.lit(float(total))), "scaled": F.least(scaled, F.lit(float(total)))})
    return out.withColumns({"blended": F.sqrt(F.col("unseen") * F.col("scaled")), "error": F.abs(F.log(F.try_divide("unseen", "scaled"))) / 2})


def estimate(laid: DataFrame, keys: list[str], total: int, close: float = 0.1, ladder: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """One row of ``estimated``: of the smallest sample whose two estimates are ``close``, else of the largest. A larger sample is read only
    if the one before it doesn't do."""
    for eighths in ladder:
        now = estimated(sampled_combos(laid, keys, eighths), total)
        row = now.first()
        if row["error"] is not None and row["error"] <= close:
            break
    return laid.sparkSession.createDataFrame([row], now.schema)
