"""Joins and predicates over linked rows: existence, counts, same-edge groups, validity, exclusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.scalars import missing


def differs(c: Column, value) -> Column:
    """Not equal; a missing value differs too."""
    return ~c.eqNullSafe(F.lit(value))


def contains(c: Column, text: str) -> Column:
    return F.lower(c).contains(text.lower())


def starts(c: Column, text: str) -> Column:
    return F.lower(c).startswith(text.lower())


def any_element(c: Column, text: str) -> Column:
    """Does an element of an array contain the text, whatever its case?"""
    return F.exists(c, lambda x: F.lower(x.cast("string")).contains(text.lower()))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def excluded(*conditions: Column) -> Column:
    """Rows that don't meet all conditions; unknown counts as not met, so matched and excluded rows add up to all."""
    return ~F.coalesce(all_of(*conditions), F.lit(False))


def linked(rows: DataFrame, links: DataFrame, on: str | list, exists: bool = True) -> DataFrame:
    """Rows with (or without) a linked row."""
    return rows.join(links, on, "left_semi" if exists else "left_anti")


def linked_counts(rows: DataFrame, edges: DataFrame, key: str, far: str, name: str = "n") -> DataFrame:
    """Rows with their number of distinct linked objects; 0 is a number too."""
    counts = edges.groupBy(F.col(key).alias("_key")).agg(F.countDistinct(far).alias(name))
    return rows.join(counts, rows[key] == F.col("_key"), "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("_key")


def alive(start: Column, end: Column, day) -> Column:
    """Half-open validity [start, end); an open end is valid without bound."""
    day = F.lit(day).cast("date")
    return (start.isNull() | (start <= day)) & (end.isNull() | (end > day))


def overlaps(a: Column, b: Column, start, end) -> Column:
    return (a < F.lit(end).cast("date")) & (b > F.lit(start).cast("date"))


def best_linked(rows: DataFrame, key: str, value: str, cap: int) -> DataFrame:
    """(key, values, more): the first ``cap`` distinct linked values of each key in order, and whether there are others.

    Ranking keeps cap + 1 rows of a key before they are gathered, so no key collects an unbounded list.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy(key).orderBy(value)
    few = rows.select(key, value).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap + 1)
    return few.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= cap, F.col(value)))).alias("values"), (F.max("rank") > cap).alias("more"))


def left_out(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet all conditions, and all but each of them (to explain an empty result), in one pass."""
    sums = [F.count_if(all_of(*conditions.values())).alias("total")]
    for name in conditions:
        rest = [c for k, c in conditions.items() if k != name]
        sums.append(F.count_if(all_of(*rest) if rest else F.lit(True)).alias(f"without_{name}"))
    return rows.agg(*sums)


def fill_ratio(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, total) in one pass over the rows."""
    one = rows.agg(*[F.count_if(~missing(F.col(c))).alias(c) for c in columns], F.count("*").alias("_total"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), F.col("_total").alias("total")) for c in columns])).alias("r")).select("r.*")
