"""Ad-hoc summaries: groups with totals and an "other" line, splits, censuses, points, shares, paging."""

from __future__ import annotations

import base64
import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators.ordered import placed, with_totals

MEASURES = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def grouped(rows: DataFrame, keys: dict[str, Column], value: Column | None = None, measure: str = "count", unique: list[str] | None = None) -> DataFrame:
    """Groups with ``n`` and ``value``. With ``unique`` (an axis has several values for a record) a record counts once in each group."""
    own = rows.select(*[c.alias(k) for k, c in keys.items()], *(unique or []), (value if value is not None else F.lit(None).cast("double")).alias("_v"))
    own = own.distinct() if unique else own
    return own.groupBy(*keys).agg(F.count("*").alias("n"), *([MEASURES[measure]("_v").alias("value")] if measure != "count" else []))


def top_with_other(groups: DataFrame, key: str, keep: int, size: str = "n") -> DataFrame:
    """The ``keep`` largest groups (missing key last among equals, then by key) and one line, without key, for all others.

    The ranking is a top-k: only ``keep`` rows of each task are sorted further.
    """
    order = [F.desc(size), F.asc_nulls_last(key)]
    top = groups.orderBy(*order).limit(keep)
    rest = groups.agg(F.sum(size).alias("all"), F.count("*").alias("groups")).crossJoin(top.agg(F.sum(size).alias("kept"), F.count("*").alias("shown")))
    other = rest.where("groups > shown").select(F.lit(None).cast("string").alias(key), (F.col("all") - F.col("kept")).alias(size), F.lit("other").alias("kind"))
    return top.select(F.col(key).cast("string").alias(key), size, F.lit("group").alias("kind")).union(other)


def split(rows: DataFrame, group: str, by: str, keep: int) -> DataFrame:
    """(group, by, n): counts by two axes; the ``keep`` most frequent values of ``by`` are kept, the others fold into "other".

    The kept values are chosen from the grouped counts, so the rows are read once and never ranked.
    """
    cells = rows.groupBy(group, by).agg(F.count("*").alias("n"))
    totals = cells.groupBy(by).agg(F.sum("n").alias("_t"))
    kept = totals.orderBy(F.desc("_t"), by).limit(keep).select(F.col(by).alias("_k"))
    folded = cells.join(kept, F.col(by) == F.col("_k"), "left").withColumn(by, F.coalesce("_k", F.lit("other")))
    return folded.groupBy(group, by).agg(F.sum("n").alias("n"))


def census(rows: DataFrame, key: str) -> DataFrame:
    """All groups, with the total of rows and the number of groups, to check that the groups add up."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n"))
    totals = groups.agg(F.sum("n").alias("total"), F.count("*").alias("groups"))
    return groups.crossJoin(F.broadcast(totals))  # one row of totals


def shares(groups: DataFrame, within: list[str], value: str = "n") -> DataFrame:
    """Percentage of each line within its key."""
    return groups.withColumn("share", F.round(100 * F.col(value) / F.sum(value).over(Window.partitionBy(*within)), 6))


def pareto(groups: DataFrame, key: str, value: str) -> DataFrame:
    """Cumulative share and class (A to 80, B to 95, C) of grouped values, largest first."""
    out = placed(with_totals(groups, _all=F.sum(value)), [F.desc(value), F.asc(key)], {"cumulative": F.col(value)})
    out = out.withColumn("rank", F.col("rank").cast("int")).withColumn("cumulative", F.round(100 * F.col("cumulative") / F.col("_all"), 6)).drop("_all")
    return out.withColumn("class", F.when(F.col("cumulative") <= 80, "A").when(F.col("cumulative") <= 95, "B").otherwise("C"))


def percentiles(rows: DataFrame, key: str, value: str, points: dict[str, float], bins: int = 4096) -> DataFrame:
    """(key, points): exact percentiles (between the two nearest values) of each group, without gathering a group.

    Values are counted by bins between the group's bounds, which combine before the shuffle; only the values of bins that hold a
    wanted place are then ranked. A bin has about a part in ``bins`` of its group's span; equal values are one row with their count.
    """
    own = rows.select(F.col(key), F.col(value).cast("double").alias("_v")).where("_v is not null")
    counted = own.groupBy(key, "_v").agg(F.count("*").alias("_n"))
    bounds = counted.groupBy(F.col(key).alias("_k")).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    width = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0)
    binned = counted.join(bounds, F.col(key).eqNullSafe(F.col("_k"))).withColumn("_bin", F.least(F.floor((F.col("_v") - F.col("_low")) / width * bins), F.lit(bins - 1)))
    upto = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    sizes = binned.groupBy(key, "_bin").agg(F.sum("_n").alias("_m"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_m").over(upto), F.lit(0))).withColumn("_all", F.sum("_m").over(Window.partitionBy(key)))
    places = [(name, q, side) for name, q in points.items() for side in ("low", "high")]
    at = lambda q, side: F.floor((F.col("_all") - 1) * F.lit(q)) if side == "low" else F.ceil((F.col("_all") - 1) * F.lit(q))
    holds = [(at(q, side) >= F.col("_before")) & (at(q, side) < F.col("_before") + F.col("_m")) for _, q, side in places]
    wanted = sizes.where(reduce(lambda a, b: a | b, holds)).select(F.col(key).alias("_k2"), F.col("_bin").alias("_b2"), "_before", "_all")
    few = binned.join(wanted, F.col(key).eqNullSafe(F.col("_k2")) & (F.col("_bin") == F.col("_b2")))
    within = Window.partitionBy(key, "_bin").orderBy("_v")
    ranked = few.withColumn("_end", F.sum("_n").over(within) + F.col("_before")).withColumn("_start", F.col("_end") - F.col("_n"))
    value_at = lambda q, side: F.max(F.when((at(q, side) >= F.col("_start")) & (at(q, side) < F.col("_end")), F.col("_v")))
    got = ranked.groupBy(key).agg(F.max("_all").alias("_all"), *[value_at(q, side).alias(f"_{name}_{side}") for name, q, side in places])
    share = lambda q: (F.col("_all") - 1) * F.lit(q) - F.floor((F.col("_all") - 1) * F.lit(q))
    return got.select(key, *[(F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * share(q)).alias(n) for n, q in points.items()])


def keyset_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next ``size`` rows after a key; a filter on the scan and a top-k, never an offset."""
    return rows.where(F.col(key) > F.lit(after)).orderBy(key).limit(size)


def fingerprint(conditions: dict) -> str:
    """A short print of filters and order; equal for equal ones, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(conditions, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cursor(last: list, conditions: dict) -> str:
    """What a reader sends back to go on behind the last key of a page: the key and the print of the filters, as one word."""
    return base64.urlsafe_b64encode(json.dumps([last, fingerprint(conditions)], default=str).encode()).decode().rstrip("=")


def after_cursor(text: str, conditions: dict) -> list:
    """The key of a cursor; raises if it is damaged or belongs to other filters."""
    try:
        last, print_ = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except (ValueError, TypeError) as e:
        raise ValueError("the cursor is damaged") from e
    if print_ != fingerprint(conditions):
        raise ValueError("the cursor belongs to other filters")
    return last


def relevance(c: Column, text: str) -> Column:
    """Order of matches: exact, prefix, inside, else."""
    low, text = F.lower(c), text.lower()
    return F.when(low == text, 0).when(low.startswith(text), 1).when(low.contains(text), 2).otherwise(3)
