"""Findings of several recipes over metric cells, on one scale: strength times support, with the false ones among them held down.

Cells are (axis, key, period, hits, total): one table for all axes of a metric. A recipe gives, for every key of every axis, how strong a
departure is and how likely it would be by chance. What a recipe said of cells that are as they were is taken from the last scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.operators import numeric
from ravelin.operators.ordered import placed, with_totals

#: Months that count as recent, hits from which a finding has its full support, and the share of false findings that is borne.
RECENT, FULL_SUPPORT, FALSE_SHARE = 12, 1000, 0.05
SCHEMA = ["recipe", "axis", "key", "strength", "statistic", "df", "support"]


def share(cells: DataFrame) -> DataFrame:
    """How far a key's share of hits is from that of its axis: the logarithm of the ratio, and the squared score of a binomial."""
    own = cells.groupBy("axis", "key").agg(F.sum("hits").alias("h"), F.sum("total").alias("n"))
    whole = cells.groupBy("axis").agg(F.try_divide(F.sum("hits"), F.sum("total")).alias("p"))
    own = own.join(F.broadcast(whole), "axis")
    score = F.try_divide(F.pow(F.col("h") - F.col("n") * F.col("p"), F.lit(2)), F.col("n") * F.col("p") * (1 - F.col("p")))
    return own.where("h > 0").select("axis", "key", F.abs(F.log(F.try_divide(F.col("h") / F.col("n"), "p"))).alias("strength"), score.alias("statistic"), F.lit(1).alias("df"), F.col("n").alias("support"))


def recent(cells: DataFrame) -> DataFrame:
    """How far a key's rate of the last RECENT months of its axis is from that before: the logarithm of their ratio, and its square over its
    variance."""
    last = cells.groupBy("axis").agg(F.add_months(F.max("period"), 1 - RECENT).alias("since"))
    late = F.col("period") >= F.col("since")
    sums = {f"{n}{k}": F.sum(F.when(late if k else ~late, F.col(c))) for n, c in (("h", "hits"), ("n", "total")) for k in (0, 1)}
    own = cells.join(F.broadcast(last), "axis").groupBy("axis", "key").agg(*[v.alias(k) for k, v in sums.items()]).where("h0 > 0 and h1 > 0")
    ratio = F.log((F.col("h1") / F.col("n1")) / (F.col("h0") / F.col("n0")))
    return own.select("axis", "key", F.abs(ratio).alias("strength"), (ratio * ratio / (1 / F.col("h0") + 1 / F.col("h1"))).alias("statistic"), F.lit(1).alias("df"), F.col("n1").alias("support"))


def unsteady(cells: DataFrame) -> DataFrame:
    """How unevenly a key's hits fall on its months beside their totals: the root of chi-square over all, and chi-square itself."""
    whole = cells.groupBy("axis", "key").agg(F.try_divide(F.sum("hits"), F.sum("total")).alias("p"))
    own = cells.join(whole, ["axis", "key"]).where("p > 0 and p < 1")
    part = F.pow(F.col("hits") - F.col("total") * F.col("p"), F.lit(2)) / (F.col("total") * F.col("p") * (1 - F.col("p")))
    sums = own.where("total > 0").groupBy("axis", "key").agg(F.sum(part).alias("statistic"), F.count("*").alias("months"), F.sum("total").alias("support")).where("months > 1")
    return sums.select("axis", "key", F.sqrt(F.col("statistic") / F.col("support")).alias("strength"), "statistic", (F.col("months") - 1).cast("int").alias("df"), "support")


RECIPES: dict[str, Callable[[DataFrame], DataFrame]] = {"share": share, "recent": recent, "unsteady": unsteady}


def fingerprints(cells: DataFrame) -> DataFrame:
    """(axis, key, print): what a key's results depend on: its own cells and its axis's sums, whatever the order of rows."""
    own = cells.groupBy("axis", "key").agg(F.sum(F.xxhash64("period", "hits", "total").cast("decimal(38,0)")).alias("own"), F.count("*").alias("n"))
    whole = cells.groupBy("axis").agg(F.max("period").alias("last"), F.sum("hits").alias("h"), F.sum("total").alias("t"))
    return own.join(F.broadcast(whole), "axis").select("axis", "key", F.sha2(F.concat_ws("|", "own", "n", "last", "h", "t"), 256).alias("print"))


def measured(cells: DataFrame, stored: DataFrame | None = None, recipes: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """(recipe, axis, key, strength, statistic, df, support, print) of all keys; of keys whose cells are those of ``stored`` (an earlier result) the
    stored rows. An axis with a changed key has changed sums, so its other keys are measured again as well."""
    recipes = RECIPES if recipes is None else recipes
    prints = fingerprints(cells)
    todo = cells
    if stored is not None:
        known = stored.select("axis", "key", "print").distinct()
        fresh = prints.join(known, ["axis", "key", "print"], "left_anti").select("axis").distinct()
        todo = cells.join(F.broadcast(fresh), "axis", "left_semi")
    out = None
    for name, recipe in recipes.items():
        one = recipe(todo).withColumn("recipe", F.lit(name)).select(*SCHEMA)
        out = one if out is None else out.union(one)
    out = out.where("strength is not null and statistic is not null").join(prints, ["axis", "key"])
    out = out.select(*SCHEMA, "print")
    if stored is not None:
        out = out.union(stored.join(prints.select("axis", "key", "print"), ["axis", "key", "print"], "left_semi").join(F.broadcast(fresh), "axis", "left_anti").select(*SCHEMA, "print"))
    return out


def scored(found: DataFrame) -> DataFrame:
    """``found`` with its score: strength by support, which is full from FULL_SUPPORT rows on."""
    weight = F.least(F.lit(1.0), F.log(1 + F.col("support")) / math.log(1 + FULL_SUPPORT))
    return found.withColumn("score", F.col("strength") * weight)


def judged(found: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """``found`` with p, q and kept: q is the share of false findings if all with this p or a smaller one are kept (Benjamini and Hochberg),
    over the findings of all recipes and axes together."""
    own = found.withColumn("p", numeric.column(lambda x, df: numeric.chi2_tail(x, int(df)), F.col("statistic"), F.col("df")))
    own = with_totals(own, _n=F.count("*"))
    out = placed(own, [F.asc("p"), F.asc("recipe"), F.asc("axis"), F.asc("key")], least={"q": F.col("p") * F.col("_n") / F.col("rank")})
    return out.withColumn("q", F.least("q", F.lit(1.0))).withColumn("kept", F.col("q") <= false_share).drop("_n", "rank")
