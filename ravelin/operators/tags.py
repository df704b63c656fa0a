"""Nearest objects by weighted tags: Jaccard similarity where a rare tag weighs more.

Objects with equal tags are one set. Sets meet at rare tags first, whose lists are short; the k-th best score found there bounds what a set
could still gain from the tags that are left, so a common tag is only walked for sets that could gain by it, the rarest first, and then in
cells of two blocks of its list, whose pairs are never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators.graphs import _cut

#: Weights are whole millionths, so that sums are exact in any order.
UNIT = 1_000_000
#: Sets that a tag may have to count as rare, of a block of a common tag's list, and tags that a cell looks at at once.
RARE, BLOCK, TAGS_AT_ONCE = 200, 512, 4096


def weights(own: DataFrame, ident: str, tag: str) -> DataFrame:
    """(tag, w): ln(N / df) of each tag of ``own`` (distinct ident, tag) in millionths; a tag of all objects weighs nothing."""
    n = own.select(ident).distinct().agg(F.count("*").alias("_n"))
    return own.groupBy(tag).agg(F.count("*").alias("_df")).crossJoin(F.broadcast(n)).select(tag, F.round(F.log(F.col("_n") / F.col("_df")) * UNIT).cast("long").alias("w"))


def _scored(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, score) of pairs of sets, over all of their tags."""
    side = lambda x: sets.select(F.col("set").alias(x), F.col("all").alias(f"_{x}"), F.col("total").alias(f"_w{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.aggregate(F.array_intersect("_a", "_b"), F.lit(0).cast("long"), lambda s, x: s + x["w"])
    return both.select("a", "b", (shared / (F.col("_wa") + F.col("_wb") - shared)).alias("score"))


def nearest_by_tags(rows: DataFrame, ident: str, tag: str, top: int, rare: int = RARE) -> DataFrame:
    """(ident, found, score, rank): for each object the ``top`` others by shared weight over united weight; ties go to the smallest.

    Objects that share no tag with a weight aren't near. Null objects and tags are left out, and repeated rows count once.
    """
    own = _cut(rows.select(F.col(ident).alias("id"), F.col(tag).alias("tag")).where("id is not null and tag is not null").distinct())
    # tags go on as numbers
    heavy = _cut(weights(own, "id", "tag").where("w > 0").withColumn("no", F.monotonically_increasing_id()))
    tagged = own.join(heavy, "tag").select("id", F.col("no").alias("tag"), "w").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("tag", "w"))).alias("all"))
    order = Window.partitionBy("all").orderBy("id")
    # of a set only the first few objects can be among another's nearest; ranks are limited before the shuffle
    first = _cut(tagged.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top + 1))
    sets = _cut(first.where("_r = 1").select(F.col("id").alias("set"), "all", F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["w"]).alias("total")))
    members = first.join(sets.select("set", "all"), "all").select("set", F.col("id").alias("member"))
    lists = _cut(sets.select("set", "total", F.explode("all").alias("t")).select("set", "total", "t.*"))
    sizes = lists.groupBy("tag").agg(F.count("*").alias("n"))
    lists = _cut(lists.join(sizes, "tag"))

    few = lists.where(F.col("n") <= rare)
    pairs = few.select(F.col("set").alias("a"), "tag").join(few.select(F.col("set").alias("b"), "tag"), "tag").where("a <> b").select("a", "b").distinct()
    near = _cut(_scored(pairs, sets))
    by_score = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    bound = lambda rows: rows.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") == top).select(F.col("a").alias("set"), F.col("score").alias("least"))
    left = Window.partitionBy("set").orderBy("n", "tag")
    common = lists.where(F.col("n") > rare).withColumns({"turn": F.row_number().over(left), "most": F.sum("w").over(left.rowsBetween(0, Window.unboundedFollowing))})
    common = _cut(common)
    last, done = common.agg(F.max("turn")).first()[0] or 0, 0
    while done < last:
        # twice as many tags of a set in each round; of what was not met before, no set shares more than the tags from here on
        now = common.where((F.col("turn") > done) & (F.col("turn") <= max(1, 2 * done))).join(bound(near), "set", "left")
        asks = _cut(now.where(F.coalesce("least", F.lit(0.0)) <= F.col("most") / F.col("total")).select("set", "tag", "n"))
        done = max(1, 2 * done)
        if not asks.isEmpty():
            met = near.union(_met(common, asks, sets, top)).distinct()
            near = _cut(met.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= top).drop("_r"))

    ranked = near.withColumn("_r", F.row_number().over(by_score)).where(F.col("_r") <= top)
    found = ranked.join(members.select(F.col("set").alias("b"), "member"), "b").select(F.col("a").alias("set"), "member", "score")
    found = found.union(members.select("set", "member", F.lit(1.0).alias("score")))
    listed = found.withColumn("_r", F.row_number().over(Window.partitionBy("set").orderBy(F.desc("score"), "member"))).where(F.col("_r") <= top + 1)
    listed = listed.groupBy("set").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "member"))).alias("near"))
    each = tagged.join(sets.select("set", "all"), "all").join(listed, "set").select("id", F.slice(F.filter("near", lambda x: x["member"] != F.col("id")), 1, top).alias("near"))
    out = each.select("id", F.posexplode("near").alias("place", "x"))
    return out.select(F.col("id").alias(ident), F.col("x.member").alias("found"), (-F.col("x.s")).alias("score"), (F.col("place") + 1).alias("rank"))


def _weights_of(rows: pd.DataFrame, tags: np.ndarray, weighed: bool) -> np.ndarray:
    """A line for each set and a column for each of ``tags`` (sorted): the tag's weight, or one, where the set has it."""
    line, tag = np.repeat(np.arange(len(rows)), rows.tags.str.len()), np.concatenate(rows.tags.to_list())
    at = np.minimum(np.searchsorted(tags, tag), len(tags) - 1)
    here = tags[at] == tag
    out = np.zeros((len(rows), len(tags)))
    out[line[here], at[here]] = np.concatenate(rows.weights.to_list())[here] if weighed else 1.0
    return out


def _best_of_cell(asks: pd.DataFrame, has: pd.DataFrame, top: int) -> pd.DataFrame:
    """(a, b, score) of a cell: for each set that asks its ``top`` others; sums of weights are whole numbers, so they are exact."""
    has = has.sort_values("set", ignore_index=True)
    tags = np.intersect1d(np.concatenate(asks.tags.to_list()), np.concatenate(has.tags.to_list()))
    shared = np.zeros((len(asks), len(has)))
    for k in range(0, len(tags), TAGS_AT_ONCE):
        some = tags[k : k + TAGS_AT_ONCE]
        shared += _weights_of(asks, some, True) @ _weights_of(has, some, False).T
    a, b = asks.set.to_numpy(), has.set.to_numpy()
    score = shared / (asks.total.to_numpy()[:, None] + has.total.to_numpy()[None, :] - shared)
    score[a[:, None] == b[None, :]] = -1.0
    best = np.argsort(-score, axis=1, kind="stable")[:, :top]
    out = pd.DataFrame({"a": np.repeat(a, best.shape[1]), "b": b[best.ravel()], "score": np.take_along_axis(score, best, axis=1).ravel()})
    return out[out.score > 0]


def _met(common: DataFrame, asks: DataFrame, sets: DataFrame, top: int) -> DataFrame:
    """(a, b, score): of the sets that ask at a tag (set, tag, n) the ``top`` best of each block of the tag's list, over all of their tags.

    Both lists are cut into blocks that meet in cells, so a tag of any size is no task's work, and a cell gives a few rows a set.
    """
    of = sets.select("set", "total", F.col("all.tag").alias("tags"), F.col("all.w").alias("weights"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(float(BLOCK))).cast("int")
    own = lambda n: F.pmod(F.xxhash64("set"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    sizes = asks.groupBy("tag").agg(F.count("*").alias("m"))
    left = asks.join(sizes, "tag").select("set", "tag", own("m").alias("i"), every("n").alias("j"), F.lit(True).alias("asks"))
    right = common.join(sizes, "tag").select("set", "tag", every("m").alias("i"), own("n").alias("j"), F.lit(False).alias("asks"))

    def best(cell: pd.DataFrame) -> pd.DataFrame:
        asks, has = cell[cell.asks], cell[~cell.asks]
        return _best_of_cell(asks, has, top) if len(asks) and len(has) else pd.DataFrame({"a": [], "b": [], "score": []})

    return left.union(right).join(of, "set").groupBy("tag", "i", "j").applyInPandas(best, "a long, b long, score double")


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Shared weight over united weight of two arrays of (tag, w); 0 if nothing weighs."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, y: s + y["w"])
    union = total(F.array_union(a, b))
    return F.when(union > 0, total(F.array_intersect(a, b)) / union).otherwise(0.0)
