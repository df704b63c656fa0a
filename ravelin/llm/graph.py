"""Connected components over links, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.store import written


def components(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id of ``links`` (a long, b long) reaches.

    Alternates large-star and small-star steps until the links are stars around the smallest ids. Neighbour minima are
    map-side-combined aggregates, and the joins with them read written tables on both sides, so that AQE splits a hub with a
    third of all links instead of gathering it. Nulls and self-links are ignored, repeated links count once, and no links
    give no rows.
    """
    edges = written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links")
    while True:
        # large star: every neighbour above v joins the smallest of v and its neighbours
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = written(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), "least")
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        # small star: v and its neighbours below it join the smallest of those; v has few neighbours left by now
        large = written(large, "large")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(low.select("v", F.col("m").alias("u")))
        edges = written(small.distinct(), "links")
        # stars: no smallest end is itself below another id
        if edges.select(F.col("u").alias("v")).distinct().join(edges, "v", "left_semi").isEmpty():
            return edges.select(F.col("v").alias("id"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("id"), F.col("u").alias("root"))).distinct()
