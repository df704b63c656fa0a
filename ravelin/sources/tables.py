"""The tables of a folder, and the record views that questions are asked of."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions.scalars import age, bucket


class Tables:
    """Tables by attribute, read lazily: ``Tables(spark, folder).lineitem``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def records(self) -> DataFrame:
        """Order lines with their order, period (shipping month), cohort (order month) and age in months."""
        rows = self.lineitem.join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        rows = rows.withColumn("period", bucket(F.col("l_shipdate"), "month")).withColumn("cohort", bucket(F.col("o_orderdate"), "month"))
        return rows.withColumn("age", age(F.col("cohort"), F.col("period"), "month"))

    @cached_property
    def tree(self) -> DataFrame:
        """Edges (parent, child) of regions, nations and customers; ids are text."""
        top = self.nation.select(F.concat(F.lit("r:"), "n_regionkey").alias("parent"), F.concat(F.lit("n:"), "n_nationkey").alias("child"))
        return top.union(self.customer.select(F.concat(F.lit("n:"), "c_nationkey"), F.concat(F.lit("c:"), "c_custkey")))

    @cached_property
    def bom(self) -> DataFrame:
        """Edges (parent, child, qty): a part belongs to the part with a third of its number."""
        rows = self.part.where("p_partkey > 0")
        return rows.select(F.expr("p_partkey div 3").alias("parent"), F.col("p_partkey").alias("child"), (F.lit(1) + F.col("p_size") % 4).cast("long").alias("qty"))

    @cached_property
    def dag(self) -> DataFrame:
        """The parts' edges and those of every seventh part to the part with a fifth of its number."""
        more = self.part.where("p_partkey % 7 = 0 and p_partkey > 0").select(F.expr("p_partkey div 5").alias("parent"), F.col("p_partkey").alias("child"), F.lit(1).cast("long").alias("qty"))
        return self.bom.union(more).dropDuplicates(["parent", "child"])

    @cached_property
    def schema(self):
        """The tables with their keys, references and relations, for column addresses."""
        from ravelin.operators.paths import Relation, Schema

        names = {"order": "orders", "customer": "customer", "nation": "nation", "region": "region", "part": "part", "supplier": "supplier"}
        lines = Relation(lambda: self.lineitem, "l_orderkey", "l_partkey", "order", "part")
        supply = Relation(lambda: self.lineitem.select("l_orderkey", "l_suppkey").distinct(), "l_orderkey", "l_suppkey", "order", "supplier")
        return Schema(
            {k: lambda v=v: getattr(self, v) for k, v in names.items()},
            {"order": "o_orderkey", "customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey", "supplier": "s_suppkey"},
            {("order", "o_custkey"): "customer", ("customer", "c_nationkey"): "nation", ("nation", "n_regionkey"): "region", ("supplier", "s_nationkey"): "nation"},
            {"lines": lines, "supply": supply},
        )
