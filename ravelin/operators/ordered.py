"""Places and running sums in a total order without gathering all rows in one task.

Rows are dealt in sorted pieces by range; places and sums are made within each piece, and each piece begins where the ones before it
end. Only one row for each piece is brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ravelin.operators.graphs import _cut


def placed(rows: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, least: dict[str, Column] | None = None, name: str = "rank") -> DataFrame:
    """``rows`` with their place in the order (from 1), running sums up to the row, and for ``least`` the smallest value from the row on.

    The order must be total; values from the row on of ``least`` may use the place by its name.
    """
    sums, least = sums or {}, least or {}
    dealt = rows.repartitionByRange(*order).withColumn("_piece", F.spark_partition_id())
    dealt = _cut(dealt.withColumns({f"_s_{k}": v for k, v in sums.items()}))
    own = Window.partitionBy("_piece").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each piece
    pieces = dealt.groupBy("_piece").agg(F.count("*").alias("_n"), *[F.sum(f"_s_{k}").alias(f"_t_{k}") for k in sums])
    pieces = pieces.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_t0_{k}") for k in sums])
    out = dealt.withColumn(name, F.row_number().over(own)).withColumns({k: F.sum(f"_s_{k}").over(upto) for k in sums}).join(pieces, "_piece")
    out = out.withColumn(name, F.col(name) + F.col("_n0")).withColumns({k: F.col(k) + F.col(f"_t0_{k}") for k in sums})
    if least:
        out = _cut(out.withColumns({f"_l_{k}": v for k, v in least.items()}))
        after = Window.orderBy("_piece").rowsBetween(1, Window.unboundedFollowing)
        later = out.groupBy("_piece").agg(*[F.min(f"_l_{k}").alias(f"_m_{k}") for k in least])
        later = later.select("_piece", *[F.min(f"_m_{k}").over(after).alias(f"_m0_{k}") for k in least])
        # backwards, as a frame that runs to the end is read anew for each row
        rest = Window.partitionBy("_piece").orderBy(F.desc(name)).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({k: F.min(f"_l_{k}").over(rest) for k in least}).join(later, "_piece")
        out = out.withColumns({k: F.least(k, f"_m0_{k}") for k in least})
    return out.select(*rows.columns, name, *sums, *least)


def with_totals(rows: DataFrame, **totals: Column) -> DataFrame:
    """``rows`` with totals over all of them: an aggregate of one row, joined to each."""
    return rows.crossJoin(F.broadcast(rows.agg(*[v.alias(k) for k, v in totals.items()])))
