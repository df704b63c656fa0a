"""Structured Streaming forms of the period, stay and visit questions, with bounded state by watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.sources.files import scratch


def stream(spark: SparkSession, folder: str, table: str = "events") -> DataFrame:
    """A table's file as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def windowed(rows: DataFrame, at: str, late: str, window: Column, keys: list[str]) -> DataFrame:
    """Counts by event-time window; rows later than ``late`` behind the watermark are left out, and in update or append mode (see
    ``settled``) the state of windows before it is dropped."""
    counts = timed(rows, at).withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(*[F.col(f"w.{k}").cast("timestamp_ntz").alias(k) for k in ("start", "end")], *keys, "n")


def timed(rows: DataFrame, at: str) -> DataFrame:
    """Event time with a zone (the session's), which watermarks ask for."""
    return rows.withColumn(at, F.col(at).cast("timestamp"))


def tumbling(rows: DataFrame, at: str, size: str, late: str, keys: list[str]) -> DataFrame:
    return windowed(rows, at, late, F.window(at, size), keys)


def sliding(rows: DataFrame, at: str, size: str, step: str, late: str, keys: list[str]) -> DataFrame:
    return windowed(rows, at, late, F.window(at, size, step), keys)


def settled(result: DataFrame, name: str, mode: str = "complete", key: list[str] | None = None) -> DataFrame:
    """All that is available now, run to its end, as a table of its own; a rerun goes on from the stream's checkpoint.

    In update mode each micro-batch's rows are written on their own, and of each ``key`` the row of the last batch counts.
    """
    spark = result.sparkSession
    place = scratch(spark)
    if mode == "append":
        run = result.writeStream.outputMode("append").format("parquet").option("path", f"{place}/{name}").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(result.schema).parquet(f"{place}/{name}")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/{name}/_batch={number}" if mode == "update" else f"{place}/{name}")

    run = result.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    if mode != "update":
        return spark.read.schema(result.schema).parquet(f"{place}/{name}")
    found = spark.read.schema(f"{result.schema.toDDL()}, `_batch` int").parquet(f"{place}/{name}")
    rest = [c for c in result.columns if c not in key]
    return found.groupBy(*key).agg(*[F.max_by(c, "_batch").alias(c) for c in rest]).select(*result.columns)
