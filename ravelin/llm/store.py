"""Shared storage of a run: cut lineage with written tables, and open files wherever the checkpoint folder is."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new, unique folder below ``spark.checkpoint.dir``. Only a local session, as in tests, may do without the setting; on a cluster
    a machine's own folder would lose what executors write, so there it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = "file://" + os.path.abspath(base)
    return posixpath.join(_run.get() or base, "ravelin-" + uuid.uuid4().hex)


_run: ContextVar[str | None] = ContextVar("run", default=None)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[str]:
    """All that is written in the block lies in one folder, which is deleted at its end; so what is wanted must be written elsewhere, or
    collected, within it. Without such a block intermediate tables stay, as results are lazy and read from them."""
    folder = shared_dir(spark)
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, parts: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a durable cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = posixpath.join(shared_dir(spark), name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; used inside tasks, so any shared store that pyarrow knows can hold the files."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Bits of the pre-filter of ids; a documented, fixed size (1 MiB) whatever the input is.
BITMAP_BITS = 1 << 23


def slot(column: str):
    """Column: the bit of an id in a bitmap made by ``id_bitmap``."""
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(BITMAP_BITS))


def id_bitmap(ids: DataFrame, column: str) -> bytes:
    """A bitmap of BITMAP_BITS bits in which the bit of every id is set.

    Built with Spark's bitmap aggregates: the driver receives at most 256 rows of 4 KiB, whatever the size of the input.
    A full bitmap filters nothing, so it must only ever be a pre-filter before an exact join.
    """
    rows = (
        ids.select(slot(column).alias("slot"))
        .groupBy(F.expr("slot div 32768").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits"))
        .collect()
    )
    out = bytearray(BITMAP_BITS // 8)
    for r in rows:
        out[r.bucket * 4096 : (r.bucket + 1) * 4096] = r.bits
    return bytes(out)


def in_bitmap(slots, bitmap: bytes):
    """Which slots (numpy integers) are set in the bitmap? Never false for a member."""
    import numpy as np

    return (np.frombuffer(bitmap, np.uint8)[slots >> 3] >> (slots & 7)) & 1 == 1
