"""Reading and writing tables in other formats, and what has changed since the last read."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, below ``spark.checkpoint.dir``. Only a local session, as in tests, may do without the
    setting; on a cluster a machine's own folder would lose what executors write, so there it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base if '://' in base else 'file://' + os.path.abspath(base)}/ravelin-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written to a folder of its own and read from there, for what is used several times."""
    place = scratch(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def read_file(spark: SparkSession, path: str, fmt: str, schema: str, **options) -> DataFrame:
    """A csv, tsv or json table with a given schema (none is inferred from the data); unreadable cells are null."""
    if fmt == "json":
        return spark.read.schema(schema).options(**options).json(path)
    return spark.read.schema(schema).options(header=True, sep="\t" if fmt == "tsv" else ",", mode="PERMISSIVE", escape='"', **options).csv(path)


def write_file(df: DataFrame, path: str, fmt: str) -> None:
    """One file for each partition; consumers read the folder."""
    if fmt == "json":
        df.write.json(path)
    else:
        df.write.options(header=True, sep="\t" if fmt == "tsv" else ",", escape='"').csv(path)


def there_and_back(df: DataFrame, fmt: str) -> DataFrame:
    """The table written in a format and read again."""
    path = scratch(df.sparkSession)
    write_file(df, path, fmt)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return read_file(df.sparkSession, path, fmt, schema)


def changed_since(rows: DataFrame, at: str, since, overlap_minutes: int = 0) -> DataFrame:
    """Rows after a watermark less an overlap; the filter reaches the scan."""
    start = F.lit(since).cast("timestamp") - F.expr(f"interval {overlap_minutes} minutes")
    return rows.where(F.col(at) > start)


def keyset_pages(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """``rows`` with the number of their page in the order of a unique key; a reader goes on behind the last key it has seen.

    Places are made in range pieces, so no task gets all rows, and no page is read by an offset.
    """
    from ravelin.operators.ordered import placed

    return placed(rows, [F.asc(k) for k in key], name="_place").withColumn("page", F.expr(f"(_place - 1) div {size} + 1")).drop("_place")


def page_behind(rows: DataFrame, key: list[str], cursor: tuple | None, size: int) -> tuple[DataFrame, tuple | None]:
    """(page, cursor): the first ``size`` rows behind a cursor in the order of a unique key, and the cursor behind them (none if no row is left).

    The cursor is the last key that was read, so what comes in before it isn't seen and what comes in behind it is; the filter on its first
    column reaches the scan, each task keeps ``size`` rows, and only the last key comes to the driver.
    """
    behind = F.lit(True)
    if cursor is not None:
        at = [F.lit(x).cast(rows.schema[k].dataType) for k, x in zip(key, cursor, strict=True)]
        behind = (F.col(key[0]) >= at[0]) & (F.struct(*key) > F.struct(*[x.alias(k) for k, x in zip(key, at)]))
    page = rows.where(behind).orderBy(*key).limit(size)
    last = page.agg(F.max(F.struct(*key)).alias("last")).first()["last"]
    return page, cursor if last is None else tuple(last)


def drift(known: DataFrame, now: DataFrame) -> list[tuple[str, str]]:
    """(column, missing | new | retyped), from schemas only."""
    a, b = dict(known.dtypes), dict(now.dtypes)
    found = [(k, "missing") for k in a if k not in b] + [(k, "new") for k in b if k not in a]
    return sorted(found + [(k, "retyped") for k in a if k in b and a[k] != b[k]])


def updated(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the values of ``changes`` where it has the key."""
    new = changes.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    own = old.join(new, F.col(key) == F.col("_k"), "left")
    return own.select(*[F.coalesce(f"_{c}", c).alias(c) if c in changes.columns and c != key else F.col(c) for c in old.columns])


def triples(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """(s, p, o): every filled property of every row as a triple, by one explode."""
    fields = [c for c in rows.columns if c != key]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in fields])).alias("x")
    return rows.select(F.concat(F.lit(f"{kind}/"), F.col(key).cast("string")).alias("s"), pairs).select("s", "x.p", "x.o").where("o is not null")


def _literal(c):
    quoted = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(quoted, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'))


def write_ntriples(rows: DataFrame, path: str) -> None:
    """(s, p, o) as lines of text, one for each triple; objects are literals."""
    rows.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), _literal(F.col("o")), F.lit(" .")).alias("value")).write.text(path)


def schema_triples(rows: DataFrame, kind: str, references: dict[str, str]) -> DataFrame:
    """(value): what a table defines, as lines: its class, and of each column the domain and range, from its schema only."""
    names = {"int": "integer", "bigint": "integer", "double": "decimal", "string": "string", "date": "date", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "boolean": "boolean"}
    lines = [f"<{kind}> <type> <Class> ."]
    for column, dtype in rows.dtypes:
        lines += [f"<{kind}/{column}> <domain> <{kind}> .", f"<{kind}/{column}> <range> <{references.get(column, names.get(dtype, dtype))}> ."]
        if column in references:
            lines.append(f"<{kind}/{column}> <type> <ObjectProperty> .")
    return rows.sparkSession.createDataFrame([(x,) for x in lines], "value string")


def row_drift(rows: DataFrame, column: str, declared: list[str]) -> DataFrame:
    """(column, kind, n): keys that rows of JSON objects have and the definition doesn't (new), the other way round (missing), and declared
    ones that only some rows have (sparse), with the number of rows that have them."""
    spark = rows.sparkSession
    met = rows.select(F.explode(F.array_distinct(F.json_object_keys(column))).alias("column")).groupBy("column").agg(F.count("*").alias("n"))
    known = spark.createDataFrame([(x,) for x in declared], "_known string")
    both = known.join(met, F.col("_known") == F.col("column"), "full_outer").crossJoin(F.broadcast(rows.agg(F.count("*").alias("_all"))))
    kind = F.when(F.col("_known").isNull(), "new").when(F.col("n").isNull(), "missing").when(F.col("n") < F.col("_all"), "sparse")
    return both.select(F.coalesce("column", "_known").alias("column"), kind.alias("kind"), F.coalesce("n", F.lit(0)).alias("n")).where("kind is not null")
