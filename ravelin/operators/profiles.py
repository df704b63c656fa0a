"""Profiles of tables: kinds of columns, shapes of values, keys, and how values of two columns go together."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.scalars import free_datetime, guarded_date, mask, missing

#: Options of a choice field at most, their share of the values at most, rows that a table must have for one, and letters of a short text.
MOST_OPTIONS, MOST_SHARE, LEAST_ROWS, LONG_TEXT = 12, 0.3, 20, 200
#: Words by which a column is taken for yes or no. They are fewer than those that a value may be read by: a column of 0 and 1
#: is one of numbers.
YES_NO = ("true", "yes", "y", "예", "참", "false", "no", "n", "아니오", "거짓")


def text_of(rows: DataFrame, name: str) -> Column:
    """A column as the text that a source would send."""
    return F.col(name).cast("string")


def kinds(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, kind, filled, blank, distinct, decimals): the narrowest kind that all values of a column fit.

    bool, number, date, datetime, url, enum (few options that repeat), long text, else text; a column without a value is text. Values are
    counted by column first, so patterns are tried once for each distinct value.
    """
    columns = columns or rows.columns
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(name).alias("column"), F.trim(text_of(rows, name)).alias("v")) for name in columns])).alias("c")).select("c.*")
    values = cells.select("column", F.when(~missing(F.col("v")), F.col("v")).alias("v")).groupBy("column", "v").agg(F.count("*").alias("n"))
    v = F.col("v")
    number = v.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})*([.][0-9]+)?$") | v.rlike(r"^-?[0-9]+([.][0-9]+)?$") | v.rlike(r"^-?[0-9]+([.][0-9]+)?E-?[0-9]+$")
    day = v.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & guarded_date(v).isNotNull()
    fits = {"bool": F.lower(v).isin(*YES_NO), "number": number, "date": day, "datetime": free_datetime(v).isNotNull(), "url": v.rlike(r"^(?i)https?://\S+$")}
    here = v.isNotNull()
    one = values.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias("filled"),
        F.count("v").alias("distinct"),
        F.max(F.length("v")).alias("longest"),
        F.max(F.length(F.regexp_extract("v", r"[.]([0-9]+)$", 1))).alias("decimals"),
        *[F.bool_and(F.when(here, F.coalesce(f, F.lit(False)))).alias(n) for n, f in fits.items()],
    )
    kind = F.when(F.col("filled") == 0, "text")
    for name in fits:
        kind = kind.when(F.col(name), name)
    few = (F.col("rows") >= LEAST_ROWS) & (F.col("distinct") <= MOST_OPTIONS) & (F.col("distinct") <= MOST_SHARE * F.col("filled"))
    kind = kind.when(few, "enum").when(F.col("longest") > LONG_TEXT, "text_long").otherwise("text")
    return one.select("column", kind.alias("kind"), "filled", (F.col("rows") - F.col("filled")).alias("blank"), "distinct", F.when(kind == "number", F.coalesce("decimals", F.lit(0))).otherwise(0).cast("long").alias("decimals"))


def shapes(rows: DataFrame, columns: list[str], top: int = 3) -> DataFrame:
    """(column, shape, n, rank): the most frequent shapes of the values of each column (letters A and a, digits 9)."""
    from pyspark.sql.window import Window

    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text_of(rows, c).alias("v")) for c in columns])).alias("c")).select("c.*").where(~missing(F.col("v")))
    by = cells.groupBy("column", mask(F.col("v")).alias("shape")).agg(F.count("*").alias("n"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "shape"))).where(F.col("rank") <= top)


def fanout(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, a_max, b_max, kind): of every two columns, how many values of one a value of the other has at most, and 1:1, 1:N, N:1 or N:M.

    Each pair is counted from its distinct value pairs, by sums that combine before the shuffle.
    """
    out = None
    for a, b in combinations(columns, 2):
        pairs = rows.select(text_of(rows, a).alias("x"), text_of(rows, b).alias("y")).where(~missing(F.col("x")) & ~missing(F.col("y"))).distinct()
        most = lambda key: pairs.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("m"))
        one = most("x").withColumnRenamed("m", "a_max").crossJoin(most("y").withColumnRenamed("m", "b_max")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "a_max", "b_max")
        out = one if out is None else out.union(one)
    kind = F.concat(F.when(F.col("b_max") > 1, "N").otherwise("1"), F.lit(":"), F.when(F.col("a_max") > 1, F.when(F.col("b_max") > 1, "M").otherwise("N")).otherwise("1"))
    return out.withColumn("kind", kind)


def unique_keys(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(key): single columns, else pairs, whose values are never blank and never repeat."""
    filled = {c: ~missing(text_of(rows, c)) for c in columns}
    one = rows.agg(F.count("*").alias("n"), *[F.count_if(f).alias(f"f_{c}") for c, f in filled.items()], *[F.count_distinct(c).alias(f"d_{c}") for c in columns]).first()
    single = [c for c in columns if one[f"f_{c}"] == one[f"d_{c}"] == one["n"]]
    if single:
        return rows.sparkSession.createDataFrame([(c,) for c in single], "key string")
    pairs = [(a, b) for a, b in combinations([c for c in columns if one[f"f_{c}"] == one["n"]], 2)]
    if not pairs:
        return rows.sparkSession.createDataFrame([], "key string")
    found = rows.agg(*[F.count_distinct(a, b).alias(f"{a}+{b}") for a, b in pairs]).first()
    return rows.sparkSession.createDataFrame([(f"{a}+{b}",) for a, b in pairs if found[f"{a}+{b}"] == one["n"]], "key string")


def overlap(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """One row: distinct values of a column, and how many of them are keys of another table."""
    own = rows.select(text_of(rows, column).alias("v")).where(~missing(F.col("v"))).distinct()
    known = keys.select(F.col(key).cast("string").alias("v"), F.lit(1).alias("hit")).distinct()
    return own.join(known, "v", "left").agg(F.lit(column).alias("column"), F.count("*").alias("values"), F.count("hit").alias("hits"))

