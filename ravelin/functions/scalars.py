"""Column builders for the engine's value rules: missing values, guarded readings, periods, text keys.

All are built-in expressions, so they stay inside whole-stage code generation and are pushed to the scan where that is possible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")
#: The only texts that count as numbers, and the words that count as true.
NUMBER, TRUE_WORDS = r"^-?[0-9]+(\.[0-9]+)?$", ("true", "t", "yes", "y", "1", "on")


def missing(c: Column) -> Column:
    """Null, "" and the text null count as missing."""
    return c.isNull() | c.cast("string").isin("", "null")


def folded(c: Column) -> Column:
    """Grouping key: "" is the same bucket as null."""
    return F.nullif(c, F.lit(""))


def numeric(c: Column) -> Column:
    """A number written plainly, or null: no exponent, no sign but minus, no blanks."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def guarded_date(c: Column) -> Column:
    """Date of a text that begins with one in either notation, with dashes or without; null for others and for days that don't exist."""
    dashed, plain = (F.regexp_extract(c, f"^({p})", 1) for p in ("[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{8}"))
    return F.coalesce(F.try_to_date(dashed, "yyyy-MM-dd"), F.try_to_date(plain, "yyyyMMdd"))


def date_or_null(c: Column, kind: str) -> Column:
    """A date of any column: dates and times as they are, texts as ``guarded_date`` reads them."""
    return F.to_date(c) if kind.startswith(("date", "timestamp")) else guarded_date(c.cast("string"))


def free_datetime(c: Column) -> Column:
    """Time of a text: a date in any notation alone (midnight) or with a clock behind T or a blank; a text with a zone has none."""
    text = F.trim(c)
    parts = [F.regexp_extract(text, r"^([^ T]+)[ T]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.][0-9]+)?)?$", k) for k in (1, 2, 3, 4)]
    day, hour, minute, second = free_date(parts[0]), *(F.when(p == "", "0").otherwise(p).cast("int") for p in parts[1:])
    good = day.isNotNull() & (parts[1] != "") & (hour < 24) & (minute < 60) & (second < 60)
    at = F.when(good, F.to_timestamp_ntz(F.concat(day.cast("string"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.lit(":"), F.lpad(second.cast("string"), 2, "0")), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(at, F.when(~text.contains(":"), free_date(text).cast("timestamp_ntz")))


def free_date(c: Column) -> Column:
    """Date with -, . or / between its parts and one- or two-digit months and days; a month alone is its first day."""
    parts = F.split(F.regexp_replace(F.trim(c), r"[./]", "-"), "-")
    padded = F.concat_ws("-", F.element_at(parts, 1), F.lpad(F.try_element_at(parts, F.lit(2)), 2, "0"), F.lpad(F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("1")), 2, "0"))
    return F.coalesce(guarded_date(c), F.when(F.trim(c).rlike(r"^[0-9]{4}[-./][0-9]{1,2}([-./][0-9]{1,2})?$"), F.try_to_date(padded, "yyyy-MM-dd")))


def truth(c: Column) -> Column:
    return F.when(missing(c), None).otherwise(F.lower(F.trim(c)).isin(*TRUE_WORDS))


def bucket(c: Column, grain: str) -> Column:
    """First day of the period that holds a date; weeks begin on Monday."""
    return F.to_date(c) if grain == "day" else F.to_date(F.date_trunc(grain, c))


def shifted(c: Column, grain: str, n) -> Column:
    """The period start ``n`` periods later."""
    n = n if isinstance(n, Column) else F.lit(n)
    months = {"month": 1, "quarter": 3, "year": 12}
    return F.add_months(c, (n * months[grain]).cast("int")) if grain in months else F.date_add(c, (n * (7 if grain == "week" else 1)).cast("int"))


def age(start: Column, end: Column, grain: str) -> Column:
    """Calendar difference of two period starts in periods; it may be negative."""
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    if grain in ("day", "week"):
        return F.floor(F.datediff(end, start) / (7 if grain == "week" else 1)).cast("int")
    return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[grain]).cast("int")


def period_label(c: Column, grain: str) -> Column:
    if grain == "week":
        return F.concat(F.year(F.date_add(F.to_date(F.date_trunc("week", c)), 3)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))
    if grain == "quarter":
        return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))
    return F.date_format(c, {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[grain])


def is_closed(period: Column, grain: str, watermark: Column, settle_days: int) -> Column:
    """A period is closed when the next one has begun before the watermark less the days of settling."""
    return shifted(period, grain, 1) <= F.date_sub(watermark, settle_days)


def bigrams(c: Column) -> Column:
    """Distinct two-letter pieces in lower case; shorter texts have none."""
    low = F.lower(c)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 1, F.lit(1))), lambda i: F.substr(low, i, F.lit(2)))
    return F.when(F.length(low) >= 2, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def mask(c: Column) -> Column:
    """Shape of a value: capital letters A, small letters a, digits 9."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")


def map_hash(c: Column) -> Column:
    """A place between 0 and 1 from the first 8 hexadecimal digits of the md5 of a key."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def rung(c: Column, steps: list[tuple[float, str]], below: str) -> Column:
    """Label of the highest step that a value reaches."""
    out = F.lit(below)
    for at, label in sorted(steps):
        out = F.when(c >= at, F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)


def required(c: Column) -> Column:
    return F.when(missing(c), "required")


def in_range(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """A value outside of the bounds; a missing one isn't."""
    out = F.lit(False)
    if low is not None:
        out = out | (c < low)
    if high is not None:
        out = out | (c > high)
    return F.when(out, "range")


def decimals(c: Column, most: int) -> Column:
    """A decimal number with more places behind the point than ``most``, zeros at its end aside."""
    return F.when(F.length(F.regexp_extract(c.cast("string"), r"[.]([0-9]*?)0*$", 1)) > most, "decimals")


def shaped(c: Column, pattern: str) -> Column:
    return F.when(~c.rlike(f"^(?:{pattern})$"), "pattern")


def one_of(c: Column, options: list[str]) -> Column:
    return F.when(~c.isin(*options), "enum")
