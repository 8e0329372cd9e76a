"""Cells of untyped tables: missing tokens, numbers, dates, booleans, and the kind of a value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The texts that mean a missing cell (compared in lower case, after trimming).
MISSING = ("", "-", "na", "n/a", "#n/a", "nan", "none", "null", "nil", "\\n", "undefined")
#: The texts read as booleans.
TRUE = ("true", "yes", "y", "1", "t", "да", "истина")
FALSE = ("false", "no", "n", "0", "f", "нет", "ложь")
#: Date formats in the order they are tried, after ISO 8601.
DATES = ("yyyy-M-d", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "d.M.yyyy H:m", "d.M.yyyy H:m:s", "yyyyMMdd")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def normalize(c: Column) -> Column:
    """Trimmed text, or null for a missing token."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(F.lower(t).isin(*MISSING), None).otherwise(t)


def number_text(c: Column) -> Column:
    """Spaces out; a comma is a decimal point where there is no point."""
    t = F.regexp_replace(c, r"(?U)\s", "")
    return F.when(~t.contains("."), F.replace(t, F.lit(","), F.lit("."))).otherwise(t)


def number(c: Column) -> Column:
    """The number a cell holds, or null; infinities are not numbers."""
    t = number_text(c)
    x = F.when(t.rlike(NUMBER), t.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)


def is_integer(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s", "").rlike(r"^[+-]?\d+$")


def boolean(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False)


def looks_like_date(c: Column) -> Column:
    """Cheap test before parsing: 6 to 40 characters, a digit first, digits only or one of - / ."""
    return F.length(c).between(6, 40) & c.rlike(r"^\d") & (c.rlike(r"^\d+$") | c.rlike(r"[-/.]"))


ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?)?"
OFFSET = r"(Z|z|[+-]\d{2}:?\d{2})$"


def date(c: Column) -> Column:
    """ISO 8601 first, then the formats in order; the first that fits wins. Times with an offset are turned to UTC."""
    # without the minus of a date: an offset stands behind a time only
    local = F.regexp_replace(F.regexp_replace(c, r"(:\d{2}(?:[.,]\d{1,6})?)(?:[Zz]|[+-]\d{2}:?\d{2})$", "$1"), ",", ".").try_cast("timestamp_ntz")
    sign = F.regexp_extract(c, r":\d{2}(?:[.,]\d{1,6})?([+-])\d{2}:?\d{2}$", 1)
    hours, minutes = (F.regexp_extract(c, r":\d{2}(?:[.,]\d{1,6})?[+-](\d{2}):?(\d{2})$", i).try_cast("int") for i in (1, 2))
    ahead = F.coalesce(F.when(sign == "-", -1).otherwise(1) * (hours * 60 + minutes), F.lit(0))
    iso = F.when(c.rlike(ISO + "$") | c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?" + OFFSET), local - F.make_dt_interval(mins=ahead))
    parsed = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in DATES]
    return F.when(looks_like_date(c), F.coalesce(iso, *parsed))


def kinded(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with number, moment and kind of a text column: each is told once, and dates only of what is neither a number nor a boolean."""
    v = F.col(value)
    rows = rows.withColumn("number", number(v))
    rows = rows.withColumn("moment", F.when(F.col("number").isNull() & boolean(v).isNull(), date(v)))
    told = F.when(F.col("number").isNotNull(), F.when(is_integer(v), "integer").otherwise("float")).when(boolean(v).isNotNull(), "boolean").when(F.col("moment").isNotNull(), "datetime").otherwise("string")
    return rows.withColumn("kind", F.when(v.isNotNull(), told))


def kind(c: Column) -> Column:
    """number, then boolean, then datetime, then string; numbers are integer or float."""
    return F.when(number(c).isNotNull(), F.when(is_integer(c), "integer").otherwise("float")).when(boolean(c).isNotNull(), "boolean").when(date(c).isNotNull(), "datetime").otherwise("string")
