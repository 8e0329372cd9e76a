"""Orders over whole columns and tables without gathering one in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeprobe.session import partitions, saved


def buckets(df: DataFrame) -> int:
    """Buckets that an order is divided into: they follow the session's shuffle partitions, and so the input."""
    return max(64, 4 * partitions(df.sparkSession))


def running(rows: DataFrame, by: list[str], key: str, sums: list[str]) -> DataFrame:
    """rows, unique by (by, key), with before_x and all_x for each x of sums: its sum over the rows of the group before this one, and over all.

    Rows are dealt to buckets between sketched quantiles of the key and summed up there;
    what stands in the buckets before is added (one small row for each bucket).
    """
    n, rows = buckets(rows), saved(rows, "ordered")
    cuts = rows.groupBy(*by).agg(F.array_distinct(F.percentile_approx(key, F.lit([i / n for i in range(1, n)]), 20 * n)).alias("cuts"))
    placed = rows.join(F.broadcast(cuts), by).withColumn("bucket", F.size(F.filter("cuts", lambda e: e < F.col(key)))).drop("cuts")
    per = placed.groupBy(*by, "bucket").agg(*[F.sum(x).alias(f"in_{x}") for x in sums])
    group, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*by, "bucket", *[F.coalesce(F.sum(f"in_{x}").over(before), F.lit(0)).alias(f"start_{x}") for x in sums], *[F.sum(f"in_{x}").over(group).alias(f"all_{x}") for x in sums])
    inside = Window.partitionBy(*by, "bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(per), [*by, "bucket"])
    return out.select(*rows.columns, *[(F.col(f"start_{x}") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(f"before_{x}") for x in sums], *[f"all_{x}" for x in sums])


def quantile(q: float, value: Column, n: Column, before: Column, total: Column) -> Column:
    """Aggregate over a group of running(): the interpolated quantile of values that occur n times each; null without values."""
    at = (total - 1) * q
    pick = lambda i: F.max(F.when((before <= i) & (i < before + n), value))
    low, high, part = pick(F.floor(at)), pick(F.ceil(at)), F.max(at - F.floor(at))
    return F.when(low == high, low).otherwise(low * (1 - part) + high * part)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the position of each row (from 0) in the order of a unique numeric key."""
    one = df.withColumn("whole_table", F.lit(0)).withColumn("row_here", F.lit(1))
    return running(one, ["whole_table"], key, ["row_here"]).withColumnRenamed("before_row_here", name).select(*df.columns, name)
