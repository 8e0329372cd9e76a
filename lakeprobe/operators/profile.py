"""Column profiles: kinds of values, missingness, cardinality, moments, quantiles, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeprobe.functions import cells
from lakeprobe.operators import ordering
from lakeprobe.session import saved

QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
KINDS = ("boolean", "integer", "float", "datetime", "string")


def long_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column, value): every cell as normalised text, null where it is missing."""
    cast = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return cast.unpivot([], columns, "column", "raw").select("column", cells.normalize(F.col("raw")).alias("value"))


def long_numbers(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """Rows (*keys, column, value) of numeric columns as doubles."""
    cast = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(list(keys), columns, "column", "value")


def counted(values: DataFrame, *keys: str) -> DataFrame:
    """Rows (*keys, column, value, n): how often each value occurs. What follows works on distinct values."""
    return values.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def quantiles(values: DataFrame, *keys: str) -> DataFrame:
    """The quantiles of each column, interpolated: the ranks that matter are picked from running counts, so no task holds a column."""
    counts = ordering.running(counted(values.filter("value IS NOT NULL"), *keys), [*keys, "column"], "value", ["n"])
    c = F.col
    return counts.groupBy(*keys, "column").agg(*[ordering.quantile(q, c("value"), c("n"), c("before_n"), c("all_n")).alias(name) for name, q in QUANTILES.items()])


def moments(values: DataFrame, *keys: str) -> DataFrame:
    """Count, range, mean, deviation, skew, zeros and negatives of each column."""
    return values.filter("value IS NOT NULL").groupBy(*keys, "column").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.coalesce(F.skewness("value"), F.lit(0.0)).alias("skew"),
        F.count_if(F.col("value") == 0).alias("zeros"), F.count_if(F.col("value") < 0).alias("negatives"),
    )


def numeric(values: DataFrame, *keys: str) -> DataFrame:
    """Fifteen statistics for each column of rows (column, value)."""
    return moments(values, *keys).join(quantiles(values, *keys), [*keys, "column"])


def presence(values: DataFrame) -> DataFrame:
    """Total, present and missing cells and the share missing."""
    got = values.groupBy("column").agg(F.count(F.lit(1)).alias("total"), F.count("value").alias("present"))
    missing = F.col("total") - F.col("present")
    return got.select("column", "total", "present", missing.alias("missing"), F.round(missing / F.col("total"), 6).alias("missing_rate"))


def kinds(values: DataFrame) -> DataFrame:
    """Cells of each kind per column; a value's kind is told once, however often it occurs."""
    each = counted(values.filter("value IS NOT NULL")).withColumn("kind", cells.kind(F.col("value")))
    return each.groupBy("column", "kind").agg(F.sum("n").alias("cells"))


def features_of(counts: DataFrame, *keys: str) -> DataFrame:
    """What roles are told from, a row per column: from rows (*keys, column, value, n, kind), without nulls."""
    v, n = F.col("value"), F.col("n")
    share = lambda x: F.sum(x * n) / F.sum(n)
    return counts.groupBy(*keys, "column").agg(
        F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct"), share(F.length(v)).alias("avg_len"), share(v.contains(" ").cast("int")).alias("space_share"),
        F.bool_and(v.isin("0", "1")).alias("zero_one"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, n)), F.lit(0)).alias(k) for k in KINDS],
    )


def features(values: DataFrame) -> DataFrame:
    """One row per column with what roles are told from; columns without any value have one too."""
    each = counted(values)
    kind = F.when(F.col("value").isNotNull(), cells.kind(F.col("value")))
    got = features_of(each.filter("value IS NOT NULL").withColumn("kind", kind))
    return each.select("column").distinct().join(got, "column", "left").fillna(0, ["present", "distinct", *KINDS]).fillna(False, ["zero_one"])


def table(values: DataFrame) -> DataFrame:
    """The whole profile of a table, a row per column: missing cells, kinds, role, lengths and, for numbers, moments and quantiles.

    Cells are counted once by value, and everything else comes from the counts.
    """
    counts = saved(cells.kinded(counted(values)), "counts")
    n, missing = F.col("n"), F.col("total") - F.col("present")
    there = counts.groupBy("column").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("value").isNotNull(), n).otherwise(0)).alias("present"))
    there = there.select("column", "total", "present", missing.alias("missing"), F.round(missing / F.col("total"), 6).alias("missing_rate"))
    told = features_of(counts.filter("value IS NOT NULL"))
    told = there.select("column").join(told, "column", "left").fillna(0, ["present", "distinct", *KINDS]).fillna(False, ["zero_one"])
    stats = numeric_of(counts.filter("number IS NOT NULL").groupBy("column", F.col("number").alias("value")).agg(F.sum("n").alias("n")))
    return there.join(classify(told).drop("present"), "column").join(stats.withColumnRenamed("n", "numbers"), "column", "left")


def numeric_of(counts: DataFrame) -> DataFrame:
    """numeric() of numbers (column, value, n) that occur n times each: sums over distinct values, deviations around the mean."""
    order, v, n = saved(ordering.running(counts, ["column"], "value", ["n"]), "ranked"), F.col("value"), F.col("n")
    some = order.groupBy("column").agg(
        F.sum(n).alias("of"), F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(v * n) / F.sum(n)).alias("mean"),
        F.sum(F.when(v == 0, n).otherwise(0)).alias("zeros"), F.sum(F.when(v < 0, n).otherwise(0)).alias("negatives"),
        *[ordering.quantile(q, v, n, F.col("before_n"), F.col("all_n")).alias(name) for name, q in QUANTILES.items()],
    ).withColumnRenamed("of", "n")
    away = v - F.col("mean")
    around = order.join(F.broadcast(some.select("column", "mean")), "column").groupBy("column").agg(F.sum(n).alias("of"), F.sum(away * away * n).alias("m2"), F.sum(away * away * away * n).alias("m3"))
    std, skew = F.sqrt(F.col("m2") / F.nullif(F.col("of") - 1, F.lit(0))), F.sqrt("of") * F.col("m3") / F.nullif(F.pow("m2", F.lit(1.5)), F.lit(0.0))
    return some.join(around.select("column", F.coalesce(std, F.lit(0.0)).alias("std"), F.coalesce(skew, F.lit(0.0)).alias("skew")), "column")


def classify(rows: DataFrame) -> DataFrame:
    """The base type, the role and whether kinds are mixed, of each row of features()."""
    n = F.col("present")
    share = lambda *names: sum((F.col(x) for x in names[1:]), F.col(names[0])) / F.nullif(n, F.lit(0))
    base = (
        F.when(n == 0, "empty").when(F.col("zero_one") | (share("boolean") >= 0.99), "boolean").when(share("integer") >= 0.99, "integer")
        .when(share("integer", "float") >= 0.99, "float").when(share("datetime") >= 0.95, "datetime").otherwise("string")
    )
    key = (F.col("distinct") >= F.greatest(F.lit(50), F.floor(n * 0.95))) & (F.col("avg_len") <= 64) & (F.col("space_share") <= 0.2)
    few = F.col("distinct") <= F.least(F.lit(2000), F.greatest(F.lit(25), F.floor(n * 0.2)))
    role = (
        F.when(F.col("base").isin("empty", "boolean", "datetime"), F.col("base")).when(F.col("base").isin("integer", "string") & key, "identifier")
        .when(F.col("base").isin("integer", "float"), F.col("base")).when(few, "categorical").otherwise("text")
    )
    several = sum((F.when(F.col(k) > 0, 1).otherwise(0) for k in KINDS[1:]), F.when(F.col(KINDS[0]) > 0, 1).otherwise(0)) > 1
    mixed = ~F.col("zero_one") & several & (F.greatest(*KINDS) / n < 0.95)
    return rows.withColumn("base", base).withColumn("role", role).withColumn("mixed", F.coalesce(mixed, F.lit(False)))


def top_values(values: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each column, ties by value. Every partition keeps its own first k before any are gathered."""
    counts = counted(values.filter("value IS NOT NULL")).withColumnRenamed("n", "cells")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("cells"), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def lengths(values: DataFrame) -> DataFrame:
    """Lengths of text and the share of cells with a space."""
    n = F.length("value")
    return values.filter("value IS NOT NULL").groupBy("column").agg(
        F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("avg_len"),
        F.round(F.avg(F.contains("value", F.lit(" ")).cast("double")), 6).alias("space_share"),
    )


def rounded(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]
