"""Reports: findings as text, and a store of reports as JSON files with eviction."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Severities, gravest first.
ORDER = ("alert", "warn", "info")


def render(found: DataFrame, columns: DataFrame) -> str:
    """A report as text: the verdict, the columns by psi, and the findings by severity. Both tables have a few rows per column of the compared data."""
    rows = sorted(found.collect(), key=lambda r: (ORDER.index(r["severity"]), r["column"], r["code"]))
    n = {s: sum(r["severity"] == s for r in rows) for s in ORDER}
    lines = ["Drift report", f"{n['alert']} alerts, {n['warn']} warnings, {n['info']} notes", ""]
    for r in columns.filter("psi IS NOT NULL").orderBy(F.desc("psi"), "column").collect():
        lines.append(f"{r['column']}: PSI {r['psi']:.4f}")
    for group, title in (("schema", "Schema"), ("missing", "Missing cells"), ("quality", "Quality"), ("distribution", "Numbers"), ("category", "Categories"), ("cardinality", "Cardinality"), ("datetime", "Periods"), ("leakage", "Identifiers")):
        own = [r for r in rows if r["code"].startswith(f"{group}.")]
        lines += ["", title, *(f"[{r['severity']}] {r['column']}: {r['code']}" for r in own)] if own else []
    return "\n".join(lines)


def save(found: DataFrame, store: str, title: str) -> str:
    """Write findings under the store, each part where it is; returns the report's id."""
    report = uuid.uuid4().hex
    found.select(F.lit(report).alias("report"), F.lit(title).alias("title"), F.current_timestamp().alias("saved"), "column", "code", "severity").write.mode("append").json(f"{store}/report_id={report}")
    return report


def _ranked(spark: SparkSession, store: str) -> DataFrame:
    """Each report with its age rank; a store has a row for each report here."""
    rows = spark.read.json(store).groupBy("report", "title").agg(F.max(F.to_timestamp("saved")).alias("saved"), F.count(F.lit(1)).alias("findings"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("saved"), "report")))


def _kept(limit: int, hours: float):
    return (F.col("saved") >= F.current_timestamp() - F.make_dt_interval(hours=F.lit(int(hours)))) & (F.col("rank") <= limit)


def listing(spark: SparkSession, store: str, limit: int = 100, hours: float = 72) -> DataFrame:
    """Reports that are kept: the newest `limit` of those not older than `hours`, newest first."""
    return _ranked(spark, store).filter(_kept(limit, hours)).orderBy("rank")


def delete(spark: SparkSession, store: str, report: str) -> None:
    """Delete a report's folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/report_id={report}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def evict(spark: SparkSession, store: str, limit: int = 100, hours: float = 72) -> list[str]:
    """Delete the reports that listing() leaves out; returns their ids."""
    gone = [r["report"] for r in _ranked(spark, store).filter(~_kept(limit, hours)).select("report").collect()]
    for report in gone:
        delete(spark, store, report)
    return gone
