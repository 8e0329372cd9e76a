"""Results of jobs as JSON lines, some of which may be broken: read, counted, streamed.

Files are read as text, which Spark splits by bytes wherever they lie, so a result of any
size is read in parallel. A line that isn't a JSON object is skipped and counted.

Defined results:
* blank lines are neither records nor broken; a limit looks at the first lines that aren't
  blank, broken ones included;
* missing paths and empty files give no rows;
* values of a record that don't fit the schema are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.functions.json_ops import is_json

SCHEMA = "value string"


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def _lines(spark: SparkSession, path: str, limit: int | None) -> DataFrame:
    lines = spark.read.schema(SCHEMA).text(path) if _there(spark, path) else spark.createDataFrame([], SCHEMA)
    lines = lines.select(F.trim("value").alias("line")).filter("line <> ''")
    return lines if limit is None else lines.limit(limit)


def _record(lines: DataFrame) -> DataFrame:
    """Lines with their value as variant; null where a line is no JSON object."""
    v = F.try_parse_json("line")
    return lines.select("line", F.when(F.col("line").startswith("{") & is_json(F.col("line")), v).alias("v"))


def _shaped(rows: DataFrame, schema: str | None) -> DataFrame:
    good = rows.filter("v IS NOT NULL")
    return good.select(F.col("v").alias("record")) if schema is None else good.select(F.from_json("line", schema).alias("r")).select("r.*")


def read(spark: SparkSession, path: str, schema: str | None = None, limit: int | None = None) -> DataFrame:
    """The records of a result: a variant column `record`, or the columns of a schema."""
    return _shaped(_record(_lines(spark, path, limit)), schema)


def stream(spark: SparkSession, path: str, schema: str | None = None, files: int = 16) -> DataFrame:
    """The records of a result that grows by files, as a stream."""
    lines = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).text(path)
    return _shaped(_record(lines.select(F.trim("value").alias("line")).filter("line <> ''")), schema)


def count(spark: SparkSession, path: str) -> int:
    """Lines that aren't blank."""
    return _lines(spark, path, None).count()


def told(rows: DataFrame) -> DataFrame:
    """Of lines (line): how many there are, how many are records, how many were skipped. One row."""
    return _record(rows).agg(F.count(F.lit(1)).alias("lines"), F.count("v").alias("records"), F.count_if(F.col("v").isNull()).alias("skipped"))


def quality(spark: SparkSession, path: str) -> DataFrame:
    """What reading a result gives: lines, records, skipped."""
    return told(_lines(spark, path, None))


def keys(records: DataFrame) -> DataFrame:
    """Rows (key, records): how many records have each key."""
    return records.select(F.explode(F.json_object_keys(F.to_json("record"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("records"))
