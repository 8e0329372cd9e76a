"""Session and table helpers shared by every operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "lakeprobe", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested under."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as Spark reads it (never opened locally)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among those that all machines share: below spark.checkpoint.dir or, where it is unset, the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and what follows reads it as often as it likes."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which follows the input on a cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
