"""Resumable collection jobs as Structured Streaming: one step is one micro-batch, the checkpoint is the cursor.

Pages arrive as files; extraction is appended to a sink, and aggregates are kept as
partial sums per batch that add up (batches are written under their own number, so one
that is repeated after a failure replaces itself).
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.operators import security
from lakeprobe.session import shared_dir


def stream(spark: SparkSession, sf_dir: str, name: str, files: int = 4) -> DataFrame:
    """A table's files as a stream, a few of them per step."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a pattern, since a table may be one file or a folder of them
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/{name}.parque[t]")


def collect(rows: DataFrame, name: str) -> DataFrame:
    """Append a stream to a sink until what is there is read; the sink as a table."""
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    job = rows.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/cursor").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")


def accumulate(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of a stream counted by keys: partial counts of each batch, added up."""
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def step(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{base}/counts/batch={number}")

    job = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/cursor").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{base}/counts").groupBy(*keys).agg(F.sum("n").alias("n"))


def audit(pages: DataFrame, name: str = "audit") -> DataFrame:
    """The security rules run over a stream of responses (page_id, site, url, html, headers, cookies): pages affected by site and finding.

    Each batch's findings are counted by page and written under the batch's number; a
    page that comes again in another batch is counted once.
    """
    spark = pages.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def step(batch: DataFrame, number: int) -> None:
        security.findings(batch).select("site", "finding", "severity", "page_id").distinct().write.mode("overwrite").parquet(f"{base}/found/batch={number}")

    job = pages.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/cursor").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.parquet(f"{base}/found").groupBy("site", "finding", "severity").agg(F.count_distinct("page_id").alias("pages"))


#: How a job can end.
DONE, LIMIT, FAILED = "done", "limit", "failed"


class Ended(NamedTuple):
    """How a job ended, the rows so far (None before the first), the cursor to go on with, rows of this run, and the message of a failure."""

    status: str
    so_far: DataFrame | None
    cursor: str
    rows: int
    error: str | None


def steps(rows: DataFrame, name: str, max_steps: int | None = None, max_rows: int | None = None, cursor: str | None = None) -> Ended:
    """Run a collection job step by step (a micro-batch each) until all is read or a limit is met.

    A step that fails leaves the job FAILED, with its message and what was collected
    before; the same cursor tries that step again.
    """
    spark = rows.sparkSession
    base = cursor or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    done = {"steps": 0, "rows": 0, "stop": False}

    def step(batch: DataFrame, number: int) -> None:
        if done["stop"]:
            raise InterruptedError("limit")
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")
        done["steps"] += 1
        done["rows"] += spark.read.schema(batch.schema).parquet(f"{base}/rows/batch={number}").count()
        done["stop"] = (max_steps is not None and done["steps"] >= max_steps) or (max_rows is not None and done["rows"] >= max_rows)

    job = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/cursor").trigger(availableNow=True).start()
    ended, error = DONE, None
    try:
        job.awaitTermination()
    except StreamingQueryException as e:  # of a step: it ends the job and not the caller
        ended = LIMIT if done["stop"] and "InterruptedError: limit" in str(e) else FAILED
        error = str(e) if ended == FAILED else None
    try:
        so_far = spark.read.schema(rows.schema).parquet(f"{base}/rows")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        so_far = None
    return Ended(ended, so_far, base, done["rows"], error)
