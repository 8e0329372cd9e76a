"""Collecting rows page by page under limits, with the drift of their fields, as a stream.

A stream carries rows (job, page, pos, fields...): what has been extracted from the pages
of many jobs, and a row without fields for a page that gave nothing. Each micro-batch is a
step. What a job has so far (pages, rows, bytes, whether and why it stopped) and the counts
of its fields are written under the batch's number, beside the rows that were kept: a batch
that is repeated replaces itself, and the totals of the batches before are what the next
one starts from. All of it adds up, so the state after any number of steps is that of one
step over the same pages.

A job's pages are taken in order of their numbers, and those of later steps come later.
Within a step the limits are running sums over a job's pages (one small row for each page;
none beyond the limit of pages), not over its rows.

Defined results:
* a page is taken while the job is below all limits; the last page is cut to the rows that
  are left; a page without rows is the end of the list, and counts only if it is the first;
* stop reasons: rows, pages, bytes (the first that is met, in this order), end; none while
  more may come. Nothing is taken after a stop;
* null jobs and pages are left out; rows of one page are ordered by pos, equal ones by
  their text; an empty stream has no jobs.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeprobe.functions.json_ops import value_kind
from lakeprobe.session import saved, shared_dir

ROWS, PAGES, BYTES, END = "rows", "pages", "bytes", "end"
TOTALS = "job string, pages long, rows long, bytes long, stopped string"
COUNTS = "job string, field string, kind string, n long"


@dataclass(frozen=True)
class Limits:
    """Pages, rows and bytes (of rows as JSON, a line each) of a job."""

    pages: int = 100
    rows: int = 10_000
    bytes: int = 8 * 1024 * 1024


def taken(batch: DataFrame, before: DataFrame, fields: list[str], limits: Limits) -> tuple[DataFrame, DataFrame]:
    """The rows of a step that are kept, and what each of its jobs has then; before: what jobs had."""
    line = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    empty = F.lit(True)
    for f in fields:
        empty = empty & F.col(f).isNull()
    rows = batch.filter("job IS NOT NULL AND page IS NOT NULL").select(F.col("job").cast("string").alias("job"), F.col("page").cast("long").alias("page"), "pos", *fields, line.alias("line"), (~empty).alias("full"))
    rows = saved(rows.join(before.filter("stopped IS NOT NULL").select("job"), "job", "left_anti"), "step")
    pages = rows.groupBy("job", "page").agg(F.count_if("full").alias("n"), F.sum(F.when(F.col("full"), F.octet_length("line") + 1).otherwise(0)).alias("size"))
    start = before.select("job", F.col("pages").alias("had_pages"), F.col("rows").alias("had_rows"), F.col("bytes").alias("had_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    pages = pages.join(start, "job", "left").withColumns({c: zero(F.col(c)) for c in ("had_pages", "had_rows", "had_bytes")})
    order = Window.partitionBy("job").orderBy("page")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limits.pages + 1)
    pages = pages.withColumn("blank", F.col("n") == 0).withColumn("ended", zero(F.max(F.col("blank").cast("int")).over(earlier)) > 0)
    pages = pages.withColumn("rows_before", F.col("had_rows") + zero(F.sum("n").over(earlier))).withColumn("bytes_before", F.col("had_bytes") + zero(F.sum("size").over(earlier)))
    reached = ~F.col("ended") & (F.col("had_pages") + F.col("nth") <= limits.pages) & (F.col("rows_before") < limits.rows) & (F.col("bytes_before") < limits.bytes)
    pages = saved(pages.filter(reached).withColumn("room", F.lit(limits.rows) - F.col("rows_before")), "pages")
    # only pages that are cut have their rows numbered
    cut = pages.filter("n > room").select("job", "page", "room")
    whole = rows.filter("full").join(pages.filter("n <= room AND NOT blank").select("job", "page"), ["job", "page"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("job", "page").orderBy("pos", "line"))
    part = rows.filter("full").join(cut, ["job", "page"]).withColumn("place", nth).filter("place <= room").drop("place", "room")
    kept = saved(whole.unionByName(part), "kept")
    sizes = kept.groupBy("job").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("line") + 1).alias("size"))
    seen = pages.groupBy("job").agg(
        F.first("had_pages").alias("had_pages"), F.first("had_rows").alias("had_rows"), F.first("had_bytes").alias("had_bytes"), F.count_if(~F.col("blank") | (F.col("had_pages") + F.col("nth") == 1)).alias("more"), F.bool_or("blank").alias("blank")
    )
    now = seen.join(sizes, "job", "left").select(
        "job", (F.col("had_pages") + F.col("more")).alias("pages"), (F.col("had_rows") + zero(F.col("n"))).alias("rows"), (F.col("had_bytes") + zero(F.col("size"))).alias("bytes"), "blank"
    )
    why = F.when(F.col("rows") >= limits.rows, ROWS).when(F.col("pages") >= limits.pages, PAGES).when(F.col("bytes") >= limits.bytes, BYTES).when(F.col("blank"), END)
    return kept.drop("line", "full"), now.withColumn("stopped", why).drop("blank")


def counted(kept: DataFrame, fields: list[str]) -> DataFrame:
    """How many values of each kind every field of each job has: (job, field, kind, n). Counts of steps add up."""
    long = kept.select("job", *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(["job"], fields, "field", "value")
    return long.groupBy("job", "field", value_kind(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def drift(counts: DataFrame) -> DataFrame:
    """Per job and field: in how many hundredths of the rows it has a value, the kind of most values (of equal ones the first by name), whether kinds are mixed."""
    full = F.col("kind") != "empty"
    sums = counts.groupBy("job", "field", "kind").agg(F.sum("n").alias("n")).groupBy("job", "field").agg(
        F.sum("n").alias("total"), F.sum(F.when(full, F.col("n")).otherwise(0)).alias("present"), F.count_if(full).alias("kinds"), F.min(F.when(full, F.struct((-F.col("n")).alias("n"), "kind"))).alias("top")
    )
    return sums.select("job", "field", F.round(F.col("present") * 100 / F.col("total"), 1).alias("present_pct"), F.coalesce("top.kind", F.lit("empty")).alias("dominant"), (F.col("kinds") > 1).alias("mixed"))


class Collection:
    """The collected rows, totals and field counts of jobs below a shared folder."""

    def __init__(self, rows: DataFrame, fields: list[str], limits: Limits | None = None, folder: str | None = None):
        self.source, self.fields, self.limits, self.spark = rows, fields, limits or Limits(), rows.sparkSession
        self.folder = folder or f"{shared_dir(self.spark)}/collect-{uuid.uuid4().hex}"

    def _read(self, name: str, schema: str) -> DataFrame:
        """A table that steps have written; empty before the first."""
        try:
            return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{schema}, batch long")

    def totals(self, below: int | None = None) -> DataFrame:
        """What each job has (TOTALS), after all steps or after those below a number."""
        rows = self._read("totals", TOTALS)
        rows = rows if below is None else rows.filter(F.col("batch") < below)
        return rows.groupBy("job").agg(F.max_by(F.struct("pages", "rows", "bytes", "stopped"), "batch").alias("t")).select("job", "t.*")

    def kept(self) -> DataFrame:
        """The rows collected."""
        kinds = {f.name: f.dataType.simpleString() for f in self.source.schema}
        return self._read("rows", ", ".join(["job string", "page long", f"pos {kinds['pos']}", *(f"`{f}` {kinds[f]}" for f in self.fields)])).drop("batch")

    def counts(self) -> DataFrame:
        """The counts of the fields' values, one row for each step, job, field and kind."""
        return self._read("counts", COUNTS).drop("batch")

    def _step(self, batch: DataFrame, number: int) -> None:
        kept, now = taken(batch, self.totals(number), self.fields, self.limits)
        for name, rows in (("rows", kept), ("counts", counted(kept, self.fields)), ("totals", now)):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={number}")

    def run(self) -> Collection:
        """Take all steps that there are; a folder that has been used before goes on where it was."""
        job = self.source.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.folder}/cursor").trigger(availableNow=True).start()
        job.awaitTermination()
        return self
