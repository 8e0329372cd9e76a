"""What the training-data operators share: reading tables and cutting lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a folder, whole."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Another table of a folder, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(docs: DataFrame) -> DataFrame:
    """The rows of docs as one struct column `doc` with the fields c0, c1...: no name of docs can clash with another."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names).select(F.struct(*names).alias("doc"))


def field(docs: DataFrame, column: str) -> str:
    """The name of a column of docs in packed(docs)."""
    return f"doc.c{docs.columns.index(column)}"


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of docs again, with its columns."""
    return rows.select("doc.*").toDF(*docs.columns)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder among those that every executor shares: below spark.checkpoint.dir or, where it is unset, the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there.

    Executors may be lost afterwards without anything being computed again. The folder
    stays until discard(), or clean() once the results are saved.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    _delete(df.sparkSession, df.written_at)


def clean(spark: SparkSession) -> None:
    """Delete every table that this application has written; call it when its results are saved elsewhere."""
    _delete(spark, shared_dir(spark))


#: Rows of an Arrow batch of whole texts: texts may be long, and workers hold a batch at a time.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Let the session hand texts to Python in batches of at most BATCH_ROWS rows; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give unused memory of this process back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives unused memory back: workers stay alive between tasks, and wait side by side."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which follows the input on a cluster."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A group that holds at least one in so many rows is hot; there are at most so many hot groups.
HOT_SHARE = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """rows joined with their group's row, without gathering the rows of a large group in one task.

    The groups that hold at least 1/HOT_SHARE of the rows (so at most HOT_SHARE of
    them) are broadcast; the others meet their rows in a sort-merge join. groups has
    one row per key, with the number of rows of the key in the column `size`.
    """
    least = max(2, -(-total // HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col(size) >= least))
    cold = groups.filter(F.col(size) < least)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Written rows (node, root): the smallest node of the connected component of each node of edges (u, v).

    Alternating large-star and small-star rounds: each node's neighbours are tied to
    the smallest of them, until nothing changes. Only (node, smallest) pairs move.
    A node's smallest neighbour is found by partial minima, and hubs meet their
    neighbours by broadcast (join_groups): no task gathers the neighbours of a hub.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    # sums over hashes tell whether the set of edges is still the same: no join is needed
    mark = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first()
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).filter("n > 0"), f"{name}-least")
        large = join_groups(both.filter("v > u"), least, "u", "n", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u <> v").distinct(), f"{name}-large")
        # small star: every node's smaller neighbours, and the node itself, to the smallest of them
        down = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-down")
        small = join_groups(large, down, "u", "n", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        after = written(small.filter("u <> v").distinct(), name)
        now = mark(after)
        for gone in (edges, least, large, down):
            discard(gone)
        if now == before:
            break
        edges, before = after, now
    roots = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
