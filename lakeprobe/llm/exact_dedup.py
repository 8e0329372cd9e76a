"""Exact dedup against a persistent digest index, with DataFrame operations only.

The index is a table with one row per distinct text: its digest and the id that
stays. It is bucketed and sorted by digest, so new data meets it in a sort-merge
anti-join in which only the new digests are shuffled; what is not yet in the index
is appended.

Defined results:
* null text is the empty text; texts are equal when they are identical after each
  run of space, tab, newline, vertical tab, form feed and return became one space;
* of equal texts the row with the smallest id stays (a text that the index already
  holds keeps the id recorded there); null ids lose to any other id;
* repeated rows (same id and text) share one decision; dedup() returns one of them;
* an empty table gives an empty result and leaves the index as it was;
* other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.llm.common import discard, field, join_groups, packed, partitions, text_of, unpacked, written


def normalised(text: str = "text") -> Column:
    """The text with each run of ASCII white space as one space."""
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def digest(text: str = "text") -> Column:
    """SHA-256 of the normalised text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A table (digest, keep_id), bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or partitions(spark)
        if not spark.catalog.tableExists(self.name):
            self._append(spark.range(0).select(F.unhex(F.lit("")).alias("digest"), F.col("id").alias("keep_id")))

    def _append(self, rows: DataFrame) -> None:
        rows.write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.name)

    def drop(self) -> None:
        """Delete the index."""
        self.spark.sql(f"DROP TABLE {self.name}")

    def rows(self) -> DataFrame:
        """What the index holds."""
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> None:
        """Append the rows (digest, keep_id) whose digest the index does not hold."""
        self._append(groups.select("digest", "keep_id").join(self.rows().hint("merge"), "digest", "left_anti").select("digest", "keep_id"))


def decide(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", portions: int = 1) -> DataFrame:
    """One row per row of docs: id, digest, keep_id, group_size, kept. Adds new texts to the index.

    The rows are added in portions of about the same size, smallest ids first (null ids
    last), each against the index that the portions before have filled.

    Groups are counted before anything is shuffled in full. The few texts that hold
    at least 1/HOT_SHARE of the rows are joined by broadcast (at most HOT_SHARE rows
    of some 60 bytes), so no task gathers the copies of a hot text; all others meet
    their group in a sort-merge join.
    """
    rows = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(text_col).alias("digest")), "digests")
    cuts = rows.agg(F.percentile_approx("doc_id", F.lit([i / portions for i in range(1, portions)]), 1000)).first()[0] if portions > 1 else None
    number = F.when(F.col("doc_id").isNull(), F.lit(len(cuts or ()))).otherwise(sum(((F.col("doc_id") > c).cast("int") for c in cuts or ()), F.lit(0)))
    for i in range(len(cuts or ()) + 1):
        # written first: an anti-join that was pushed below the sums would meet every copy
        index.add(written(rows.filter(number == i).groupBy("digest").agg(F.min("doc_id").alias("keep_id")), "portion"))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = written(sizes.join(index.rows().hint("merge"), "digest"), "groups")
    found = join_groups(rows, groups, "digest", "group_size", rows.count())
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each group of equal texts one, and none that the index held before. Without an index, one is made and dropped again."""
    own = index or DigestIndex(docs.sparkSession)
    known = written(own.rows().select("digest"), "known")
    kept = decide(docs, own, id_col, text_col).filter("kept")
    stay = kept.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("ties")).join(known.hint("merge"), "digest", "left_anti")
    stay = written(stay.select("digest", F.col("doc_id").alias("id"), "ties"), "stay")
    discard(known)
    if index is None:
        own.drop()
    # by id and digest, so the copies of a hot text do not meet in one task
    rows = packed(docs).withColumn("own", digest(field(docs, text_col))).withColumn("own_id", F.col(field(docs, id_col)).cast("long"))
    marked = rows.join(stay, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")))
    single = unpacked(marked.filter("ties = 1"), docs)
    if stay.filter("ties > 1").isEmpty():
        return single
    return single.unionByName(unpacked(marked.filter("ties > 1").dropDuplicates(["digest"]), docs))


#: Portions in which the query adds the documents to its index.
PORTIONS = 2


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The decision for every document, added in portions to an index that is dropped afterwards."""
    index = DigestIndex(spark)
    out = decide(docs, index, portions=PORTIONS).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    index.drop()
    return out


SQL = r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), groups AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM digests GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM digests JOIN groups USING (text_sha256)
"""
