"""Windows of pages over the numbered rows of a table, right and wrong ones, and an audit of what pages hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(items: DataFrame, key: str, size: int, fault: str = "") -> DataFrame:
    """Rows (page, item) of the rows of a table by their number in `key`.

    Faults: duplicates (a page begins with the last item of the one before), missing (the
    last item of each page is skipped), off_by_one (pages begin one later), shrinking
    (page n holds n fewer).
    """
    k = F.col(key)
    at = F.floor(k / size) + 1
    pages = {
        "": F.array(at), "duplicates": F.when(k % size == size - 1, F.array(at, at + 1)).otherwise(F.array(at)),
        "missing": F.when(k % size != size - 1, F.array(at)), "off_by_one": F.when(k >= 1, F.array(F.floor((k - 1) / size) + 1)), "shrinking": F.when(k % size < size - at + 1, F.array(at)),
    }[fault]
    return items.select(F.explode(pages).alias("page"), k.alias("item")).select(F.col("page").cast("long").alias("page"), "item")


def audit(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows (problem, n) over pages (page, item) against the items (item) that there are: repeated, lost, foreign, and pages shorter than the longest (the last one aside)."""
    seen = pages.groupBy("item").agg(F.count(F.lit(1)).alias("times"))
    both = seen.withColumn("got", F.lit(True)).join(expected.select("item").distinct().withColumn("there", F.lit(True)), "item", "full")
    items = both.agg(F.count_if(F.col("times") > 1).alias("repeated"), F.count_if(F.col("got").isNull()).alias("lost"), F.count_if(F.col("there").isNull()).alias("foreign"))
    sizes = pages.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    most, last = sizes.agg(F.max("n"), F.max("page")).first()
    short = sizes.agg(F.count_if((F.col("n") < F.lit(most)) & (F.col("page") < F.lit(last))).alias("short"))
    return items.unpivot([], ["repeated", "lost", "foreign"], "problem", "n").unionByName(short.unpivot([], ["short"], "problem", "n"))
