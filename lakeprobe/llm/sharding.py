"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by (hash of the text, sub-key), so equal texts lie side by side.
A size-weighted sample of keys gives quantile splitters; records are dealt to the
ranges between them; a range that turns out overfull is sampled again and divided.
Exact byte and row totals of the ranges (a few numbers each) then place every range
on the line of all bytes, and the 16 shards are equal stretches of that line.

A group of equal texts moves as one unit unless it is larger than half a shard: such
groups (there are at most 2 * shards of them) get a sub-key per row and are divided. A
group of more rows than a range should have (many empty texts, say) gets sub-keys too,
so that no task sorts it whole, but stays in one shard.

Defined results:
* the size of a record is the length of its text in UTF-8 plus 1; null text has none;
* law `bytes`: a unit goes to the shard in which its middle byte lies, so two shards
  differ by no more than about the larger of half a shard's largest group and a record;
* slots number the records of a shard from 0 in that order; ties and repeated rows are
  told apart by a row number that is written down once;
* an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeprobe.llm.common import field, packed, text_of, written

SHARDS = 16
#: Ranges at least, rows a range holds about, sampled keys for each range.
RANGES, ROWS_A_RANGE, SAMPLES_A_RANGE = 64, 500_000, 32
#: A range with so many times its share of the bytes and rows is overfull.
OVERFULL, ROUNDS = 3, 3


def _hex(column: Column) -> Column:
    return F.lpad(F.hex(column), 16, "0")


def range_of(key: Column, splitters: list[str]) -> Column:
    """The number of splitters up to the key, found in two steps of about the square root of their number."""
    if not splitters:
        return F.lit(0)
    step = max(1, math.isqrt(len(splitters)))
    coarse = F.lit(splitters[step - 1 :: step])
    fine = F.lit([splitters[i : i + step] for i in range(0, len(splitters) + 1, step)])
    block = F.size(F.filter(coarse, lambda s: s <= key))
    return block * step + F.coalesce(F.size(F.filter(F.get(fine, block), lambda s: s <= key)), F.lit(0))


def _sample(keys: DataFrame, rate: float, seed: int) -> list[tuple[str, float]]:
    """Keys drawn with a probability in proportion to their weight, and the weight each stands for."""
    drawn = F.pmod(F.xxhash64("key", "rid", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    chance = F.least(F.lit(1.0), F.col("weight") * rate)
    rows = keys.filter(drawn < chance).select("key", (F.col("weight") / chance).alias("weight")).collect()
    return sorted((r["key"], r["weight"]) for r in rows)


def _quantiles(sample: list[tuple[str, float]], parts: int) -> list[str]:
    total, gone, out = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        gone += w
        if gone * parts >= total * (len(out) + 1) and len(out) < parts - 1:
            out.append(key)
    return out


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rid: Column | None = None) -> DataFrame:
    """A row (doc_id, size, text_crc32, h, rid) per document; rid tells rows apart once it is written down."""
    text = text_of(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.lit("shard")).alias("h"), (F.monotonically_increasing_id() if rid is None else rid).alias("rid"),
    )


def keyed(rows: DataFrame, shards: int) -> tuple[DataFrame, list[int], int, int, int]:
    """The rows with key and weight, the groups that lie in several ranges but in one shard, the totals of rows and bytes, and the ranges.

    A group of more than half a shard's bytes is divided row by row. One with more rows
    than a range should have is not, but its rows may lie in several ranges. There are
    at most 2 * shards of the first kind and as many as ranges of the second.
    """
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = max(RANGES, -(-n // ROWS_A_RANGE))
    groups = rows.groupBy("h").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    divided = F.col("b") * 2 * shards > total
    large = groups.filter(divided | (F.col("n") * ranges > n) & (F.col("n") > 1)).select("h", divided.alias("divided")).collect()
    every, wide = [r["h"] for r in large], [r["h"] for r in large if not r["divided"]]
    sub = F.when(F.col("h").isin(every), F.col("rid")).otherwise(F.lit(0)) if every else F.lit(0).cast("long")
    weight = F.col("size") / float(max(total, 1)) + 1 / float(max(n, 1))
    return rows.withColumn("key", F.concat(_hex(F.col("h")), _hex(sub))).withColumn("weight", weight), wide, n, total, ranges


def splitters(keys: DataFrame, ranges: int) -> tuple[list[str], list]:
    """Splitters that leave no range overfull in bytes or rows (but for a single unit), and each range's number, rows and bytes.

    A row's weight is its share of the bytes plus its share of the rows, 2 in all.
    """
    found = sorted(set(_quantiles(_sample(keys, ranges * SAMPLES_A_RANGE / 2, 0), ranges)))
    for turn in range(ROUNDS + 1):
        stats = (
            keys.withColumn("range", range_of(F.col("key"), found))
            .groupBy("range")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.sum("weight").alias("weight"), F.min("key").alias("low"), F.max("key").alias("high"))
            .collect()
        )
        over = [r for r in stats if r["weight"] > OVERFULL * 2 / ranges and r["low"] < r["high"]]
        if not over or turn == ROUNDS:
            return found, sorted((r["range"], r["rows"], r["bytes"]) for r in stats)
        inside = keys.withColumn("range", range_of(F.col("key"), found)).filter(F.col("range").isin([r["range"] for r in over]))
        again = _sample(inside, ranges * SAMPLES_A_RANGE * 2, turn + 1)
        for r in over:
            parts = math.ceil(r["weight"] * ranges / 2)
            found += _quantiles([x for x in again if r["low"] < x[0] <= r["high"]], parts)
        found = sorted(set(found))


def placed(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row (doc_id, size, text_crc32, rid, shard, slot) for each of the written rows of numbered(), under the law `bytes`."""
    keys, wide, _, total, ranges = keyed(rows, shards)
    split, stats = splitters(keys, ranges)
    before_rows, before_bytes, at = {}, {}, (0, 0)
    for number, count, size in stats:
        before_rows[number], before_bytes[number] = at
        at = (at[0] + count, at[1] + size)
    offsets = lambda known: F.lit([known.get(i, 0) for i in range(len(split) + 1)])
    ordered = Window.partitionBy("range").orderBy("key", "doc_id", "rid")
    unit = Window.partitionBy("range", "key")
    out = (
        keys.withColumn("range", range_of(F.col("key"), split))
        .withColumn("row", F.get(offsets(before_rows), F.col("range")) + F.row_number().over(ordered) - 1)
        .withColumn("start", F.get(offsets(before_bytes), F.col("range")) + F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("unit_start", F.min("start").over(unit))
        .withColumn("unit_bytes", F.sum("size").over(unit))
        .select("doc_id", "size", "text_crc32", "rid", "h", "row", "unit_start", "unit_bytes")
    )
    out = written(out, "shard-units")
    if wide:  # one small row for each of these groups
        whole = out.filter(F.col("h").isin(wide)).groupBy("h").agg(F.min("unit_start").alias("whole_start"), F.sum("unit_bytes").alias("whole_bytes"))
        out = out.join(F.broadcast(whole), "h", "left").withColumn("unit_start", F.coalesce("whole_start", "unit_start")).withColumn("unit_bytes", F.coalesce("whole_bytes", "unit_bytes"))
    middle = F.col("unit_start") + F.col("unit_bytes") / 2
    out = out.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(total, 1)))).cast("int"))
    first = {r["shard"]: r["row"] for r in out.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    start = F.get(F.lit([first.get(i, 0) for i in range(shards)]), F.col("shard"))
    return out.select("doc_id", "size", "text_crc32", "rid", "shard", (F.col("row") - start).cast("long").alias("slot"))


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, size, text_crc32, rid, shard, slot) per document under the law `bytes`."""
    return placed(written(numbered(docs, id_col, text_col), "shard-keys"), shards)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", files: int = 8) -> None:
    """Write docs under path, a folder shard=N with about so many files for each shard: every row where placed() puts it, repeated ids too.

    Row numbers are written down with the rows first, so that they name the same row whenever one is read again.
    """
    rows = written(packed(docs).withColumn("rid", F.monotonically_increasing_id()), "shard-rows")
    keys = numbered(rows, field(docs, id_col), field(docs, text_col), F.col("rid"))
    where = placed(written(keys, "shard-keys"), shards).select("rid", F.col("shard").alias("shard_number"))
    out = rows.join(where, "rid").repartition(shards * files, "shard_number", F.pmod("rid", F.lit(files)))
    out = out.select(*[F.col(f"doc.c{i}").alias(f"c{i}") for i in range(len(docs.columns))], F.col("shard_number")).toDF(*docs.columns, "shard")
    out.write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The shard and slot of every document."""
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
