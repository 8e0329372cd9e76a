"""Document fingerprints by winnowing.

The hashes of all K-grams of code points are rolled over a text; of every WINDOW
hashes in a row the smallest is kept, the rightmost of equal ones, with its position.
Two texts that share GUARANTEE = WINDOW + K - 1 code points in a row share a kept hash,
and no match shorter than K is ever seen.

A fingerprint is a string of 16 hex digits for each kept hash: 8 of the hash and 8 of
its position (the number of code points before the K-gram).

Defined results:
* null text is the empty text; its fingerprint is the empty string;
* a text shorter than K is hashed as a whole, one shorter than a window's span keeps
  the smallest of its hashes; long texts are read whole;
* likeness is the Jaccard similarity of the sets of kept hashes; two empty
  fingerprints are alike (1), an empty and another one are not (0);
* equal texts have equal fingerprints; repeated rows follow one another in the order
  of ids (ties by text); a null id comes after all others; a single document is its
  own next one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.llm.common import partitions, text_of

K, WINDOW = 16, 48
GUARANTEE = WINDOW + K - 1
BASE = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """64-bit hashes of all k-grams, each combined from hashes of two shorter ones; k is a power of two."""
    h, n, base = points.astype(np.uint64) + np.uint64(1), 1, BASE
    with np.errstate(over="ignore"):
        while n < k:
            h, base, n = h[:-n] * base + h[n:], base * base, 2 * n
        h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the hashes kept: of each window the smallest, the rightmost of equal ones."""
    window = min(window, len(h))
    value, at, n = h, np.arange(len(h)), 1
    while n < window:
        step = min(n, window - n)
        left, right = value[:-step], value[step:]
        later = right <= left
        value, at, n = np.where(later, right, left), np.where(later, at[step:], at[:-step]), n + step
    return at[np.flatnonzero(np.diff(at, prepend=-1))] if len(at) else at


def fingerprint(text: str) -> np.ndarray:
    """Kept (hash, position) pairs of a text, as big-endian 32-bit numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points):
        return np.zeros((0, 2), dtype=">u4")
    if len(points) < K:
        points = np.concatenate([points, np.full(K - len(points), 0x110000, dtype="<u4")])
    h = hashes(points)
    at = winnow(h)
    return np.stack([h[at] >> np.uint64(32), at.astype(np.uint64)], axis=1).astype(">u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' hashes."""
    x, y = np.unique(a[:, 0].astype(np.uint32)), np.unique(b[:, 0].astype(np.uint32))
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both / (len(x) + len(y) - both)


def edited(text: str, after: str) -> str:
    """The text with its last half (rounded down) replaced by as many first code points of the next text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _row(doc_id: int | None, text: str, mark: np.ndarray, after: str, next_mark: np.ndarray) -> tuple:
    changed = edited(text, after)
    other = fingerprint(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, mark.tobytes().hex(), other.tobytes().hex(), likeness(mark, other), likeness(mark, next_mark)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, guest, id descending, text): each document with the one after it.

    A range's last row is its guest, the first document of the next range: it only
    serves as a next one. One document and its fingerprint are held at a time.
    """
    out, size, held = [], 0, None

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), ARROW.types, strict=True)], schema=ARROW)

    for rows in batches:
        columns = (rows.column("range").to_pylist(), rows.column("guest").to_pylist(), rows.column("doc_id").to_pylist(), rows.column("text"))
        for part, guest, doc_id, text in zip(*columns, strict=True):
            text = text.as_py()
            mark = fingerprint(text)
            if held and held[0] == part:
                out.append(_row(*held[1:], text, mark))
                size += 2 * len(out[-1][3])
            held = None if guest else (part, doc_id, text, mark)
            if size > 1 << 22 or len(out) >= 2000:
                yield batch()
                out, size = [], 0
    if out:
        yield batch()


def ranges(docs: DataFrame, id_col: str = "doc_id") -> list[tuple[int, int]]:
    """Smallest and largest id of disjoint ranges of ids, as Spark's range partitioning deals them out. Only ids are read."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id")).dropna().repartitionByRange(4 * partitions(spark), "id")
    rows = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()
    return sorted((r["low"], r["high"]) for r in rows)


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its fingerprint, the edited text's and the likeness to that and to the next document's.

    Texts are shuffled once, to ranges of ids in descending order; the first document
    of each range goes to the range before it as well, and the first of all to the last.
    """
    bounds = ranges(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    nulls = not rows.filter("doc_id IS NULL").isEmpty()
    lows = [low for low, _ in bounds]
    last = len(lows)  # the range of null ids, at the end of the order
    heads = {high: i for i, (_, high) in enumerate(bounds)}
    lows_lit = F.lit(lows) if lows else F.expr("CAST(array() AS array<bigint>)")
    step = max(1, int(len(lows) ** 0.5))
    coarse = F.lit(lows[::step]) if lows else lows_lit
    block = F.greatest(F.size(F.filter(coarse, lambda x: x <= F.col("doc_id"))) - 1, F.lit(0))
    inner = F.slice(lows_lit, block * step + 1, F.lit(step))
    number = F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(block * step + F.size(F.filter(inner, lambda x: x <= F.col("doc_id"))) - 1)
    # descending order runs from the highest range down to 0, then to the nulls, then back to the first
    before = {i: i + 1 for i in range(last - 1)} | ({last - 1: last if nulls else 0} if lows else {})
    host = F.get(F.lit([before.get(i, 0) for i in range(last)]), F.col("range")) if lows else F.lit(None).cast("int")
    if nulls and lows:
        before[last] = 0
    is_head = F.col("doc_id").isin(list(heads)) if len(heads) <= 200 else F.col("doc_id") == F.get(F.lit([h for _, h in bounds]), F.col("range"))
    own = rows.withColumn("range", number.cast("int"))
    if lows:
        guest = F.when(is_head, F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")), F.struct(host.alias("at"), F.lit(True).alias("guest")))).otherwise(
            F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")))
        )
    else:
        guest = F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")))
    if nulls:  # the first null document follows the last id
        first = rows.filter("doc_id IS NULL").agg(F.min("text").alias("t")).first()["t"]
        follows = F.struct(F.lit(0 if lows else last).alias("at"), F.lit(True).alias("guest"))
        guest = F.when(F.col("doc_id").isNull() & (F.col("text") == F.lit(first)), F.array(F.struct(F.col("range").alias("at"), F.lit(False).alias("guest")), follows)).otherwise(guest)
    placed = own.withColumn("to", F.explode(guest)).select(F.col("to.at").alias("range"), F.col("to.guest").alias("guest"), "doc_id", "text")
    ordered = placed.repartition("range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(_follow, OUT)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return followed(docs)
