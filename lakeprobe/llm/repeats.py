"""Suffix-array dedup of long repeats, by a run-length index.

Every byte that is covered by a string of LENGTH bytes which also starts anywhere else
(in another text or the same) is removed.

The strings of LENGTH bytes of a text are grouped by their anchor: the smallest hash
of ANCHOR bytes in them. Equal strings have equal anchors, so a stretch of text whose
strings have one anchor (a segment) needs comparing with segments of that anchor only:
1. segments travel as numbers (hashes of the anchor and of the segment, place, length);
   anchors that occur once are left out, and segments that occur twice as a whole are
   covered as a whole;
2. of each distinct segment whose anchor has several, the bytes are fetched once;
3. these strings are dealt out by anchor, and a run-compressed Burrows-Wheeler index
   over each block of them gives the matching statistics of every position: where the
   longest match elsewhere reaches LENGTH, the string is covered;
4. an anchor with more bytes than a block holds is divided: two strings around the same
   anchor share LENGTH bytes only if they share half of the missing bytes to its left
   or half of them to its right, so each goes to a block by its left part and to one by
   its right part, again and again until the blocks are small or the string is whole.

Defined results:
* null text is the empty text; nothing is removed from texts shorter than LENGTH;
* matches never cross texts; repeated rows count as different texts, so long repeated
  rows are removed whole; null ids are like any other id; matches are judged on the
  input and overlaps count;
* kept bytes need not be UTF-8 any more: `kept` is binary; an empty table gives an
  empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeprobe.llm.common import join_groups, text_of, written
from lakeprobe.llm.run_index import RunIndex

LENGTH, ANCHOR = 200, 64
#: Bytes of strings that one index is built over, about.
BLOCK = 1 << 20
BASE, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(1 << 63)


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all strings of ANCHOR bytes (a power of two)."""
    h, n, base = data.astype(np.uint64) + np.uint64(1), 1, BASE
    with np.errstate(over="ignore"):
        while n < ANCHOR:
            h, base, n = h[:-n] * base + h[n:], base * base, 2 * n
        h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, start, number of strings of each segment of a text of at least LENGTH bytes, and whether it holds its anchor twice."""
    every = anchor_hashes(data)
    low, n, window = every, 1, LENGTH - ANCHOR + 1
    while n < window:
        step = min(n, window - n)
        low, n = np.minimum(low[:-step], low[step:]), n + step
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    count = np.diff(np.append(start, len(low)))
    twice = [np.count_nonzero(every[a : a + c + window - 1] == m) > 1 for m, a, c in zip(low[start], start.tolist(), count.tolist(), strict=True)]
    return low[start], start, count, np.array(twice)


def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of each text: anchor, hash of the bytes, document, place and length."""
    import xxhash

    names = ["m", "h", "id", "t", "start", "size", "twice"]
    for b in batches:
        parts: list[tuple] = []
        for doc, t, text in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), b.column("data"), strict=True):
            buffer = text.as_buffer()
            if buffer is None or buffer.size < LENGTH:
                continue
            data = memoryview(buffer)
            anchor, start, count, twice = segments(np.frombuffer(data, np.uint8))
            size = count + LENGTH - 1
            h = np.fromiter((xxhash.xxh64_intdigest(data[a : a + s]) for a, s in zip(start.tolist(), size.tolist(), strict=True)), np.uint64, len(start))
            parts.append((anchor.view(np.int64), h.view(np.int64), np.full(len(start), doc), np.full(len(start), t), start.astype(np.int32), size.astype(np.int32), twice))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for b in batches:
        m, h, doc, t, start, single, data = [], [], [], [], [], [], []
        for i, key, text, wanted in zip(b.column("id").to_pylist(), b.column("t").to_pylist(), b.column("data"), b.column("wanted").to_pylist(), strict=True):
            view = memoryview(text.as_buffer())
            for x in wanted:
                m.append(x["m"])
                h.append(x["h"])
                doc.append(i)
                t.append(key)
                start.append(x["start"])
                single.append(x["single"])
                data.append(bytes(view[x["start"] : x["start"] + x["size"]]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((m, h, doc, t, start, single, data), kinds, strict=True)], ["m", "h", "id", "t", "start", "single", "data"])


def _covered(strings: list[tuple]) -> list[tuple]:
    """Spans (id, t, from, to) covered by repeats, of the single ones among the strings (id, t, start, single, data)."""
    text = np.full(sum(len(s[4]) + 1 for s in strings), 256, np.int64)
    at, begins = 0, []
    for s in strings:
        text[at : at + len(s[4])] = np.frombuffer(s[4], np.uint8)
        begins.append(at)
        at += len(s[4]) + 1
    long = RunIndex(text).matching_statistics() >= LENGTH
    out = []
    for begin, (doc, t, start, single, data) in zip(begins, strings, strict=True):
        if single:
            hit = np.flatnonzero(np.diff(np.concatenate([[False], long[begin : begin + len(data) - LENGTH + 1], [False]]).astype(np.int8)))
            out += [(doc, t, start + a, start + b - 1 + LENGTH) for a, b in zip(hit[::2].tolist(), hit[1::2].tolist(), strict=True)]
    return out


SPANS = "id long, t long, a int, b int"


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "t", "a", "b"])


def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index block after block of strings sorted by key; the strings of a key share a block.

    A string that was divided has several keys. It must not meet itself, so a block ends
    before a key that holds one of its strings.
    """
    block: list[tuple] = []
    group: list[tuple] = []
    held: set[tuple] = set()
    key, size = None, 0
    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("key", "id", "t", "start", "single", "data"))
        for k, *row in zip(*columns, strict=True):
            if k != key:
                if block and not held.isdisjoint(r[:3] for r in group):
                    yield _spans(_covered(block))
                    block, size = [], 0
                    held.clear()
                block += group
                held.update(r[:3] for r in group)
                size += sum(len(r[4]) for r in group)
                if size > BLOCK:
                    yield _spans(_covered(block))
                    block, size = [], 0
                    held.clear()
                key, group = k, []
            if not group or group[-1][:3] != tuple(row[:3]):  # a string may have come to its key by several ways
                group.append(tuple(row))
    if block and not held.isdisjoint(r[:3] for r in group):
        yield _spans(_covered(block))
        block = []
    block += group
    if block:
        yield _spans(_covered(block))


def around_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For strings of a large anchor: a row for each place of the anchor, with the strings that hold it there first."""
    names = ["key", "id", "t", "start", "single", "data", "off", "l", "r"]
    for b in batches:
        rows = []
        for m, doc, t, start, single, data in zip(*(b.column(c).to_pylist() for c in ("key", "id", "t", "start", "single", "data")), strict=True):
            h = anchor_hashes(np.frombuffer(data, np.uint8)).view(np.int64)
            done = -1
            for p in np.flatnonzero(h == m).tolist():
                a, z, done = max(0, done + 1, p + ANCHOR - LENGTH), min(len(data), p + LENGTH), p
                rows.append((m, doc, t, start + a, single, data[a:z], p - a, 0, 0))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names)


def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string once by more of its left part, once by more of its right part, where it reaches so far."""
    import xxhash

    names = ["key", "id", "t", "start", "single", "data", "off", "l", "r"]
    for b in batches:
        rows = []
        for _, doc, t, start, single, data, off, left, right in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            gap = LENGTH - ANCHOR - left - right
            for x, y in {(left + (gap + 1) // 2, right), (left, right + gap // 2 if gap > 1 else right + gap)}:
                if off >= x and off + ANCHOR + y <= len(data):
                    key = xxhash.xxh64(data[off - x : off + ANCHOR + y], seed=x * 1000 + y + 1).intdigest() - (1 << 63)
                    rows.append((key, doc, t, start, single, data, off, x, y))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names)


DIVIDED = "key long, id long, t long, start int, single boolean, data binary, off int, l int, r int"


def compare(strings: DataFrame) -> DataFrame:
    """Covered spans from rows (key, id, t, start, single, data); keys with too many bytes are divided."""
    sizes = written(strings.groupBy("key").agg(F.sum(F.length("data")).alias("bytes")).filter(F.col("bytes") > BLOCK), "large")
    fine = strings.join(sizes.hint("merge"), "key", "left_anti") if not sizes.isEmpty() else strings
    found = fine.repartition("key").sortWithinPartitions("key", "id", "t", "start").mapInArrow(match, SPANS)
    if sizes.isEmpty():
        return found
    large = strings.join(sizes.select("key").hint("merge"), "key").mapInArrow(around_anchor, DIVIDED)
    # a string can come to one key by several ways: only other strings count
    place = F.xxhash64("id", "t", "start")
    while True:
        large = written(large.mapInArrow(halves, DIVIDED), "divided")
        sizes = large.groupBy("key").agg(F.sum(F.length("data")).alias("bytes"), F.min(place).alias("first"), F.max(place).alias("last"), F.max(F.col("l") + F.col("r")).alias("known"))
        sizes = written(sizes.filter("first < last"), "large")
        # a key that names a whole string of LENGTH bytes: all of its rows hold it
        whole = F.col("known") >= LENGTH - ANCHOR
        same = large.join(sizes.filter(whole).select("key"), "key").filter("single")
        found = found.unionByName(same.select("id", "t", (F.col("start") + F.col("off") - F.col("l")).alias("a"), (F.col("start") + F.col("off") + ANCHOR + F.col("r")).alias("b")))
        small = large.join(sizes.filter(~whole & (F.col("bytes") <= BLOCK)).select("key"), "key").drop("off", "l", "r")
        found = found.unionByName(small.repartition("key").sortWithinPartitions("key", "id", "t", "start").mapInArrow(match, SPANS))
        large = large.join(sizes.filter(~whole & (F.col("bytes") > BLOCK)).select("key"), "key")
        if large.isEmpty():
            return found


def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the covered spans of each text and cut them out."""
    for b in batches:
        kept, spans = [], []
        for text, covered in zip(b.column("data"), b.column("covered").to_pylist(), strict=True):
            data, merged = text.as_py(), []
            for x in sorted((x["a"], x["b"]) for x in covered or ()):
                if merged and x[0] <= merged[-1]["b"]:
                    merged[-1]["b"] = max(merged[-1]["b"], x[1])
                else:
                    merged.append({"a": x[0], "b": x[1]})
            edges = [0, *(e for x in merged for e in (x["a"], x["b"])), len(data)]
            kept.append(b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)) if merged else data)
            spans.append(merged)
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(x) for x in b.column("data").to_pylist()], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)], ["id", "n_bytes", "kept", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, n_bytes, kept binary, spans) for each row of docs."""
    text = text_of(text_col)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("t"), text.cast("binary").alias("data"))
    found = written(rows.mapInArrow(places, "m long, h long, id long, t long, start int, size int, twice boolean"), "places", "zstd")
    # a row for each distinct segment, and one for each anchor: partial sums, so no task gathers the segments of an anchor
    kinds = written(
        found.groupBy("m", "h").agg(F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice"), F.min(F.struct("id", "t", "start", "size")).alias("first")), "kinds", "zstd"
    )
    anchors = kinds.groupBy("m").agg(F.count(F.lit(1)).alias("kinds"), F.max("twice").alias("any_twice")).filter("kinds > 1 OR any_twice")
    repeated = kinds.filter("times > 1").select("m", "h", "times")
    whole = join_groups(found, repeated, ["m", "h"], "times", found.count()).select("id", "t", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    several = join_groups(kinds, anchors.select("m", "kinds", F.lit(True).alias("several")), "m", "kinds", kinds.count())
    # an anchor whose only segment holds it twice matters where the segment does
    wanted = several.groupBy("first.id", "first.t").agg(
        F.collect_list(F.struct("m", "h", "first.start", "first.size", (F.col("times") == 1).alias("single"))).alias("wanted")
    )
    once = rows.join(wanted, ["id", "t"])
    strings = once.mapInArrow(fetch, "m long, h long, id long, t long, start int, single boolean, data binary")
    # repeated rows fetch their segments once each; one of them is enough
    strings = written(strings.select(F.col("m").alias("key"), "h", "id", "t", "start", "single", "data"), "strings", "zstd")
    if not docs.select(id_col).groupBy(id_col).count().filter("count > 1").isEmpty():
        strings = strings.dropDuplicates(["key", "h"])
    spans = whole.unionByName(compare(strings.drop("h")))
    covered = spans.groupBy("id", "t").agg(F.collect_set(F.struct("a", "b")).alias("covered"))
    out = rows.join(covered, ["id", "t"], "left").mapInArrow(strip, "id long, n_bytes long, kept binary, spans array<struct<a:int,b:int>>")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "kept", "spans")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """What was removed from every document, and the digest of what was kept."""
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
