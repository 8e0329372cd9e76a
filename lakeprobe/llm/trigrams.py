"""A naive Bayes classifier over hashed byte trigrams, shared by language ID and mixing.

It is fitted on at most SAMPLE labelled rows (those with the smallest hash of their id)
and gives log likelihoods for each label, evened out so that a long text weighs no more
than EVIDENCE trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeprobe.llm.common import text_of

SAMPLE, BUCKETS, EVIDENCE = 10_000, 1 << 14, 120


def buckets(text: str) -> np.ndarray:
    """The bucket of each byte trigram of the lower-cased text between spaces."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int64)


class Trigrams:
    """Labels and the log probability of each bucket under each."""

    def __init__(self, labels: list[str], logs: np.ndarray):
        self.labels, self.logs = labels, np.ascontiguousarray(logs.T.astype(np.float32))

    def likelihoods(self, text: str) -> np.ndarray:
        """Evened-out log likelihoods of a text under each label, the largest 0; all 0 for an empty text."""
        at = buckets(text) if text else np.zeros(0, np.int64)
        if not len(at):
            return np.zeros(len(self.labels))
        total = np.zeros(len(self.labels))
        for i in range(0, len(at), 1 << 16):
            total += self.logs[at[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
        total *= EVIDENCE / (len(at) + EVIDENCE)
        return total - total.max()


def fit(docs: DataFrame, labelled: DataFrame) -> Trigrams:
    """From rows (doc_id, label) of labelled ids and the texts of docs; rows with a null id or label are left out."""
    chosen = (
        labelled.select(F.col("doc_id").alias("__id"), F.col("label").alias("__label"))
        .dropna().dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
    )
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("text", F.col("__label").alias("label"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for text, label in zip(b.column("text"), b.column("label").to_pylist(), strict=True):
                n = totals.setdefault(label, np.zeros(BUCKETS, np.int64))
                n += np.bincount(buckets(text.as_py()), minlength=BUCKETS)
        for label, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["label", "bucket", "n"])

    counts = rows.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    labels = sorted(counts["label"].unique())
    table = np.full((len(labels), BUCKETS), 0.5)
    table[counts["label"].map({x: i for i, x in enumerate(labels)}).to_numpy(dtype=np.int64), counts["bucket"].to_numpy(dtype=np.int64)] += counts["n"].to_numpy(dtype=float)
    return Trigrams(labels, np.log(table / table.sum(axis=1, keepdims=True)))
