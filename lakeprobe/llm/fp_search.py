"""Ranked lexical search over document FP-trees.

The terms of the items are the only ones that matter: every document is restricted to
them, and its terms are put in order of document frequency, the most frequent first. In
that order documents share the beginnings of their vectors, so sorted vectors are the
paths of a trie: documents are range-partitioned by their vectors and every task builds
the FP-tree of its range, in trees of at most POSTINGS terms. A node is an interval of
the sorted documents; runs of nodes without a branch are one node, a child with more than
half of its parent's documents is replaced by its own children (so a document has at most
log2 ancestors), and small neighbours share a leaf. Every node holds the largest tf of
each term, and the smallest m, below it.

An item is searched depth first: the score grows with tf and falls with m, so the maxima
and the minimum of a subtree bound the scores of all its documents. Children with the
highest bounds come first, and a subtree that can't enter the item's best is left out. The
bests of all tasks, a bounded number for each item, are merged at the end.

Items are taken in blocks of bounded numbers of terms, so that what is broadcast is
bounded; documents are read once for each block.

Defined results:
* null text has no terms; documents without terms count for nothing and are never found;
  texts and items are read whole;
* repeated rows of the documents are documents of their own, a null id is last among
  equal scores; repeated rows of an item are read once, different texts of one item_id
  are one item with the terms of all;
* items without terms, or whose terms no document holds, have no rows; so have empty tables;
* other columns do not matter.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeprobe.llm.common import bounded_batches, partitions, text_of, tidied, written

#: Documents of an item; distinct terms of all items of a block (about); terms of a tree, documents of a leaf at most.
BEST, BLOCK, POSTINGS, LEAF = 10, 200_000, 1 << 20, 32
#: ASCII letters and digits, and everything beyond ASCII; bytes of UTF-8 beyond ASCII are all of the latter kind.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The key of a document without an id.
NO_ID = (1 << 63) - 1


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text: only A-Z are lower-cased."""
    return TERM.findall(text.lower())


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of every item, with repeats."""
    for b in batches:
        for i, text in enumerate(b.column("text").to_pylist()):
            found = Counter(terms_of(text))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array([i] * len(found), pa.int64())), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["item_id", "term", "n"])


def restricted(known):
    """Per document: its number of terms, and how often it holds each known one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for b in batches:
            rows = []
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                if found := terms_of(text):
                    held = Counter(filter(None, map(number.get, found)))
                    rows.append((key, len(found), np.fromiter(held.keys(), "<i4", len(held)).tobytes(), np.fromiter(held.values(), "<i4", len(held)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["key", "n", "terms", "tfs"])

    return run


def document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents of a task each term occurs."""
    counts = np.zeros(0, np.int64)
    for b in batches:
        more = np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), "<i4"), minlength=len(counts))
        more[: len(counts)] += counts
        counts = more
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(counts[held])], ["term", "df"])


def ordered_paths(ranks, n_docs: int, n_terms: int):
    """Per document: its terms by frequency, as a key that sorts like the path, their tf, and m."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for b in batches:
            paths, tfs = [], []
            for terms, tf in zip(b.column("terms").to_pylist(), b.column("tfs").to_pylist(), strict=True):
                path = rank[np.frombuffer(terms, "<i4")]
                order = np.argsort(path)
                paths.append(path[order].astype(">u4").tobytes())
                tfs.append(np.frombuffer(tf, "<i4")[order].tobytes())
            m = 25 + 75 * b.column("n").to_numpy() * n_docs // n_terms
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(m, pa.int64()), pa.array(paths, pa.binary()), pa.array(tfs, pa.binary())], ["key", "m", "path", "tfs"])

    return run


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score: it grows with tf and falls with m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class FPTree:
    """A tree over documents that are sorted by their paths."""

    def __init__(self, paths: list[bytes], tfs: list[bytes], m: np.ndarray, keys: np.ndarray, leaf: int = LEAF):
        self.m, self.keys, self.leaf = m, keys, leaf
        self.ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in paths])])
        self.terms = np.frombuffer(b"".join(paths), ">u4").astype(np.int64)
        tf = np.frombuffer(b"".join(tfs), "<i4").astype(np.int64)
        self.values = saturated(tf, np.repeat(m, np.diff(self.ends)))
        self.shared = np.zeros(len(paths), np.int64)
        for i in range(1, len(paths)):
            a, b = self.terms[self.ends[i - 1] : self.ends[i]], self.terms[self.ends[i] : self.ends[i + 1]]
            k = min(len(a), len(b))
            other = np.flatnonzero(a[:k] != b[:k])
            self.shared[i] = other[0] if len(other) else k
        self._grow()
        self._sum_up(tf)

    def _branches(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """The intervals into which the longest common path of an interval branches."""
        beyond = self.shared[lo + 1 : hi]
        cuts = [lo, *(lo + 1 + np.flatnonzero(beyond == beyond.min())).tolist(), hi]
        return list(zip(cuts[:-1], cuts[1:], strict=True))

    def _children(self, lo: int, hi: int) -> list[tuple[int, int]]:
        parts = self._branches(lo, hi)
        while (heavy := next((i for i, (a, b) in enumerate(parts) if 2 * (b - a) > hi - lo and b - a > self.leaf), None)) is not None:
            parts[heavy : heavy + 1] = self._branches(*parts[heavy])
        out: list[tuple[int, int]] = []
        for a, b in parts:
            if out and b - out[-1][0] <= self.leaf:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def _grow(self) -> None:
        """Nodes in breadth-first order: siblings stand side by side."""
        self.nodes, self.first, self.last = [(0, len(self.m))], [], []
        for lo, hi in self.nodes:  # grows meanwhile
            self.first.append(len(self.nodes))
            if hi - lo > self.leaf:
                self.nodes += self._children(lo, hi)
            self.last.append(len(self.nodes))

    def _sum_up(self, tf: np.ndarray) -> None:
        """Each node's largest tf of every term and smallest m and key below it, from the leaves up."""
        n = len(self.nodes)
        maxima: list[tuple[np.ndarray, np.ndarray]] = [None] * n
        self.least_m, self.least_key = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n - 1, -1, -1):
            lo, hi = self.nodes[i]
            self.least_m[i], self.least_key[i] = self.m[lo:hi].min(), self.keys[lo:hi].min()
            if self.first[i] == self.last[i]:
                terms, most = self.terms[self.ends[lo] : self.ends[hi]], tf[self.ends[lo] : self.ends[hi]]
            else:
                below = maxima[self.first[i] : self.last[i]]
                terms, most = np.concatenate([x[0] for x in below]), np.concatenate([x[1] for x in below])
            order = np.argsort(terms, kind="stable")
            terms, most = terms[order], most[order]
            starts = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
            maxima[i] = terms[starts], np.maximum.reduceat(most, starts)
        self.node_ends = np.concatenate([[0], np.cumsum([len(x[0]) for x in maxima])])
        self.node_terms = np.concatenate([x[0] for x in maxima]).astype(np.int32)
        self.node_values = saturated(np.concatenate([x[1] for x in maxima]), np.repeat(self.least_m, np.diff(self.node_ends)))

    def search(self, weight: np.ndarray, best: list[tuple[int, int]], k: int) -> None:
        """Put what the tree has into the heap of the k best (score, -key); weight: of every term, 0 if the item doesn't hold it."""
        stack = [(NO_ID, 0)]
        while stack:
            bound, node = stack.pop()
            if len(best) == k and (bound, -int(self.least_key[node])) <= best[0]:
                continue
            a, b = self.first[node], self.last[node]
            if a == b:
                lo, hi = self.nodes[node]
                ends = self.ends[lo : hi + 1]
                part = slice(ends[0], ends[-1])
                sums = np.concatenate([[0], np.cumsum(weight[self.terms[part]] * self.values[part])])[ends - ends[0]]
                for score, key in zip(np.diff(sums).tolist(), self.keys[lo:hi].tolist(), strict=True):
                    if score > 0:
                        if len(best) < k:
                            heapq.heappush(best, (score, -key))
                        elif (score, -key) > best[0]:
                            heapq.heapreplace(best, (score, -key))
            else:
                ends = self.node_ends[a : b + 1]
                part = slice(ends[0], ends[-1])
                bounds = np.diff(np.concatenate([[0], np.cumsum(weight[self.node_terms[part]] * self.node_values[part])])[ends - ends[0]])
                order = np.argsort(bounds, kind="stable")
                order = order[bounds[order] >= (best[0][0] if len(best) == k else 1)]
                stack += zip(bounds[order].tolist(), (a + order).tolist(), strict=True)


def searched(items, n_terms: int, k: int, postings: int = POSTINGS):
    """The k best documents of a task for every item; rows come sorted by path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in items.value]
        held, size = [], 0

        def search() -> None:
            paths, tfs, m, keys = zip(*held, strict=True)
            tree, weight = FPTree(paths, tfs, np.array(m, np.int64), np.array(keys, np.int64)), np.zeros(n_terms, np.int64)
            for (ranks, weights), found in zip(items.value, best, strict=True):
                weight[ranks] = weights
                tree.search(weight, found, k)
                weight[ranks] = 0

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("path", "tfs", "m", "key")), strict=True):
                held.append(row)
                size += len(row[0]) // 4
                if size >= postings:
                    search()
                    held, size = [], 0
        if held:
            search()
        rows = [(i, -key, score) for i, found in enumerate(best) for score, key in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item", "key", "score"])

    return run


def _block(vectors: DataFrame, names: list, terms: list[bytes], held: list[list[tuple[int, int]]], n_docs: int, n_terms: int, best: int, postings: int) -> DataFrame:
    """Rows (item_id, rank, key, score): the best documents for each item of a block, from those of every task."""
    spark = vectors.sparkSession
    counted = {x["term"]: x["df"] for x in vectors.mapInArrow(tidied(document_frequency), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    order = sorted(counted, key=lambda t: (-counted[t], terms[t - 1]))
    rank = np.zeros(len(terms) + 1, np.int64)
    rank[order] = np.arange(len(order))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in counted.items()}
    items = [[(rank[t], n * weight[t]) for t, n in found if t in counted] for found in held]
    items = [(np.array([r for r, _ in x], np.int64), np.array([w for _, w in x], np.int64)) for x in items]
    paths = vectors.filter("length(terms) > 0").mapInArrow(tidied(ordered_paths(spark.sparkContext.broadcast(rank), n_docs, n_terms)), "key long, m long, path binary, tfs binary")
    paths = written(paths, "paths")
    dealt = paths.repartitionByRange(partitions(spark), "path", "key").sortWithinPartitions("path", "key")
    found = dealt.mapInArrow(tidied(searched(spark.sparkContext.broadcast(items), len(order), best, postings)), "item long, key long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("key"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return written(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "key", "score"), "found")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, postings: int = POSTINGS) -> DataFrame:
    """The best documents for every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = items.select(F.col(item_col).alias("item_id"), text_of(item_text).cast("binary").alias("text")).distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    asked = asked.mapInArrow(item_terms, f"item_id {kind}, term binary, n long").groupBy("item_id", "term").agg(F.sum("n").alias("n"))
    asked = written(asked, "items")
    n_blocks = max(1, -(-asked.count() // block))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), text_of(text_col).cast("binary").alias("text"))
    found, of_all = None, None
    for i in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i).toArrow().to_pylist()
        terms = sorted({r["term"] for r in rows})
        number = {t: place for place, t in enumerate(terms, 1)}
        held: dict = {}
        for r in rows:
            held.setdefault(r["item_id"], []).append((number[r["term"]], r["n"]))
        vectors = written(source.mapInArrow(tidied(restricted(spark.sparkContext.broadcast(number))), "key long, n long, terms binary, tfs binary"), "vectors")
        of_all = of_all or vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        names = spark.createDataFrame(list(enumerate(held)), f"item long, item_id {kind}")
        part = _block(vectors, names, terms, list(held.values()), of_all[0], of_all[1], best, postings)
        found = part if found is None else found.unionByName(part)
    return found.select("item_id", "rank", F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "score")


def query(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best documents for every item."""
    return search(docs, items)


SQL = r"""
WITH held AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), docs AS (
  SELECT doc, doc_id, terms, len(terms) AS size FROM held WHERE len(terms) > 0
), everything AS (
  SELECT count(*) AS n_docs, sum(size)::BIGINT AS n_terms FROM docs
), asked AS (
  SELECT item_id, term, count(*) AS repeats
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), tfs AS (
  SELECT doc, doc_id, size, term, count(*) AS tf FROM (SELECT doc, doc_id, size, unnest(terms) AS term FROM docs) SEMI JOIN asked USING (term) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, everything GROUP BY term
), scores AS (
  SELECT item_id, doc, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * size * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term), everything
  GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""
